"""Exact substring dedup: every byte covered by a string of ``LENGTH`` bytes
that also starts somewhere else.

The method follows the difference-cover suffix sort, bounded to the first
``LENGTH`` bytes of each suffix, which is all that equal strings need, but its
sort is replaced: positions are sampled by content and repeats are found by
grouped counts of hashed names.  No suffix array and no ranks are made:

* names: a prefix of 3 bytes is its packed triple; a prefix of 9, 27, 81, ...
  bytes is named by the triple of names of its thirds (two 64-bit seeds where
  a name decides, so 128 bits); any other length by three overlapping names.
* cover: as in the difference-cover method only sampled suffixes are looked at
  first, and any two equal strings hold a sampled suffix at the same place.
  Fixed residues (2 of 3 positions) would shuffle 0.67 rows per byte; the cover
  here is chosen by content (the first smallest name among the first positions
  of each string), about one position in 60 bytes, named by 81 bytes.  Sampled names are
  counted, and suffixes whose name occurs once are done.
* recursion on longer names: the starts that share a sampled position are taken
  in aligned stretches of ``STRETCH``.  A stretch whose core (the bytes common
  to all its strings) has no equal is done; one whose whole extent (all its
  strings) has an equal is removed as a whole.
* merge of the remaining suffixes: stretches that share a core but differ in
  extent are resolved start by start by the names of all their
  ``LENGTH``-byte prefixes; equal names are repeats.  Equal extents are
  one entry, so copies are not expanded.

Every step is a grouped count with map-side merging and a join on the name, so
a string that a third of all documents hold is a skewed join key, never one
group in one task.  Names stand for their bytes (128 bits); no text is compared
in part.

Defined results: a null text counts as empty; texts shorter than ``LENGTH``
stay; repeated rows are separate documents and so repeat each other; other
columns are ignored or kept."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadforge.llm import bytetext as B
from spreadforge.llm.tables import fresh, materialize, row_id, shuffled

LENGTH = 200
STRETCH = 40

_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _power(limit: int) -> int:
    q = 3
    while q * 3 <= limit:
        q *= 3
    return q


def triple_names(data: np.ndarray, upto: int, seed: int) -> np.ndarray:
    """Name of the ``upto`` (a power of three) bytes from every position."""
    x = data.astype(np.uint64)
    n = len(x)
    have = 1
    a, b = np.uint64(seed | 1), np.uint64((seed * seed | 1) & (1 << 64) - 1)
    while have < upto and n:
        room = max(len(x) - 2 * have, 0)
        first, second, third = x[:room], x[have:have + room], x[2 * have:2 * have + room]
        if have == 1:
            x = first | second << np.uint64(8) | third << np.uint64(16)
        else:
            x = B.mix((first * a + second) * b + third)
        have *= 3
    return B.mix(x ^ np.uint64(seed)) if upto == 3 else x


def _name(names: np.ndarray, q: int, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Name of ``size`` bytes (``q`` to ``3 * q``) from each position."""
    size = np.broadcast_to(np.asarray(size, np.int64), at.shape)
    return B.mix((names[at] * np.uint64(0xD6E8FEB86659FD93) + names[at + (size - q) // 2]) * np.uint64(0xA0761D6478BD642F)
                 + names[at + size - q] + size.astype(np.uint64))


def cover_power(length: int) -> int:
    return _power(max(3, length * 9 // 20))


def cover(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Sampled positions of a run of texts: ``(text, position, first start,
    last start, all names)``; the starts are those whose string chose it, the
    names (of ``cover_power(length)`` bytes) those of every position."""
    q = cover_power(length)
    width = length - q + 1
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, np.empty(0, np.uint64)
    names = triple_names(data, q, _SEEDS[0])
    pos = np.arange(len(names), dtype=np.uint64)
    low = B.sliding((B.mix(names) & np.uint64(0xFFFFFFFF00000000)) | pos, width, np.minimum) & np.uint64(0xFFFFFFFF)
    start = np.arange(len(low))
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))[:len(low)]
    ok = start + length <= off[text + 1]
    start, text, low = start[ok], text[ok], low[ok].astype(np.int64)
    if len(start) == 0:
        return empty, empty, empty, empty, names
    head = np.concatenate([[0], np.flatnonzero((low[1:] != low[:-1]) | (text[1:] != text[:-1])) + 1])
    tail = np.concatenate([head[1:] - 1, [len(start) - 1]])
    return text[head], low[head], start[head], start[tail], names


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(0)).alias("d"), row_id("doc_id", "text")["a"].alias("r"), "text")


def _samples(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for first, end, data, off in B.chunks(batch.column(2)):
                text, at, _, _, names = cover(data, off, length)
                row = pa.array(first + text)
                yield pa.RecordBatch.from_arrays([pa.array(names[at].view(np.int64)), batch.column(0).take(row), batch.column(1).take(row),
                                                  pa.array((at - off[text]).astype(np.int32))], names=["name", "d", "r", "at"])

    return _keyed(docs).mapInArrow(run, "name bigint, d bigint, r bigint, at int")


def _repeated(df: DataFrame, *names: str) -> DataFrame:
    """Names that have an equal neighbour in sorted order, as a table of its
    own: a join whose two sides are plain shuffles can split a hot name."""
    return materialize(df.groupBy(*names).count().where("count > 1").select(*names))


def _stretches(texts: DataFrame, length: int, stretch: int) -> DataFrame:
    """``core, e1, e2, d, r, lo, n``: names of each aligned stretch of starts
    around the sampled positions in ``hits``."""
    q = _power(length - stretch + 1)
    if length + stretch - 1 > 3 * q:
        raise ValueError("stretch too long for the length")

    def run(batches):
        for batch in batches:
            for first, end, data, off in B.chunks(batch.column(2)):
                text, at, lo, hi, names = cover(data, off, length)
                hits = batch.column(3).slice(first, end - first)
                h_text = np.repeat(np.arange(end - first), np.diff(hits.offsets.to_numpy()[:end - first + 1]))
                h_at = hits.flatten().to_numpy() + off[h_text]
                keep = np.isin(at, h_at)
                text, at, lo, hi = text[keep], at[keep], lo[keep], hi[keep]
                if len(at) == 0:
                    continue
                k0, k1 = (at - hi) // stretch, (at - lo) // stretch
                n = k1 - k0 + 1
                row = np.repeat(np.arange(len(at)), n)
                k = k0[row] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                a = at[row]
                top = a - k * stretch                                    # the last start of the aligned stretch
                s_lo, s_hi = np.maximum(lo[row], top - stretch + 1), np.minimum(hi[row], top)
                one = names if q == cover_power(length) else triple_names(data, q, _SEEDS[0])
                two = triple_names(data, q, _SEEDS[1])
                core = _name(one, q, top, length - stretch + 1)
                size = s_hi - s_lo + length
                t = pa.array(first + text[row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core.view(np.int64)), pa.array(_name(one, q, s_lo, size).view(np.int64)), pa.array(_name(two, q, s_lo, size).view(np.int64)),
                     batch.column(0).take(t), batch.column(1).take(t), pa.array((s_lo - off[text[row]]).astype(np.int32)), pa.array((s_hi - s_lo + 1).astype(np.int32))],
                    names=["core", "e1", "e2", "d", "r", "lo", "n"])

    return texts.select("d", "r", "text", "hits").mapInArrow(run, "core bigint, e1 bigint, e2 bigint, d bigint, r bigint, lo int, n int")


def _starts(texts: DataFrame, length: int) -> DataFrame:
    """``w1, w2, e1, e2, i``: names of all strings of the stretches in
    ``parts`` (``e1, e2, lo, n``)."""
    q = _power(length)

    def run(batches):
        for batch in batches:
            for first, end, data, off in B.chunks(batch.column(0)):
                parts = batch.column(1).slice(first, end - first)
                t = np.repeat(np.arange(end - first), np.diff(parts.offsets.to_numpy()[:end - first + 1]))
                flat = parts.flatten()
                e1, e2, lo, n = (flat.field(k).to_numpy() for k in range(4))
                if len(lo) == 0:
                    continue
                n = n.astype(np.int64)
                row = np.repeat(np.arange(len(lo)), n)
                i = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at = (lo + off[t])[row] + i
                w1, w2 = (_name(triple_names(data, q, s), q, at, length).view(np.int64) for s in _SEEDS)
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), pa.array(e1[row]), pa.array(e2[row]), pa.array(i.astype(np.int32))],
                                                 names=["w1", "w2", "e1", "e2", "i"])

    return texts.select("text", "parts").mapInArrow(run, "w1 bigint, w2 bigint, e1 bigint, e2 bigint, i int")


def _texts_with_hits(docs: DataFrame, length: int) -> DataFrame:
    """All rows with ``d, r, hits``: the sampled positions whose name repeats."""
    samples = _samples(docs, length)
    hits = (samples.join(shuffled(_repeated(samples, "name")), "name", "left_semi")
            .groupBy("d", "r").agg(F.collect_set("at").alias("hits")))
    d, r, h = (fresh(docs, x) for x in ("key_d", "key_r", "key_hits"))
    keyed = docs.withColumn(d, F.coalesce("doc_id", F.lit(0))).withColumn(r, row_id("doc_id", "text")["a"])
    hits = hits.select(F.col("d").alias(d), F.col("r").alias(r), F.col("hits").alias(h))
    return keyed.join(shuffled(hits), [d, r], "left")


def repeats(texts: DataFrame, length: int = LENGTH, stretch: int = STRETCH) -> DataFrame:
    """``d, r, spans``: per row key the byte ranges (``lo``, ``hi``) that
    repeated strings cover.  ``texts`` has ``d, r, text, hits``."""
    every = _stretches(texts, length, stretch)
    at = F.struct("d", "r", "lo", "n")
    entry = materialize(every.groupBy("core", "e1", "e2").agg(F.count("*").alias("copies"), F.min(at).alias("at")))
    mixed = materialize(entry.groupBy("core").agg(F.count("*").alias("m"), F.min("copies").alias("least")).where("m > 1 and least = 1").select("core"))
    # one entry of each extent of the mixed cores, resolved start by start
    parts = (entry.join(shuffled(mixed), "core", "left_semi").groupBy("at.d", "at.r")
             .agg(F.collect_list(F.struct("e1", "e2", "at.lo", "at.n")).alias("parts")))
    wanted = texts.select("d", "r", "text").dropDuplicates(["d", "r"]).join(shuffled(parts), ["d", "r"])
    starts = materialize(_starts(wanted, length))
    again = (starts.join(shuffled(_repeated(starts, "w1", "w2")), ["w1", "w2"], "left_semi")
             .groupBy("e1", "e2").agg(F.collect_set("i").alias("i")))
    whole = entry.where("copies > 1").select("e1", "e2", F.lit(None).cast("array<int>").alias("i"))
    some = again.join(shuffled(whole.select("e1", "e2")), ["e1", "e2"], "left_anti")
    found = materialize(whole.unionByName(some.select("e1", "e2", "i")))
    hit = every.select("e1", "e2", "d", "r", "lo", "n").join(shuffled(found), ["e1", "e2"])
    start = F.explode(F.coalesce(F.transform("i", lambda i: F.struct((F.col("lo") + i).alias("lo"), (F.col("lo") + i + length).alias("hi"))),
                                 F.array(F.struct(F.col("lo").alias("lo"), (F.col("lo") + F.col("n") - 1 + length).alias("hi")))))
    return hit.select("d", "r", start.alias("s")).groupBy("d", "r").agg(F.collect_set("s").alias("spans"))


def _covered(rows: DataFrame, d: str, r: str, h: str, length: int, stretch: int) -> tuple[DataFrame, str]:
    """The rows that hold repeated names, with the spans to remove."""
    texts = rows.where(F.col(h).isNotNull()).select(F.col(d).alias("d"), F.col(r).alias("r"), "text", F.col(h).alias("hits"))
    s = fresh(rows, "key_spans")
    spans = materialize(repeats(texts, length, stretch)).select(F.col("d").alias(d), F.col("r").alias(r), F.col("spans").alias(s))
    return rows.where(F.col(h).isNotNull()).join(shuffled(spans), [d, r], "left"), s


def dedup_substrings(docs: DataFrame, length: int = LENGTH, stretch: int = STRETCH) -> DataFrame:
    """The documents, all columns, with ``n_bytes, n_removed, n_spans``,
    ``kept`` (bytes) and ``spans`` (removed byte ranges, merged)."""
    joined = _texts_with_hits(docs, length)
    d, r, h = (c for c in joined.columns if c not in docs.columns)
    rows = materialize(joined)
    hit, s = _covered(rows, d, r, h, length, stretch)
    plain = rows.where(F.col(h).isNull()).select(*docs.columns, F.lit(None).cast("array<struct<lo:int,hi:int>>").alias(s))
    return _cut(docs, plain, s).unionByName(_cut(docs, hit.select(*docs.columns, s), s))


def _cut(docs: DataFrame, rows: DataFrame, spans: str) -> DataFrame:
    names = [fresh(docs, x) for x in ("n_bytes", "n_removed", "n_spans", "kept", "spans")]
    text_at, n_cols = docs.columns.index("text"), len(docs.columns)
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches):
        for batch in batches:
            found = batch.column(n_cols)
            offsets, (los, his) = found.offsets.to_numpy(), (c.to_numpy() for c in found.values.flatten())
            size, gone, count, kept, starts, ends = [], [], [], [], [], []
            for k, text in enumerate(batch.column(text_at)):
                data = (text.as_py() or "").encode()
                a, b = offsets[k], offsets[k + 1]
                lo, hi = los[a:b], his[a:b]
                if b > a:
                    order = np.argsort(lo, kind="stable")
                    lo, reach = lo[order], np.maximum.accumulate(hi[order])
                    first = np.flatnonzero(np.r_[True, lo[1:] > reach[:-1]])       # what touches is one run
                    lo, hi = lo[first], reach[np.r_[first[1:] - 1, len(reach) - 1]]
                    edges = [0, *np.stack([lo, hi], 1).ravel().tolist(), len(data)]
                    kept.append(b"".join([data[x:y] for x, y in zip(edges[::2], edges[1::2])]))
                else:
                    kept.append(data)
                size.append(len(data))
                gone.append(int((hi - lo).sum()))
                count.append(len(lo))
                starts.append(lo)
                ends.append(hi)
            at = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int32()) for x in (starts, ends)], fields=list(kind.value_type))
            merged = pa.ListArray.from_arrays(at, flat)
            more = [pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary()), merged]
            yield pa.RecordBatch.from_arrays(batch.columns[:n_cols] + more, names=batch.schema.names[:n_cols] + names)

    schema = rows.select(*docs.columns).schema
    span = T.ArrayType(T.StructType().add("lo", "integer").add("hi", "integer"))
    for name, t in zip(names, (T.LongType(), T.LongType(), T.LongType(), T.BinaryType(), span)):
        schema = schema.add(name, t)
    return rows.mapInArrow(run, schema)


def report(docs: DataFrame, length: int = LENGTH, stretch: int = STRETCH) -> DataFrame:
    """Per document row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.
    Only texts with repeated names are kept beyond the first pass."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = _texts_with_hits(docs, length)
    d, r, h = (c for c in joined.columns if c not in docs.columns)
    again = F.col(h).isNotNull()
    rows = materialize(joined.select("doc_id", d, r, h, F.when(again, F.col("text")).alias("text"), F.octet_length("text").cast("bigint").alias("n_bytes"),
                                     F.when(~again, F.sha2("text", 256)).alias("sha")))
    hit, s = _covered(rows, d, r, h, length, stretch)
    cut = _cut(docs, hit.select("doc_id", "text", s), s)
    zero = F.lit(0).cast("bigint")
    return (rows.where(~again).select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"))
            .unionByName(cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))))
