"""Substring dedup by paragraph MinHash banding.

Paragraphs come in two kinds, both over normalised words (``[0-9a-z]`` and
non-ASCII bytes after lower-casing A-Z):

* lines, and blocks of several lines between lines without words: equal words
  link them; those of at least ``SHINGLE`` words are also compared by MinHash
  over their five-word shingles, ``BANDS`` bands of ``ROWS`` rows (at a similarity of 0.8 a pair collides with
  probability ``1 - (1 - 0.8**2)**5`` = 99.4 %); colliding ones are verified
  by exact Jaccard similarity of their shingle sets (0.8 or more); a line or
  block that overlaps the occurrence that stays, in its own text, stays too;
* passages of at least ``MIN_WORDS`` words inside longer texts.  Their seeds are
  pieces of ``PIECE`` words which begin at words that the surrounding words
  choose (minimizers over ``CHOICE`` positions): equal passages choose equal
  pieces, and every passage of ``PIECE + CHOICE - 1`` words (20) holds one.
  Later pieces that follow each other as their first occurrences do, with the
  same words between (a 64-bit hash), form a run; ``CONTEXT`` words before and
  after a run are compared with those there; neighbouring pieces are at most
  ``CHOICE`` words apart, so the equal stretches found make up the maximal equal stretch.  Stretches of one first
  document that follow each other in both texts join, with the words between,
  as long as the shingles they share give a Jaccard similarity of 0.8 or more.
  What then has ``MIN_WORDS`` words is removed as a whole.

Linked lines form components; of each component the first occurrence (lowest
document, then position) stays and the others are removed, as are all later
passages; overlapping removals are merged.  A passage is compared with the
first occurrence of its pieces, and inside one document the first occurrence of
a piece always stays.  Words of passages are compared by 31 bits of their
hashes.

Texts of equal content are one node, so thousands of copies are one entry.
Buckets are verified by comparing a hub with all others at once, then every
line that is not yet connected with all others; a bucket above ``BLOCK`` lines
is dealt out by pairs of blocks, so none gathers in one task.  Only spanning
links leave a task.

Defined results: a null, empty or wordless text has no paragraphs and stays;
repeated rows (same id, same text) count as one document and all get its
result; null ids come last in order; other columns are kept or ignored."""
from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadforge.llm import bytetext as B
from spreadforge.llm.components import components
from spreadforge.llm.decontaminate import tokens_at
from spreadforge.llm.tables import fresh, materialize, release, row_id, shuffled, shuffles_dropped

SHINGLE = 5
SIMILARITY = 0.8
MIN_WORDS = 20
BANDS, ROWS = 5, 2
PIECE = 8
CHOICE = 13
CONTEXT = 13
PACKED = 5
BLOCK = 1024
#: bytes of text, or of results, that a Python worker holds at once besides the Arrow batch it reads
CHUNK = 1 << 18


def _lines(text: np.ndarray, start: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the lines of a run of texts begin, counted in words, and their end;
    each word's line."""
    newline = np.flatnonzero(data == 10)
    line = np.searchsorted(newline, start)                       # a word's line, counted over the run
    cut = B.group_slices(line + text)                            # a text's end ends its last line
    return cut, line


def _blocks(cut: np.ndarray, line: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of lines of one text that follow each other, two or more."""
    first = cut[:-1]
    ends = np.concatenate([[True], (line[first[1:]] - line[first[:-1]] > 1) | (text[first[1:]] != text[first[:-1]]), [True]])[-len(cut):]
    edge = np.flatnonzero(ends)
    many = np.diff(edge) > 1
    return cut[edge[:-1][many]], cut[edge[1:][many]]


def _pieces(h: np.ndarray, text: np.ndarray, piece: int, choice: int) -> np.ndarray:
    """First words of the pieces: minimizers over three-word hashes, within
    each text."""
    n = len(h)
    if n < choice + 2:
        return np.empty(0, np.int64)
    low = B.first_smallest(B.mix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)), choice)
    chosen = np.zeros(n, bool)
    chosen[low[text[:len(low)] == text[choice + 1:]]] = True     # windows that end in the text they begin in
    p = np.flatnonzero(chosen[:max(n - piece + 1, 0)])
    return p[text[p] == text[p + piece - 1]]


def _content(h: np.ndarray, first: np.ndarray, last: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    a = B.sequence_hash(h, first, last, 0x9E3779B97F4A7C15) ^ np.uint64(kind)
    b = B.sequence_hash(h, first, last, 0xC2B2AE3D27D4EB4F)
    return a.view(np.int64), b.view(np.int64)


def _shingles(h: np.ndarray, width: int) -> np.ndarray:
    s = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - width + 1 + k] if len(s) else s
    return B.mix(s)


def _bands(s: np.ndarray, first: np.ndarray, last: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (lines x bands) of shingle ranges ``first..last``."""
    edges = np.stack([first, last], 1).ravel()
    pad = np.concatenate([s, [np.uint64(0xFFFFFFFFFFFFFFFF)]])
    out = np.zeros((len(first), bands), np.uint64)
    for b in range(bands):
        for r in range(rows):
            x = B.mix(pad ^ np.uint64((b * rows + r + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
            x[-1] = np.uint64(0xFFFFFFFFFFFFFFFF)
            low = np.minimum.reduceat(x, edges)[::2] if len(edges) else x[:0]
            out[:, b] = B.mix(out[:, b] * np.uint64(31) + low)
        out[:, b] ^= np.uint64(b + 1)
    return out


def _together(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches joined to some of about ``CHUNK`` bytes."""
    have, size = [], 0
    for part in parts:
        have.append(part)
        size += part.nbytes
        if size >= CHUNK:
            yield from pa.Table.from_batches(have).combine_chunks().to_batches()
            have, size = [], 0
    if have:
        yield from pa.Table.from_batches(have).combine_chunks().to_batches()


def _source(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", row_id("doc_id", "text")["a"].alias("row"), "text")


def _entries(found: pa.ListArray) -> tuple[list[pa.Array], np.ndarray]:
    """Fields of all structs of a list column, and the row of each."""
    size = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
    return found.flatten().flatten(), np.repeat(np.arange(len(found)), size)


def _binary(data: np.ndarray, cut: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    """A column of the values that lie between the offsets ``cut`` of ``data``."""
    return pa.Array.from_buffers(kind, len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def occurrences(docs: DataFrame, kind: str, **opt) -> DataFrame:
    """``ca`` (content), ``doc_id, row`` of every line or piece; for lines also
    the bytes ``lo, hi``, ``cb`` and ``bands``, for pieces the word ``at`` and
    ``chain``, a hash of all words from the piece before to this one (0: none)."""
    piece, choice = opt.get("piece", PIECE), opt.get("choice", CHOICE)
    schema = "ca bigint, doc_id bigint, row bigint, " + ("lo int, cb bigint, hi int, bands array<bigint>" if kind == "line" else "at int, chain bigint")

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1)
            for first, end, data, off in B.chunks(batch.column(2), CHUNK):
                h, start, stop, text = tokens_at(data, off)
                if kind == "piece":
                    a = _pieces(h, text, piece, choice)
                    b = a + piece
                else:
                    lines, line = _lines(text, start, data)
                    more = _blocks(lines, line, text)
                    a, b = np.concatenate([lines[:-1], more[0]]), np.concatenate([lines[1:], more[1]])
                if len(a) == 0:
                    continue
                ca, cb = _content(h, a, b, kind == "piece")
                t = text[a]
                at = pa.array(first + t)
                cols = [pa.array(ca), ids.take(at), rows.take(at)]
                names = ["ca", "doc_id", "row", "at", "chain"]
                if kind == "piece":
                    before = np.concatenate([a[:1], a[:-1]])
                    begun = np.concatenate([[False], t[1:] == t[:-1]])
                    chain = B.sequence_hash(h, np.where(begun, before, a), b, 0x165667B19E3779F9) | np.uint64(1)
                    word = a - np.searchsorted(text, t)
                    cols += [pa.array(word.astype(np.int32)), pa.array(np.where(begun, chain, np.uint64(0)).view(np.int64))]
                else:
                    names = ["ca", "doc_id", "row", "lo", "cb", "hi", "bands"]
                    cols += [pa.array((start[a] - off[t]).astype(np.int32)), pa.array(cb), pa.array((stop[b - 1] - off[t]).astype(np.int32))]
                    near = b - a >= SHINGLE
                    bands = _bands(_shingles(h, SHINGLE), a[near], b[near] - SHINGLE + 1, BANDS, ROWS)
                    cut = np.concatenate([[0], np.cumsum(near * BANDS)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(cut, pa.array(bands.ravel().view(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return _source(docs).mapInArrow(run, schema)


def _packed_sets(s: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The sorted distinct values (40 bits) of the ranges ``first..last`` of
    ``s``, packed, and the bytes of each."""
    out, sizes = [], []
    for x in range(0, len(first), 4096):
        a, n = first[x:x + 4096], (last - first)[x:x + 4096]
        at = np.arange(int(n.sum())) + np.repeat(a - (np.cumsum(n) - n), n)
        owner = np.repeat(np.arange(len(a), dtype=np.uint64), n)
        key = np.unique(s[at] | owner << np.uint64(8 * PACKED))
        out.append(key.view(np.uint8).reshape(-1, 8)[:, :PACKED].ravel())
        sizes.append(np.bincount((key >> np.uint64(8 * PACKED)).astype(np.int64), minlength=len(a)) * PACKED)
    size = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
    return _binary(np.concatenate(out) if out else np.empty(0, np.uint8), np.concatenate([[0], np.cumsum(size)])), size


def _line_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``g, ca, cb`` of ``members`` with ``s``, the sorted distinct shingle hashes
    of the content (40 bits each, packed), read from one of its texts (``row, lo,
    hi``)."""
    wanted = members.groupBy("row").agg(F.collect_list(F.struct("g", "ca", "cb", "lo", "hi")).alias("lines"))
    texts = _source(docs).select("row", "text").join(shuffled(wanted), "row").dropDuplicates(["row"])

    def sets_of(batches):
        for batch in batches:
            for first, last, data, off in B.chunks(batch.column(0), CHUNK):
                (g, ca, cb, lo, hi), t = _entries(batch.column(1).slice(first, last - first))
                h, start, end, _ = tokens_at(data, off)
                a, b = np.searchsorted(start, lo.to_numpy() + off[t]), np.searchsorted(end, hi.to_numpy() + off[t]) + 1
                s = _shingles(h, SHINGLE) >> np.uint64(24)
                # a set is made once for all the buckets that hold its line
                order = np.lexsort((b, a))
                begins = np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])[:len(order)]
                number = np.empty(len(order), np.int64)
                number[order] = np.cumsum(begins) - 1
                packed, size = _packed_sets(s, a[order][begins], b[order][begins] - SHINGLE + 1)
                edge = np.searchsorted(np.cumsum(size[number]), np.arange(CHUNK, int(size[number].sum()) + CHUNK, CHUNK))
                edge = np.unique(np.concatenate([[0], np.minimum(edge + 1, len(order))]))
                for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    sets = packed.take(pa.array(number[x:y]))
                    yield pa.RecordBatch.from_arrays([g.slice(x, y - x), ca.slice(x, y - x), cb.slice(x, y - x), sets], names=["g", "ca", "cb", "s"])

    def run(batches):
        return _together(sets_of(batches))

    return texts.select("text", "lines").mapInArrow(run, "g bigint, ca bigint, cb bigint, s binary")


def _similar(values: np.ndarray, ends: np.ndarray, cut: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between the similar ones of the sets (``values`` between
    ``ends``) of each bucket (sets between ``cut``)."""
    size, members = np.diff(ends), np.diff(cut)
    bucket = np.repeat(np.arange(len(members)), members)
    first = cut[:-1][bucket]                                     # the first set of a bucket against all of it
    owner = np.repeat(np.arange(len(size)), size)
    key = values | bucket[owner].astype(np.uint64) << np.uint64(8 * PACKED)
    hub = key[owner == first[owner]]
    common = np.bincount(owner, weights=hub[np.minimum(np.searchsorted(hub, key), len(hub) - 1)] == key, minlength=len(size)) if len(hub) else np.zeros(len(size))
    near = common >= similarity * (size + size[first] - common) - 1e-9
    near[cut[:-1]] = True
    v = np.flatnonzero(near & (first != np.arange(len(size))))
    left, right = [first[v]], [v]
    for k in np.unique(bucket[~near]).tolist():
        a, b = int(cut[k]), int(cut[k + 1])
        if b - a > 2:
            u, v = _others(values[ends[a]:ends[b]], size[a:b], near[a:b], similarity)
            left.append(u + a)
            right.append(v + a)
    return np.concatenate(left), np.concatenate(right)


def _others(values: np.ndarray, size: np.ndarray, near: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one bucket's sets that are not ``near`` its first one,
    with all others: shared values counted by products of 0/1 matrices, some
    values at a time."""
    n, todo = len(size), np.flatnonzero(~near)
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    order = np.argsort(values, kind="stable")
    value, owner = values[order], owner[order]
    begins = np.concatenate([[True], value[1:] != value[:-1]])[:len(value)]
    number = np.cumsum(begins) - 1
    held = np.bincount(number) > 1                               # values of one set only are not shared
    column = (np.cumsum(held) - 1)[number]
    owner, column = owner[held[number]], column[held[number]]
    kind = np.float32 if size.max() < 1 << 24 else np.float64    # counts are exact
    common = np.zeros((len(todo), n), kind)
    width = max(64, CHUNK // n)
    for x in range(0, int(held.sum()), width):
        i, j = np.searchsorted(column, (x, x + width))
        has = np.zeros((n, min(width, int(held.sum()) - x)), kind)
        has[owner[i:j], column[i:j] - x] = 1
        common += has[todo] @ has.T
    label = np.where(near, 0, np.arange(n))
    left, right = [], []
    for at, one in enumerate(todo.tolist()):
        mine = common[at].astype(np.float64)
        for other in np.flatnonzero((mine >= similarity * (size[one] + size - mine) - 1e-9) & (label != label[one])).tolist():
            if label[other] != label[one]:
                left.append(one)
                right.append(other)
                label[label == label[other]] = label[one]
    return np.array(left, np.int64), np.array(right, np.int64)


def _verified(buckets: DataFrame, similarity: float) -> DataFrame:
    """Spanning links of each bucket (``g``): lines with similar shingle sets."""
    names = ["ua", "ub", "va", "vb"]

    def work(t: pa.Table):
        g = t.column("g").to_numpy()
        cut = B.group_slices(g)
        ca, cb = t.column("ca").to_numpy(), t.column("cb").to_numpy()
        s = t.column("s").combine_chunks()
        _, ends, packed = s.buffers()
        ends = np.frombuffer(ends, np.int32, len(s) + 1, s.offset * 4).astype(np.int64)
        left, right = [], []
        at = 0
        while at < len(cut) - 1:                                 # some buckets at a time are unpacked
            stop = max(int(np.searchsorted(ends[cut], ends[cut[at]] + CHUNK, side="right")) - 1, at + 1)
            a, b = int(cut[at]), int(cut[stop])
            if b - a > stop - at:
                mine = np.frombuffer(packed, np.uint8, ends[b] - ends[a], ends[a]).reshape(-1, PACKED)
                values = np.zeros((len(mine), 8), np.uint8)
                values[:, :PACKED] = mine
                u, v = _similar(values.view(np.uint64).ravel(), (ends[a:b + 1] - ends[a]) // PACKED, cut[at:stop + 1] - a, similarity)
                left.append(u + a)
                right.append(v + a)
            at = stop
        u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ca[u], cb[u], ca[v], cb[v])], names=names)

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            cut = B.group_slices(t.column("g").to_numpy())
            if len(cut) > 2:
                yield work(t.slice(0, cut[-2]))
                t = t.slice(cut[-2])
            rest = t
        if rest is not None and rest.num_rows:
            yield work(rest)

    return (buckets.select("g", "ca", "cb", "s").repartition("g").sortWithinPartitions("g", "ca", "cb")
            .mapInArrow(run, "ua bigint, ub bigint, va bigint, vb bigint"))


def line_links(docs: DataFrame, lines: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Links between the contents of similar lines."""
    place = F.min(F.struct("row", "lo", "hi", "bands"))
    contents = materialize(lines.where(F.size("bands") > 0).groupBy("ca", "cb").agg(place.alias("f")))
    hit = contents.select(F.explode("f.bands").alias("band"), "ca", "cb", "f.row", "f.lo", "f.hi")
    # buckets of the same members are verified once
    own = [F.bit_xor(F.xxhash64(F.lit(k), "ca", "cb")).alias(f"x{k}") for k in (1, 2)]
    shared = hit.groupBy("band").agg(F.count("*").alias("count"), *own).where("count > 1")
    shared = materialize(shared.groupBy("count", "x1", "x2").agg(F.min("band").alias("band"))
                         .select("band", F.ceil(F.col("count") / block).cast("int").alias("n")))
    member = materialize(hit.join(shuffled(shared), "band"))
    release(contents, shared)
    mine = F.pmod(F.col("ca"), F.col("n")).cast("int")
    dealt = member.withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select(F.when(F.col("n") == 1, F.col("band")).otherwise(
        F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other"))).alias("g"), "ca", "cb", "row", "lo", "hi")
    links = materialize(_verified(_line_sets(docs, dealt), similarity))
    release(member)
    return links


def _at(*more: str):
    return F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row", *more)


def line_removals(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, **opt) -> DataFrame:
    """``doc_id, row, lo, hi`` of every removed line and ``kept_in``, the
    document that holds the occurrence that stays."""
    lines = materialize(occurrences(docs, "line", **opt))
    links = line_links(docs, lines, similarity, block)
    node = links.select(F.struct(F.col("ua").alias("a"), F.col("ub").alias("b")).alias("u"),
                        F.struct(F.col("va").alias("a"), F.col("vb").alias("b")).alias("v"))
    root = components(node, "u", "v")
    root = materialize(root.select(F.col("node.a").alias("ca"), F.col("node.b").alias("cb"), F.col("root.a").alias("ra"), F.col("root.b").alias("rb")))
    every = lines.drop("bands").join(shuffled(root), ["ca", "cb"], "left").select(
        F.coalesce("ra", "ca").alias("ca"), F.coalesce("rb", "cb").alias("cb"), "doc_id", "row", "lo", "hi")
    # a table of its own: a join whose two sides are plain shuffles can split a hot paragraph
    place = _at("lo", "hi")
    first = materialize(every.groupBy("ca", "cb").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f != l").select("ca", "cb", "f"))
    # a block and a line inside it may be alike
    return (every.join(shuffled(first), ["ca", "cb"]).where(~F.col("doc_id").eqNullSafe(F.col("f.doc_id")) | (F.col("row") != F.col("f.row")) | (F.col("lo") >= F.col("f.hi")))
            .select("doc_id", "row", "lo", "hi", F.col("f.doc_id").alias("kept_in")))


def _signs(h: np.ndarray) -> np.ndarray:
    """31 bits of each word's hash, never 0."""
    return ((h >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)


def _surroundings(h: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Signs of ``CONTEXT`` words on both sides of the pieces at words ``at`` of
    a run of texts, 0 beyond the text (pieces x words)."""
    own = np.zeros(len(h) + CONTEXT * (int(text[-1]) + 2 if len(text) else 1), np.uint32)
    own[np.arange(len(h)) + CONTEXT * (text + 1)] = _signs(h)
    return own[(at + CONTEXT * text[at])[:, None] + np.concatenate([np.arange(CONTEXT), np.arange(CONTEXT) + CONTEXT + PIECE])]


def _first_pieces(docs: DataFrame, first: DataFrame) -> DataFrame:
    """``ca`` with the words ``before`` and ``after`` the first occurrence of the
    piece."""
    wanted = first.groupBy(F.col("f.row").alias("row")).agg(F.collect_list(F.struct("ca", F.col("f.at").alias("at"))).alias("pieces"))
    texts = _source(docs).select("row", "text").join(shuffled(wanted), "row").dropDuplicates(["row"])

    def words_of(batches):
        for batch in batches:
            for first, last, data, off in B.chunks(batch.column(0), CHUNK):
                (ca, at), t = _entries(batch.column(1).slice(first, last - first))
                h, _, _, text = tokens_at(data, off)
                words = _surroundings(h, text, at.to_numpy() + np.searchsorted(text, t))
                cut = np.arange(len(words) + 1) * 4 * CONTEXT
                sides = [_binary(words[:, k:k + CONTEXT], cut) for k in (0, CONTEXT)]
                yield pa.RecordBatch.from_arrays([ca, *sides], names=["ca", "before", "after"])

    def run(batches):
        return _together(words_of(batches))

    return texts.select("text", "pieces").mapInArrow(run, "ca bigint, before binary, after binary")


def passage_seeds(docs: DataFrame, **opt) -> DataFrame:
    """Runs of later pieces that follow each other in their text as in the text
    of their first occurrences, with the same words between: ``doc_id, row``, the
    words ``lo`` and ``hi`` at which the first and the last piece begin, the
    document ``kept_in`` and row ``src`` of the first occurrences, ``shift``
    (words between both places) and the words ``before`` and ``after`` there."""
    pieces = occurrences(docs, "piece", **opt)
    place = F.min(_at("at", "chain"))
    first = materialize(pieces.groupBy("ca").agg(place.alias("f"), F.count("*").alias("n")).where("n > 1").select("ca", "f"))
    # a table of its own: a join whose two sides are plain shuffles can split a hot piece
    later = pieces.join(shuffled(first), "ca").where(_at("at", "chain") != F.col("f")).select(
        "doc_id", "row", "at", "ca", F.col("f.doc_id").alias("kept_in"), F.col("f.row").alias("src"),
        (F.col("at") - F.col("f.at")).alias("shift"), ((F.col("chain") != 0) & (F.col("chain") == F.col("f.chain"))).alias("follows"))
    # the pieces of one text: equal words since the piece before, and that piece first found in the same place
    text = Window.partitionBy("doc_id", "row").orderBy("at", "src", "shift")
    goes_on = F.col("follows") & F.lag("src").over(text).eqNullSafe(F.col("src")) & F.lag("shift").over(text).eqNullSafe(F.col("shift"))
    number = F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(text)
    runs = later.withColumn("goes_on", goes_on).withColumn("run", number).groupBy("doc_id", "row", "run").agg(
        F.min("at").alias("lo"), F.max("at").alias("hi"), F.min("kept_in").alias("kept_in"), F.min("src").alias("src"), F.min("shift").alias("shift"),
        F.min_by("ca", "at").alias("left"), F.max_by("ca", "at").alias("right"))
    runs = materialize(runs.drop("run"))
    ends = runs.select(F.explode(F.array("left", "right")).alias("ca")).distinct()
    known = materialize(_first_pieces(docs, first.join(shuffled(ends), "ca", "left_semi")))
    release(first)
    left, right = known.select(F.col("ca").alias("left"), "before"), known.select(F.col("ca").alias("right"), "after")
    return runs.join(shuffled(left), "left").join(shuffled(right), "right").drop("left", "right")


def stretches(words: tuple, row: np.ndarray, seeds: dict, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int | None]]:
    """Text, ``first`` and ``last`` (words) and ``kept_in`` of the passages of a
    run of texts that their seeds (columns of ``passage_seeds`` and the number
    ``text``) show to be repeated.  ``words``: hashes and text numbers of the
    run's words; ``row``: of each text."""
    h, text = words
    t, w, last, shift, src = (np.asarray(seeds[k], np.int64) for k in ("text", "lo", "hi", "shift", "src"))
    begin = np.searchsorted(text, t)

    def equal_words(at, theirs, side):
        theirs = theirs.cast(pa.binary())
        ends = np.frombuffer(theirs.buffers()[1], np.int32, len(theirs) + 1, theirs.offset * 4)
        theirs = np.frombuffer(theirs.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(np.uint32).reshape(len(w), -1)
        return (_surroundings(h, text, begin + at)[:, side] == theirs) & (theirs != 0)

    left = np.logical_and.accumulate(equal_words(w, seeds["before"], slice(None, CONTEXT))[:, ::-1], 1).sum(1)
    right = np.logical_and.accumulate(equal_words(last, seeds["after"], slice(CONTEXT, None)), 1).sum(1)
    lo, hi = w - left, last + PIECE + right
    lo = np.where(src == row[t], np.maximum(lo, w - shift + PIECE), lo)    # inside one text the first occurrence stays
    some = lo < hi
    columns = [x[some].tolist() for x in (t, src, shift, lo, hi)]
    groups: dict = {}
    for one, source, *place, kept in zip(*columns, seeds["kept_in"].filter(pa.array(some)).to_pylist()):
        groups.setdefault((one, source, kept), []).append(place)
    out = []
    for (one, source, kept), found in groups.items():
        # equal stretches: one offset between the texts, overlapping
        equal = []
        for shift, a, b in sorted(found):
            if equal and equal[-1][0] == shift and a <= equal[-1][2]:
                equal[-1][2] = max(equal[-1][2], b)
            else:
                equal.append([shift, a, b])
        # near copies: a, b in this text, x, y in the other, shingles they share
        near = []
        for shift, a, b in sorted(equal, key=lambda e: e[1:]):
            n = max(b - a - SHINGLE + 1, 0)
            if near:
                c, _, x, _, m = near[-1]
                mine, others = b - c - SHINGLE + 1, b - shift - x - SHINGLE + 1
                if a >= near[-1][1] and a - shift >= near[-1][3] and m + n >= similarity * (mine + others - m - n) - 1e-9:
                    near[-1] = [c, b, x, b - shift, m + n]
                    continue
            near.append([a, b, a - shift, b - shift, n])
        out += [(one, a, b, kept) for a, b, *_ in near if b - a >= MIN_WORDS]
    found = np.array([x[:3] for x in out], np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2], [x[3] for x in out]


def dedup_paragraphs(docs: DataFrame, **opt) -> DataFrame:
    """The documents, all columns, with ``n_paragraphs`` (lines of enough
    words), ``n_removed`` (bytes), ``n_spans``, ``kept`` (the text that is
    left) and ``kept_in`` (documents that hold what was removed here)."""
    names = [fresh(docs, x) for x in ("n_paragraphs", "n_removed", "n_spans", "kept", "kept_in")]
    d, r, sp = (fresh(docs, x) for x in ("removed_doc", "removed_row", "removed_spans"))
    similarity = opt.get("similarity", SIMILARITY)
    plain = docs.select("doc_id", "text")
    own = F.coalesce("doc_id", F.lit(0)).alias(d), F.col("row").alias(r)
    more = "src bigint, shift int, before binary, after binary"
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in more.split(", "))]
    with shuffles_dropped(docs.sparkSession):
        lines = line_removals(plain, **opt).select(*own, "lo", "hi", "kept_in", *none)
        seeds = passage_seeds(plain, **opt).select(*own, "lo", "hi", "kept_in", "src", "shift", "before", "after")
        gone = materialize(lines.unionByName(seeds).groupBy(d, r).agg(F.collect_list(F.struct("lo", "hi", "kept_in", "src", "shift", "before", "after")).alias(sp)))
    keyed = docs.withColumn(d, F.coalesce("doc_id", F.lit(0))).withColumn(r, row_id("doc_id", "text")["a"])
    joined = keyed.join(shuffled(gone), [d, r], "left").select(*docs.columns, r, sp)
    text_at, row_at = docs.columns.index("text"), len(docs.columns)

    min_words = opt.get("min_words", MIN_WORDS)

    def spans(words: tuple, off: np.ndarray, row: np.ndarray, found: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Removed bytes of a run of texts of ``words`` (``tokens_at``), each
        with its text and the document that keeps them."""
        c, t = _entries(found)
        c = dict(zip(("lo", "hi", "kept_in", "src", "shift", "before", "after"), c))
        line = pc.is_null(c["src"])
        own = line.to_numpy(zero_copy_only=False)
        text, lo, hi = t[own], *(c[k].filter(line).to_numpy() + off[t[own]] for k in ("lo", "hi"))
        kept = c["kept_in"].filter(line)
        if not own.all():
            h, start, end, of = words
            seeds = {k: x.filter(pc.invert(line)) for k, x in c.items()}
            one, a, b, more = stretches((h, of), row, {**seeds, "text": t[~own]}, similarity)
            begin = np.searchsorted(of, one)
            text, lo, hi = np.concatenate([text, one]), np.concatenate([lo, start[a + begin]]), np.concatenate([hi, end[b + begin - 1]])
            kept = pa.concat_arrays([kept, pa.array(more, kept.type)])
        return text, lo, hi, kept

    def cut(batches):
        for batch in batches:
            rows, every = batch.column(row_at), batch.column(row_at + 1)
            for first, last, data, off in B.chunks(batch.column(text_at), CHUNK):
                words = tokens_at(data, off)
                _, start, _, text = words
                n = last - first
                lines, _ = _lines(text, start, data)
                count = np.bincount(text[lines[:-1][np.diff(lines) >= min_words]], minlength=n)
                part = batch.slice(first, n)
                row = rows.slice(first, n).fill_null(0).to_numpy()
                t, lo, hi, src = spans(words, off, row, every.slice(first, n))
                depth = np.bincount(lo, minlength=len(data) + 1) - np.bincount(hi, minlength=len(data) + 1)
                gone = np.cumsum(depth[:-1]) > 0
                a, b, of = B.runs(gone, off)
                removed = np.bincount(of, weights=b - a, minlength=n).astype(np.int64)
                kept = _binary(data[~gone], off - np.concatenate([[0], np.cumsum(removed)]), pa.string())
                kept = pc.if_else(part.column(text_at).is_valid(), kept, pa.scalar(None, pa.string()))
                known = src.is_valid().to_numpy(zero_copy_only=False)
                sources = np.unique(np.stack([t[known], src.drop_null().to_numpy()], 1), axis=0)
                sources = pa.ListArray.from_arrays(pa.array(np.searchsorted(sources[:, 0], np.arange(n + 1)).astype(np.int32)), pa.array(sources[:, 1]))
                more = [pa.array(count), pa.array(removed), pa.array(np.bincount(of, minlength=n)), kept, sources]
                yield pa.RecordBatch.from_arrays(part.columns[:row_at] + more, names=batch.schema.names[:row_at] + names)

    schema = joined.select(*docs.columns).schema
    for name, kind in zip(names, (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.ArrayType(T.LongType()))):
        schema = schema.add(name, kind)
    return joined.mapInArrow(cut, schema)


def report(docs: DataFrame, **opt) -> DataFrame:
    """Per document row: ``doc_id, n_paragraphs, n_removed, n_spans,
    kept_sha256, kept_in``."""
    d = dedup_paragraphs(docs.select("doc_id", "text"), **opt)
    return d.select("doc_id", "n_paragraphs", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"), "kept_in")
