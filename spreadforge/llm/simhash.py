"""SimHash near-duplicate groups with a Gray-order hierarchical index.

A fingerprint bit is 1 where it is set in over half of the hashes (XXH64, seed
42) of a text's word shingles.  Equal fingerprints are one entry.  Two entries
link when they differ in at most ``max_bits`` bits:

* upper nodes: 64 bits are cut into ``max_bits + 1`` segments; entries within
  the distance agree on a whole segment, so each entry enters one group per
  segment value.  A group above ``LEAF`` entries is split by the pattern of its
  next eight bits; pairs of child nodes carry the differences of their patterns
  and are dropped as soon as these add up to more than ``max_bits``.  Splitting
  goes on until every group is small, so no group gathers in one task.
* leaf groups, of any size: entries are sorted by Gray rank (neighbours share
  most bits); runs of 256 and, under them, of 32 entries become nodes with the
  pattern of their shared bits, and pairs of nodes whose shared bits differ too
  much are pruned as a whole.  All links come from this descent.

Only spanning links leave a leaf.  Every pruned pair has more than ``max_bits``
differing bits, so the links are exact.

Defined results: a null, empty or wordless text has fingerprint zero, linked
like any other; repeated rows share a group; the component id is the smallest
id, null only if no member has an id; other columns are kept or ignored."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadforge.llm import bytetext as B
from spreadforge.llm.components import components
from spreadforge.llm.tables import fresh, materialize, row_id, shuffled

SHINGLE = 3
MAX_BITS = 3
SEED = 42
LEAF = 2048
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of a run of texts, and its text's number.  A text
    of fewer words is one shingle; one without words has none."""
    low = B.lower_ascii(data)
    word = ~_SPACE[low]
    start, end, text = B.runs(word, offsets)
    if len(start) == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    # words of a text joined by one space: keep the byte after each word
    keep = word.copy()
    after = end[end < len(low)]
    keep[after] = True
    joined = np.where(word, low, 32).astype(np.uint8)
    # a word that ends its text has no space byte after it: none is needed, as shingles end at words
    at = np.concatenate([[0], np.cumsum(keep)])
    buf = joined[keep].tobytes()
    n = np.bincount(text, minlength=len(offsets) - 1)
    last = np.repeat(np.cumsum(n) - 1, n)                     # last word of the word's text
    index = np.arange(len(start))
    head = index == np.repeat(np.cumsum(n) - n, n)
    first = np.flatnonzero((index + width - 1 <= last) | head)
    stop = np.minimum(first + width - 1, last[first])
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(buf[a:b], SEED) for a, b in zip(at[start[first]].tolist(), at[end[stop]].tolist())),
                    np.uint64, len(first))
    return h, text[first]


def fold(h: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """Fingerprint of each text from its shingles' hashes."""
    out = np.zeros(n_texts, np.uint64)
    if len(h) == 0:
        return out
    cut = B.group_slices(text)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, cut[:-1], axis=0, dtype=np.int64)
    up = ones * 2 > np.diff(cut)[:, None]
    out[text[cut[:-1]]] = np.packbits(up, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``fp`` (64 bits as a signed bigint) of each row."""
    src = docs.select(*keep, "text")
    schema = src.drop("text").schema.add("fp", "long")
    text_at = len(keep)

    def run(batches):
        for batch in batches:
            fps = [np.empty(0, np.uint64)]
            for first, end, data, off in B.chunks(batch.column(text_at)):
                h, text = shingle_hashes(data, off, shingle)
                fps.append(fold(h, text, end - first))
            fp = pa.array(np.concatenate(fps).view(np.int64))
            yield pa.RecordBatch.from_arrays(batch.columns[:text_at] + [fp], names=[*batch.schema.names[:text_at], "fp"])

    return src.mapInArrow(run, schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


#: entries under an upper and a lower node of a leaf group
SIZES = (256, 32)
#: pairs looked at together
AT_ONCE = 1 << 22


def _cut(part: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of nodes of at most ``size`` entries, none across parts."""
    edge = B.group_slices(part)
    k = -(-np.diff(edge) // size)
    first = np.repeat(edge[:-1], k) + size * (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))
    return first, np.minimum(first + size, np.repeat(edge[1:], k))


def _shared(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pattern and mask of the bits that all entries of a node share."""
    every, some = np.bitwise_and.reduceat(x, first), np.bitwise_or.reduceat(x, first)
    return every, ~(every ^ some)


def _products(left, right):
    """Index pairs of the products of ranges ``left[k] x right[k]``, in blocks
    of about ``AT_ONCE`` pairs, each with the number of its range pair."""
    (la, lb), (ra, rb) = left, right
    n = (lb - la) * (rb - ra)
    block = (np.cumsum(n) - n) // AT_ONCE
    edge = B.group_slices(block)
    for s, e in zip(edge[:-1], edge[1:]):
        m = n[s:e]
        which = np.repeat(np.arange(s, e), m)
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        width = (rb - ra)[which]
        yield la[which] + at // width, ra[which] + at % width, which


def descend(x: np.ndarray, group: np.ndarray, side: np.ndarray, max_bits: int):
    """Index pairs within the distance, in blocks.  Entries are sorted by
    (group, side, Gray rank); a group with two sides gives pairs across them
    only, other groups give each pair once.  Node pairs whose shared bits
    differ too much are left out whole, first of upper, then of lower nodes."""
    if len(x) == 0:
        return
    top, top_end = _cut(group * 2 + side, SIZES[0])
    low, low_end = _cut(np.repeat(np.arange(len(top)), top_end - top), SIZES[1])
    child, child_end = np.searchsorted(low, top), np.searchsorted(low, top_end)
    pattern, mask = _shared(x, top)
    low_pattern, low_mask = _shared(x, low)
    # upper nodes of a group: with those of the other side, or with itself and those behind it
    edge = B.group_slices(group[top])
    last = np.repeat(edge[1:], np.diff(edge))
    ones = np.add.reduceat(side[top], edge[:-1])
    cross = np.repeat((ones > 0) & (ones < np.diff(edge)), np.diff(edge))
    second = last - np.repeat(ones, np.diff(edge))
    me = np.arange(len(top))
    start = np.where(cross, np.where(side[top] == 0, second, last), np.where(side[top] == 0, me, last))
    for i, j, _ in _products((me, me + 1), (start, last)):
        ok = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= max_bits
        i, j = i[ok], j[ok]
        for c, d, _ in _products((child[i], child_end[i]), (child[j], child_end[j])):
            ok = (c <= d) & (np.bitwise_count((low_pattern[c] ^ low_pattern[d]) & low_mask[c] & low_mask[d]) <= max_bits)
            c, d = c[ok], d[ok]
            for u, v, _ in _products((low[c], low_end[c]), (low[d], low_end[d])):
                ok = (u < v) & (np.bitwise_count(x[u] ^ x[v]) <= max_bits)
                yield u[ok], v[ok]


def near_pairs(a: np.ndarray, b: np.ndarray | None, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the distance: between two Gray-sorted arrays, or
    within one (``b`` None, first index smaller)."""
    x = a if b is None else np.concatenate([a, b])
    side = np.repeat([0, 1], [len(a), len(x) - len(a)])
    z = [(np.empty(0, np.int64),) * 2]
    i, j = (np.concatenate(v) for v in zip(*z, *descend(x, np.zeros(len(x), np.int64), side, max_bits)))
    return (i, j) if b is None else (i, j - len(a))


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index each of ``n`` entries is connected to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _leaf_links(group: np.ndarray, side: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of all groups of a stretch: Gray order, then descent."""
    order = np.lexsort((gray_rank(fp), side, group))
    x = fp[order]
    label = np.arange(len(x))
    for i, j in descend(x, np.cumsum(np.diff(group[order], prepend=group[order][:1]) != 0), side[order].astype(np.int64), max_bits):
        label = spanning(len(x), np.concatenate([i, np.arange(len(x))]), np.concatenate([j, label]))
    own = np.flatnonzero(label != np.arange(len(x)))
    return x[own], x[label[own]]


def _pop(c: Column) -> Column:
    return F.bit_count(c)


def links(entries: DataFrame, max_bits: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """``u, v``: links that connect all entries (distinct ``fp``) within
    ``max_bits`` differing bits of each other, directly or by a chain."""
    n_seg = max_bits + 1
    edges = [64 * k // n_seg for k in range(n_seg + 1)]
    # low bits of the rotated fingerprint: the segments that follow the shared one
    seg = F.explode(F.array(*[F.struct(F.lit(k).alias("r"), F.shiftrightunsigned("fp", edges[k])
                                       .bitwiseAND((1 << (edges[k + 1] - edges[k])) - 1).alias("value")) for k in range(n_seg)]))
    level = entries.select("fp", seg.alias("s")).select(
        F.xxhash64("s.r", "s.value").alias("g"), F.col("s.r").alias("r"), F.lit(0).alias("side"), F.lit(0).alias("used"), "fp")
    leaves = None
    for depth in range(8):
        level = materialize(level)
        hot = level.groupBy("g").count().where(F.col("count") > leaf).select("g")
        hot = materialize(hot)
        if depth == 7 or hot.isEmpty():
            leaves = level if leaves is None else leaves.unionByName(level)
            break
        cold = level.join(shuffled(hot), "g", "left_anti")
        leaves = cold if leaves is None else leaves.unionByName(cold)
        # the next eight bits behind the shared segment, cyclic
        end = F.array(*[F.lit(e) for e in edges[1:]])[F.col("r")]
        shift = F.pmod(end + 8 * depth, F.lit(64))
        byte = F.expr("shiftrightunsigned(fp, sh)").bitwiseOR(F.expr("CASE WHEN sh = 0 THEN 0L ELSE shiftleft(fp, 64 - sh) END")).bitwiseAND(255)
        split = level.join(shuffled(hot), "g", "left_semi").withColumn("sh", shift.cast("int")).withColumn("node", byte.cast("int")).drop("sh")
        nodes = split.groupBy("g", "used", "side", "node").count()
        two = nodes.groupBy("g").agg(F.max("side").alias("two")).where("two = 1").select(F.col("g").alias("g2"))
        x = nodes.select("g", "used", F.col("side").alias("s1"), F.col("node").alias("n1"))
        y = nodes.select(F.col("g").alias("gy"), F.col("side").alias("s2"), F.col("node").alias("n2"))
        pair = (x.join(y, x["g"] == y["gy"]).join(two, x["g"] == two["g2"], "left")
                .where(F.when(F.col("g2").isNull(), F.col("n1") <= F.col("n2")).otherwise((F.col("s1") == 0) & (F.col("s2") == 1)))
                .withColumn("now", F.col("used") + _pop(F.col("n1").bitwiseXOR(F.col("n2")))).where(F.col("now") <= max_bits))
        inner = F.col("g2").isNull() & (F.col("n1") == F.col("n2"))
        pair = pair.select("g", F.xxhash64("g", "n1", "n2").alias("child"), "now",
                           F.explode(F.when(inner, F.array(F.struct(F.col("s1").alias("s"), F.col("n1").alias("n"), F.lit(0).alias("t"))))
                                     .otherwise(F.array(F.struct(F.col("s1").alias("s"), F.col("n1").alias("n"), F.lit(0).alias("t")),
                                                        F.struct(F.col("s2").alias("s"), F.col("n2").alias("n"), F.lit(1).alias("t"))))).alias("e"))
        pair = pair.select("g", F.col("e.s").alias("side"), F.col("e.n").alias("node"), F.col("e.t").alias("t"), "child", "now")
        level = split.join(shuffled(pair), ["g", "side", "node"]).select(
            F.col("child").alias("g"), "r", F.col("t").alias("side"), F.col("now").alias("used"), "fp")
    return _leaves(leaves, max_bits)


def _leaves(leaves: DataFrame, max_bits: int) -> DataFrame:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def work(g, side, fp):
        """All groups of a sorted stretch."""
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in _leaf_links(g, side, fp, max_bits)], schema=schema)

    def run(batches):
        rest = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint64)]
        for batch in batches:
            have = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            rest = [np.concatenate([x, y]) for x, y in zip(rest, have)]
            cut = B.group_slices(rest[0])
            if len(cut) > 2:                                        # the last group may go on in the next batch
                yield work(*[x[:cut[-2]] for x in rest])
                rest = [x[cut[-2]:] for x in rest]
        if len(rest[0]):
            yield work(*rest)

    return (leaves.select("g", "side", "fp").repartition("g").sortWithinPartitions("g", "side")
            .mapInArrow(run, "u bigint, v bigint"))


def groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """Per row: ``doc_id, fp, component_id`` (smallest id reachable)."""
    rows = materialize(fingerprints(docs, shingle))
    entries = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    entries = materialize(entries)
    root = components(links(entries, max_bits, leaf), "u", "v")
    named = entries.join(shuffled(root), entries["fp"] == root["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(shuffled(least), "root").select("fp", "component_id")
    return rows.join(shuffled(by_fp), "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """The documents with one of each group: the row with the smallest id (of
    equal ids one; a group without ids keeps one row)."""
    a, b, key = fresh(docs, "row_a"), fresh(docs, "row_b"), row_id(*docs.columns)
    src = docs.select("doc_id", "text", key["a"].alias(a), key["b"].alias(b))
    rows = materialize(fingerprints(src, shingle, ("doc_id", a, b)))
    entries = materialize(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", a, b)).alias("least")))
    root = components(links(entries, max_bits, leaf), "u", "v")
    named = entries.join(shuffled(root), entries["fp"] == root["node"], "left").select("least", F.coalesce("root", "fp").alias("root"))
    kept = materialize(named.groupBy("root").agg(F.min("least").alias("k")).select(F.col("k." + a).alias(a), F.col("k." + b).alias(b)))
    keyed = docs.withColumn(a, key["a"]).withColumn(b, key["b"]).join(shuffled(kept), [a, b], "left_semi")
    return keyed.dropDuplicates([a, b]).select(*docs.columns)
