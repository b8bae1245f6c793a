"""Document fingerprints: one-permutation MinHash with optimal densification.

All five-word shingles of a text are hashed once; the upper hash bits choose one
of ``BINS`` bins, and each bin keeps its smallest hash.  An empty bin borrows
from the first filled bin of its own fixed walk over all bins (every bin walks
with an odd stride from its own start, so the walk ends wherever one bin is
filled, and two documents borrow alike).  Of each bin the lowest ``BITS`` bits
are packed into the fingerprint.  Two fingerprints agree in a share of bins;
agreement by chance is corrected: ``(share - 2**-BITS) / (1 - 2**-BITS)``.

JVM functions only; hashing is per row.  The text that follows a document in
order of ids is found with one range partitioning of the ids and joins on the
id, so no task sees the whole order.

Words are ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z; a text
of fewer than five words is one shingle.

Defined results: null and wordless texts have a fingerprint of their own (all
``-``), alike to each other (1) and to nothing else (0); repeated ids are one
document each, followed by the documents with the next id (the smallest head
and the smallest fingerprint among them); rows without an id have no next document, their own text is the edit's
donor; a table of one document is its own next; other columns are ignored."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadforge.llm.tables import materialize, row_id, shuffled

BINS = 256
BITS = 4
SHINGLE = 5
#: steps of a walk that are tried before all filled bins are compared
STEPS = 8

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """64-bit hashes of all word shingles of a text."""
    words = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_WORD), F.lit(0))
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def at(w):
        # missing words are null and leave the hash as it is
        few = F.array(F.xxhash64(*[F.get(w, F.lit(k)) for k in range(width)]))
        many = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < width, few).otherwise(many)

    return _let(hashed, at)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _walk(bins: int) -> tuple[list[int], list[int], list[int]]:
    """Start, odd stride and its inverse of each bin's walk, by rule."""
    start, stride, inverse = [], [], []
    x = 0x9E3779B97F4A7C15
    for _ in range(bins):
        x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x ^= x >> 32
        s = (x >> 20) % bins | 1
        start.append(x % bins)
        stride.append(s)
        inverse.append(pow(s, -1, bins))
    return start, stride, inverse


def signature(hashes: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """``bins`` values of ``bits`` bits, empty bins filled; an empty array for
    no shingles."""
    shift = 64 - (bins.bit_length() - 1)
    start, stride, inverse = (F.array(*[F.lit(v) for v in a]) for a in _walk(bins))
    mask = bins - 1

    def bin_of(h):                                        # upper bits, in the order of signed sorting
        return F.shiftright(h, shift).cast("int") + bins // 2

    def fill(s):
        # smallest of each bin: sorted hashes of a bin stand together
        least = F.filter(s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(s, i - 1))))
        return _let(least, dense)

    def dense(least):
        def gap(n):
            return F.array_repeat(F.lit(None).cast("bigint"), n)

        spread = F.flatten(F.transform(least, lambda h, i: F.concat(
            gap(bin_of(h) - 1 - F.when(i == 0, -1).otherwise(bin_of(F.get(least, i - 1)))), F.array(h))))
        table = F.concat(spread, gap(mask - bin_of(F.element_at(least, -1))))
        return _let(F.transform(least, bin_of), lambda f: _let(
            table, lambda t: F.transform(t, lambda h, b: F.coalesce(h, borrowed(t, f, b)))))

    def borrowed(table, filled, b):
        a, s, inv = F.get(start, b), F.get(stride, b), F.get(inverse, b)
        steps = [F.get(table, (a + s * t).bitwiseAND(mask)) for t in range(STEPS)]
        # else the filled bin that the walk reaches first
        first = F.array_min(F.transform(filled, lambda f: ((f - a + bins) * inv).bitwiseAND(mask)))
        return F.coalesce(*steps, F.get(table, (a + s * first).bitwiseAND(mask)))

    low = (1 << bits) - 1
    packed = _let(F.sort_array(hashes), lambda s: F.transform(fill(s), lambda h: h.bitwiseAND(low).cast("int")))
    return F.when(F.size(hashes) == 0, F.array().cast("array<int>")).otherwise(packed)


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """The packed signature as lowercase hex; ``-`` for each digit where the
    text has no words."""
    digits = bins * bits // 4

    def packed(sig):
        if bits == 4:
            hexed = F.transform(sig, lambda v: F.substring(F.lit("0123456789abcdef"), v + 1, F.lit(1)))
        elif bits == 8:
            hexed = F.transform(sig, lambda v: F.lpad(F.lower(F.hex(v)), 2, "0"))
        else:
            raise ValueError("4 or 8 bits")
        return F.when(F.size(sig) == 0, F.lit("-" * digits)).otherwise(F.concat_ws("", hexed))

    return _let(signature(shingle_hashes(text), bins, bits), packed)


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1."""
    width = max(1, bits // 4)
    x, y = F.split(a, f"(?<=\\G.{{{width}}})"), F.split(b, f"(?<=\\G.{{{width}}})")
    same = F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    chance = 2.0 ** -bits
    share = (same / (F.length(a) / width) - chance) / (1 - chance)
    return F.when(a == b, F.lit(1.0)).when(a.startswith("-") | b.startswith("-"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), share))


def successors(docs: DataFrame) -> DataFrame:
    """``doc_id, next_id``: the next larger id, the first after the last.  Ids
    are range-partitioned once; a table with one row per partition links them."""
    ids = (docs.select("doc_id").where("doc_id is not null").distinct().repartitionByRange("doc_id")
           .select("doc_id", F.spark_partition_id().alias("part")))
    ids = materialize(ids)
    first = ids.groupBy("part").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("part")                                     # one row per partition
    first = first.withColumn("after", F.coalesce(F.lead("first").over(order), F.min("first").over(Window.partitionBy())))
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return (ids.withColumn("next", inside).join(first, "part")
            .select("doc_id", F.coalesce("next", "after").alias("next_id")))


def edited(text: Column, head: Column) -> Column:
    """The text with its last quarter (code points) replaced by ``head``."""
    n = F.length(text)
    return F.concat(F.substring(text, F.lit(1), n - F.floor(n / 4).cast("int")), head)


def report(docs: DataFrame) -> DataFrame:
    """Per document row: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``."""
    key = row_id("doc_id", "text")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # one fingerprint per text; without the text the table is small
    own = materialize(d.select("doc_id", key["a"].alias("a"), key["b"].alias("b"), F.length("text").alias("n"), fingerprint(F.col("text")).alias("fp")))
    # how much each document takes of the next one's text: one row per id
    need = own.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.floor(F.col("n") / 4).cast("int")).alias("need"))
    want = materialize(successors(own).join(shuffled(need), "doc_id").select(F.col("doc_id").alias("before"), "next_id", "need"))
    # both joins take the same two columns of the texts, dealt out by id: one exchange, read twice
    known = d.where("doc_id is not null")
    donor = known.join(shuffled(want), F.col("doc_id") == F.col("next_id")).select(
        "before", "next_id", F.substring("text", F.lit(1), F.col("need")).alias("head"))
    donor = donor.groupBy("before").agg(F.min("head").alias("head"), F.first("next_id").alias("next_id"))
    both = known.join(shuffled(donor), F.col("doc_id") == F.col("before")).select("doc_id", "text", "head", "next_id")
    alone = d.where("doc_id is null").select("doc_id", "text", F.col("text").alias("head"), F.lit(None).cast("bigint").alias("next_id"))
    edit = edited(F.col("text"), F.substring("head", F.lit(1), F.floor(F.length("text") / 4).cast("int")))
    both = both.unionByName(alone).select("doc_id", key["a"].alias("a"), key["b"].alias("b"), "next_id", F.length("text").cast("bigint").alias("n_chars"), edit.alias("edit"))
    both = both.select("doc_id", "a", "b", "next_id", "n_chars", F.sha2("edit", 256).alias("edited_sha256"),
                       fingerprint(F.col("edit")).alias("edited_fingerprint"))
    mine = own.groupBy("a", "b").agg(F.first("fp").alias("fingerprint"))
    after = own.where("doc_id is not null").groupBy(F.col("doc_id").alias("next_id")).agg(F.min("fp").alias("next_fp"))
    both = both.join(shuffled(mine), ["a", "b"]).join(shuffled(after), "next_id", "left")
    return both.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.coalesce("next_fp", "fingerprint")).alias("near_next"))
