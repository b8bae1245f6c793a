"""Ranked lexical search: a hybrid of term-at-a-time and document-at-a-time.

``build_index`` turns documents into index segments: one row holds, for a run of
whole documents, the sorted terms, each term's postings (document, frequency) and,
for terms of more than ``BLOCK`` postings, the largest frequency and the shortest
document of every block of them.  Segments are split by document: a frequent
term never gathers in one task and no posting is shuffled.

``search`` ranks the documents of each item in every segment.  Postings of the
item's short lists are summed, term at a time, into accumulators.  From then on the
accumulators are one sorted iterator with a known bound, and take part beside the
long lists in document-at-a-time evaluation: lists whose bounds together stay
below the score of the current k-th document propose no documents, and in the rest
documents are given up, and list blocks passed by, once the score so far plus the
bounds of what is left stays below it.  A task carries its k-th scores from
segment to segment; its best k of each item go on.

Scores are integers (``impact``).  Terms are ``[0-9a-z]`` and all non-ASCII bytes
after A-Z are lower-cased; they are held as 64-bit digests.

Defined results: a null or empty text has no terms and is not ranked; an item
without terms, or without documents, has no rows; repeated document rows are each
ranked; equal scores are ordered by document id, null last; item rows equal in
id and text are one item, rows equal in id alone are ranked one by one; other
columns are ignored."""
from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadforge.llm import bytetext as B
from spreadforge.llm.decontaminate import tokens
from spreadforge.llm.tables import materialize

SEGMENT_TERMS = 2_000_000
#: postings in a block of a long list, documents evaluated together
BLOCK, SPAN = 64, 2048
#: distinct terms of the items that are searched at once; more items are searched in several rounds
ROUND_TERMS = 500_000

INDEX_SCHEMA = ("doc_id array<bigint>, size binary, terms binary, starts binary, docs binary, freqs binary, "
                "long binary, block_freq binary, block_size binary, n_docs bigint, n_terms bigint")
_INDEX = pa.schema([("doc_id", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("size", "terms", "starts", "docs", "freqs", "long", "block_freq", "block_size")),
                    ("n_docs", pa.int64()), ("n_terms", pa.int64())])
BEST_SCHEMA = "item bigint, doc_id bigint, score bigint"
_BEST = pa.schema([(c, pa.int64()) for c in ("item", "doc_id", "score")])


def _small(x: np.ndarray) -> bytes:
    """As unsigned integers of the fewest bytes that hold all values."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}") if n else np.empty(0, np.uint8)


def _segment(hashes: list[np.ndarray], ids: list, sizes: list[int]) -> dict:
    h, size = np.concatenate(hashes), np.array(sizes, np.int64)
    doc = np.repeat(np.arange(len(sizes)), size)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.empty(0, np.int64)
    freq, doc, term = np.diff(np.r_[first, len(h)]), doc[first], h[first]
    starts = B.group_slices(term)
    long = np.flatnonzero(np.diff(starts) > BLOCK)
    blocks = -(-np.diff(starts)[long] // BLOCK)
    at = np.repeat(starts[long] - BLOCK * (np.cumsum(blocks) - blocks), blocks) + BLOCK * np.arange(int(blocks.sum()))
    end = np.minimum(at + BLOCK, np.repeat(starts[long + 1], blocks))
    cut = np.stack([at, end], 1).ravel()                     # a block and what lies behind it
    cut = cut[:-1] if len(cut) and cut[-1] == len(freq) else cut
    most = np.maximum.reduceat(freq, cut)[::2] if len(cut) else np.empty(0, np.int64)
    least = np.minimum.reduceat(size[doc], cut)[::2] if len(cut) else np.empty(0, np.int64)
    return {"doc_id": ids, "size": _small(size), "terms": term[starts[:-1]].tobytes(), "starts": starts.astype(np.int32).tobytes(),
            "docs": _small(doc), "freqs": _small(freq), "long": long.astype(np.int32).tobytes(), "block_freq": _small(most),
            "block_size": _small(least), "n_docs": int((size > 0).sum()), "n_terms": int(size.sum())}


def build_index(docs: DataFrame, segment_terms: int = SEGMENT_TERMS) -> DataFrame:
    """Index segments of all documents (schema ``INDEX_SCHEMA``), each of whole
    documents of about ``segment_terms`` terms."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, sizes, full = [], [], [], 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, end, data, off in B.chunks(batch.column(1)):
                h, text = tokens(data, off)
                n = np.bincount(text, minlength=end - first)
                at = np.concatenate([[0], np.cumsum(n)])
                i = 0
                while i < end - first:
                    j = min(max(int(np.searchsorted(at, at[i] + segment_terms - full, side="right")) - 1, i + (full == 0)), end - first)
                    if j > i:
                        hashes.append(h[at[i]:at[j]])
                        ids += doc_ids[first + i:first + j]
                        sizes += n[i:j].tolist()
                        full += int(at[j] - at[i])
                    if j < end - first or full >= segment_terms or len(ids) >= 200_000:
                        yield pa.RecordBatch.from_pylist([_segment(hashes, ids, sizes)], _INDEX)
                        hashes, ids, sizes, full = [], [], [], 0
                    i = j
        if ids:
            yield pa.RecordBatch.from_pylist([_segment(hashes, ids, sizes)], _INDEX)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(build, INDEX_SCHEMA)


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, terms`` (distinct digests) of the items that have any."""
    schema = pa.schema([("item_id", pa.int64()), ("key", pa.int64()), ("terms", pa.list_(pa.int64()))])

    def cut(batches):
        for batch in batches:
            for first, end, data, off in B.chunks(batch.column(2)):
                h, text = tokens(data, off)
                at = np.searchsorted(text, np.arange(end - first + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), pa.array(
                    [np.unique(h[a:b]).view(np.int64) for a, b in zip(at[:-1], at[1:])], pa.list_(pa.int64()))], schema=schema)

    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.xxhash64("text", F.length("text")).alias("key"), "text")
    return rows.mapInArrow(cut, "item_id bigint, key bigint, terms array<bigint>").where(F.size("terms") > 0).distinct()


def document_frequency(index: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the given terms those that occur, and in how many documents.  At most
    one row for each term of the round comes to the driver."""
    def count(batches):
        for batch in batches:
            for data, starts in zip(batch.column(0), batch.column(1)):
                have, n = np.frombuffer(data.as_py(), np.uint64), np.diff(np.frombuffer(starts.as_py(), np.int32))
                at = np.searchsorted(have, terms)
                ok = at < len(have)
                ok[ok] = have[at[ok]] == terms[ok]
                yield pa.RecordBatch.from_arrays([pa.array(terms[ok].view(np.int64)), pa.array(n[at[ok]].astype(np.int64))],
                                                 schema=pa.schema([("term", pa.int64()), ("df", pa.int64())]))

    rows = index.select("terms", "starts").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    term, df = (np.array(rows.column(k).to_pylist(), np.int64) for k in range(2))
    order = np.argsort(term.view(np.uint64))
    return term.view(np.uint64)[order], df[order]


class Best:
    """The best k documents of one item so far: (score, id), null ids last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.doc, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = np.concatenate([self.score, score]), np.concatenate([self.doc, doc]), np.concatenate([self.null, null])
        order = np.lexsort((doc, null, -score))[:self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]
        if len(order) == self.k:
            self.least = max(1, int(self.score[-1]))


def impact(freq: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one occurrence list entry is worth before its term's weight; rises
    with the frequency and falls with the document's length."""
    return (1_000_000_000 * freq.astype(np.int64)) // (1_000 * freq.astype(np.int64) + 8 * m)


class Segment:
    """One index row, ready for the items of a round."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.ids = row["doc_id"]
        self.null = np.array([i is None for i in self.ids], bool)
        self.id = np.array([0 if i is None else i for i in self.ids], np.int64)
        self.terms, self.starts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["starts"], np.int32)
        n = int(self.starts[-1])
        self.docs, self.freqs = _wide(row["docs"], n), _wide(row["freqs"], n)
        self.m = self._m(_wide(row["size"], len(self.ids)), n_docs, n_terms)
        self.long = np.frombuffer(row["long"], np.int32)
        blocks = -(-np.diff(self.starts)[self.long] // BLOCK)
        self.first_block = np.concatenate([[0], np.cumsum(blocks)])
        total = int(self.first_block[-1])
        self.block_impact = impact(_wide(row["block_freq"], total), self._m(_wide(row["block_size"], total), n_docs, n_terms))

    @staticmethod
    def _m(size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
        return 10 + (90 * size.astype(np.int64) * n_docs) // max(n_terms, 1)

    def rank(self, term: np.ndarray, weight: np.ndarray, best: Best) -> int:
        """Add this segment's documents to ``best``; ``term``: numbers of the
        item's terms that the segment has.  Returns how many postings of long
        lists were read."""
        begin, end = self.starts[term].astype(np.int64), self.starts[term + 1].astype(np.int64)
        order = np.argsort(end - begin, kind="stable")
        begin, end, weight, term = begin[order], end[order], weight[order], term[order]
        # short lists: up to a block each, as long as all of them hold no more than an eighth of the documents' number
        short = (end - begin <= BLOCK) | (np.cumsum(end - begin) <= len(self.id) // 8)
        total = np.zeros(len(self.id), np.int64)
        for a, b, w in zip(begin[short].tolist(), end[short].tolist(), weight[short].tolist()):
            d = self.docs[a:b]
            total[d] += w * impact(self.freqs[a:b], self.m[d])
        summed = np.flatnonzero(total)
        if len(summed) >= best.k:
            best.least = max(best.least, int(np.partition(total[summed], -best.k)[-best.k]))
        if short.all():
            keep = summed[total[summed] >= best.least]
            best.add(total[keep], self.id[keep], self.null[keep])
            return 0
        lists = []
        for a, b, w, t in zip(begin[~short].tolist(), end[~short].tolist(), weight[~short].tolist(), term[~short].tolist()):
            at = int(np.searchsorted(self.long, t))
            bounds = w * self.block_impact[self.first_block[at]:self.first_block[at + 1]]
            docs = self.docs[a:b]
            lists.append((int(bounds.max()), docs, self.freqs[a:b], w, bounds, docs[BLOCK - 1::BLOCK]))
        lists.sort(key=lambda x: -x[0])
        bound = np.array([x[0] for x in lists], np.int64)
        rest = np.r_[np.cumsum(bound[::-1])[::-1], 0]        # bounds of a list and all after it
        of_sums = int(total[summed].max()) if len(summed) else 0
        read = 0
        for lo in range(0, len(self.id), SPAN):
            hi = min(lo + SPAN, len(self.id))
            # the weakest iterators, the accumulators among them, that can't reach the k-th score by themselves propose nothing
            weak, spent = set(), 0
            for value, k in sorted([(of_sums, -1), *((int(v), k) for k, v in enumerate(bound))]):
                spent += value
                if spent >= best.least:
                    break
                weak.add(k)
            cand = np.zeros(hi - lo, bool)
            if -1 not in weak:
                cand[total[lo:hi] > 0] = True
            for k, (_, docs, *_) in enumerate(lists):
                if k not in weak:
                    a, b = np.searchsorted(docs, [lo, hi])
                    cand[docs[a:b].astype(np.int64) - lo] = True
                    read += int(b - a)
            cand = np.flatnonzero(cand) + lo
            score = total[cand]
            for k, (_, docs, freqs, w, bounds, block_end) in enumerate(lists):
                keep = score + rest[k] >= best.least
                if not keep.all():
                    cand, score = cand[keep], score[keep]
                if not len(cand):
                    break
                block = np.searchsorted(block_end, cand)     # skip to the block that may hold the document
                at_most = np.where(block < len(bounds), bounds[np.minimum(block, len(bounds) - 1)], 0)
                keep = score + at_most + rest[k + 1] >= best.least
                if not keep.all():
                    cand, score = cand[keep], score[keep]
                at = np.minimum(np.searchsorted(docs, cand), len(docs) - 1)
                hit = docs[at] == cand
                read += int(hit.sum())
                score[hit] += w * impact(freqs[at[hit]], self.m[cand[hit]])
            keep = score >= best.least
            best.add(score[keep], self.id[cand[keep]], self.null[cand[keep]])
        return read


def search(index: DataFrame, items: DataFrame, k: int = 10, round_terms: int = ROUND_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best ``k`` documents of each item.
    ``items``: rows of ``item_terms``."""
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).head()
    size = items.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).head()[0]
    rounds = max(1, -(-int(size) // round_terms))
    dealt = items.withColumn("round", F.pmod(F.xxhash64("item_id", "key"), F.lit(rounds)))
    found = None
    for r in range(rounds):
        # about round_terms terms; the order is that of the rows' digests, alike at every run
        rows = dealt.where(F.col("round") == r).select("item_id", "key", "terms").orderBy("item_id", "key").collect()
        part = _search_round(index, rows, int(n_docs), int(n_terms), k, r)
        found = part if found is None else found.unionByName(part)
    # two steps, so that no task gathers all tasks' rows of one item
    by = ["round", "item"]
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    spread = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    some = spread.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "bucket").orderBy(*order))).where(F.col("rank") <= k)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return some.select("item_id", "rank", "doc_id", "score")


def _search_round(index: DataFrame, rows: list, n_docs: int, n_terms: int, k: int, number: int) -> DataFrame:
    terms = [np.array(r["terms"], np.int64).view(np.uint64) for r in rows]
    every = np.unique(np.concatenate(terms)) if terms else np.empty(0, np.uint64)
    have, df = document_frequency(index, every)
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    # what occurs nowhere, or weighs nothing, adds nothing
    have, weight = have[weight > 0], weight[weight > 0]
    wanted = []
    for t in terms:
        at = np.searchsorted(have, t)
        ok = at < len(have)
        ok[ok] = have[at[ok]] == t[ok]
        wanted.append(at[ok])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in wanted]
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment(batch.slice(i, 1).to_pylist()[0], n_docs, n_terms)
                if not len(segment.terms):
                    continue
                at = np.minimum(np.searchsorted(segment.terms, have), len(segment.terms) - 1)
                there = segment.terms[at] == have
                for item, t in enumerate(wanted):
                    mine = t[there[t]]
                    if len(mine):
                        segment.rank(at[mine], weight[mine], best[item])
        out = [(i, None if null else int(d), int(s)) for i, b in enumerate(best) for s, d, null in zip(b.score, b.doc, b.null)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3, schema=_BEST)

    columns = ["doc_id", "size", "terms", "starts", "docs", "freqs", "long", "block_freq", "block_size"]
    found = index.select(*columns).mapInArrow(run, BEST_SCHEMA)
    spark = index.sparkSession
    names = spark.createDataFrame([(number, i, r["item_id"]) for i, r in enumerate(rows)], "round int, item bigint, item_id bigint")
    # one row for each item of the round, whose number is bounded as its terms are
    return found.join(F.broadcast(names), "item")


def ranking(docs: DataFrame, items: DataFrame, k: int = 10, segment_terms: int = SEGMENT_TERMS, round_terms: int = ROUND_TERMS) -> DataFrame:
    """The best ``k`` documents of every item: ``item_id, rank, doc_id, score``."""
    return search(materialize(build_index(docs, segment_terms)), materialize(item_terms(items)), k, round_terms)
