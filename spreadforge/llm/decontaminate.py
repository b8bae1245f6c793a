"""Benchmark decontamination with a positional inverted index.

``build_index`` turns a corpus into index segments: one row holds, for a run of
whole documents (about ``SEGMENT_TOKENS`` tokens), the sorted terms, each
term's postings (token positions) and the documents' first positions.  Segments
are split by document, so a frequent term never gathers in one task, and a
query needs no shuffle of postings.

``search`` answers phrases: terms are ordered from the rarest in the whole
corpus; the rarest term's postings, shifted by its offset, are the candidate
starts, and each next term's offset-adjusted list is intersected with them.
With ``slop`` > 0 it also returns proximity matches: the words in order, within
a span of at most ``slop`` extra words.

Words are ``[0-9a-z]`` and all non-ASCII bytes after A-Z are lower-cased.
Defined results: a null or empty text has no words; repeated rows and null ids
give one result row each; an empty benchmark gives no hits; other columns are
ignored."""
from __future__ import annotations

import hashlib
import uuid
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadforge.llm import bytetext as B
from spreadforge.llm.tables import fresh, materialize, shuffled

WINDOW = 10
SEGMENT_TOKENS = 1_000_000
#: windows sent to the tasks at once; a larger benchmark is searched in several blocks
BLOCK_WINDOWS = 200_000

_WORD = np.zeros(256, bool)
_WORD[48:58] = True
_WORD[97:123] = True
_WORD[128:] = True

INDEX_SCHEMA = ("segment string, terms binary, starts binary, positions binary, "
                "doc_id array<bigint>, first binary")
MATCH_SCHEMA = "segment string, doc bigint, doc_id bigint, n_words bigint, hits binary, items array<bigint>, near array<bigint>"


def tokens_at(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, first byte, end and text number of every word of a run of texts."""
    low = B.lower_ascii(data)
    start, end, text = B.runs(_WORD[low], offsets)
    return B.range_hash(low, start, end), start, end, text


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word of a run of texts."""
    h, _, _, text = tokens_at(data, offsets)
    return h, text


def _segment(hashes: list[np.ndarray], ids: list, counts: list[int]) -> dict:
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    order = np.argsort(h, kind="stable")
    s = h[order]
    cut = B.group_slices(s)
    return {"segment": uuid.uuid4().hex, "terms": s[cut[:-1]].tobytes(), "starts": cut.astype(np.int32).tobytes(),
            "positions": order.astype(np.int32).tobytes(), "doc_id": ids,
            "first": np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]).astype(np.int32).tobytes()}


def build_index(docs: DataFrame, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Index segments of all documents (schema ``INDEX_SCHEMA``)."""
    schema = pa.schema([("segment", pa.string()), ("terms", pa.binary()), ("starts", pa.binary()),
                        ("positions", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("first", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, counts, size = [], [], [], 0

        def flush():
            return pa.RecordBatch.from_pylist([_segment(hashes, ids, counts)], schema)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, end, data, off in B.chunks(batch.column(1)):
                h, text = tokens(data, off)
                n = np.bincount(text, minlength=end - first)
                at = np.concatenate([[0], np.cumsum(n)])
                i = 0
                while i < end - first:                       # whole documents until the segment is full
                    j = int(np.searchsorted(at, at[i] + max(segment_tokens - size, 0), side="right")) - 1
                    if j <= i and size == 0:
                        j = i + 1
                    if j > i:
                        hashes.append(h[at[i]:at[j]])
                        ids += doc_ids[first + i:first + j]
                        counts += n[i:j].tolist()
                        size += int(at[j] - at[i])
                    if j < end - first or size >= segment_tokens or len(ids) >= 200_000:
                        yield flush()
                        hashes, ids, counts, size = [], [], [], 0
                    i = j
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(build, INDEX_SCHEMA)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows of the items' words: ``item_id``, ``words`` (term hashes)."""
    schema = pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.int64()))])

    def cut(batches):
        for batch in batches:
            item, words = [], []
            for first, end, data, off in B.chunks(batch.column(1)):
                h, text = tokens(data, off)
                at = np.searchsorted(text, np.arange(end - first + 1))
                for k in range(end - first):
                    w = h[at[k]:at[k + 1]].view(np.int64)
                    for s in range(max(len(w) - window, 0) + 1 if len(w) else 0):
                        item.append(batch.column(0)[first + k].as_py())
                        words.append(w[s:s + window])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(words, pa.list_(pa.int64()))], schema=schema)

    return (items.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
            .mapInArrow(cut, "item_id bigint, words array<bigint>").distinct())


def _arrays(row: dict) -> tuple[np.ndarray, ...]:
    return (np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["starts"], np.int32),
            np.frombuffer(row["positions"], np.int32), np.frombuffer(row["first"], np.int32))


def corpus_frequency(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """How often each of the given terms occurs in the whole corpus."""
    wanted = np.sort(terms)
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for batch in batches:
            for row in batch.to_pylist():
                have = np.frombuffer(row["terms"], np.uint64)
                n = np.diff(np.frombuffer(row["starts"], np.int32))
                at = np.searchsorted(have, wanted)
                ok = (at < len(have)) & (have[np.minimum(at, max(len(have) - 1, 0))] == wanted) if len(have) else np.zeros(len(wanted), bool)
                yield pa.RecordBatch.from_arrays([pa.array(wanted[ok].view(np.int64)), pa.array(n[at[ok]].astype(np.int64))], schema=schema)

    rows = index.select("terms", "starts").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {r["term"]: r["n"] for r in rows}        # at most one row for each term of the block


class _Block:
    """A bounded block of windows, terms ordered from the rarest."""

    def __init__(self, rows: list, frequency: dict[int, int]):
        self.items = np.array([r["item_id"] if r["item_id"] is not None else 0 for r in rows], np.int64)
        self.null = np.array([r["item_id"] is None for r in rows], bool)
        self.length = np.array([len(r["words"]) for r in rows], np.int32)
        width = int(self.length.max()) if len(rows) else 0
        self.term = np.zeros((len(rows), width), np.uint64)
        self.rank = np.zeros((len(rows), width), np.int32)
        for i, r in enumerate(rows):
            w = r["words"]
            self.term[i, :len(w)] = np.array(w, np.int64).view(np.uint64)
            self.rank[i, :len(w)] = sorted(range(len(w)), key=lambda k: (frequency.get(w[k], 0), k))


def _phrase(block: _Block, terms, starts, positions, slop: int):
    """Matches in one segment: window number, first and last position."""
    key = np.repeat(np.arange(len(terms), dtype=np.int64), np.diff(starts)) << 32 | positions
    number = np.searchsorted(terms, block.term.ravel()).reshape(block.term.shape)
    there = (number < len(terms)) & (terms[np.minimum(number, len(terms) - 1)] == block.term)
    there |= np.arange(block.term.shape[1])[None, :] >= block.length[:, None]
    live = np.flatnonzero(there.all(1))
    rare = block.rank[live, 0]
    t = number[live, rare]
    n = starts[t + 1] - starts[t]
    win = np.repeat(live, n)
    pos = positions[np.repeat(starts[t] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))].astype(np.int64)
    if slop == 0:
        begin = pos - np.repeat(rare, n)
        for k in range(1, block.term.shape[1]):
            todo = block.length[win] > k
            off = block.rank[win, np.minimum(k, block.length[win] - 1)]
            want = number[win, off].astype(np.int64) << 32 | np.maximum(begin + off, 0)
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            keep = ((key[at] == want) & (begin >= 0)) | ~todo
            win, begin = win[keep], begin[keep]
        ok = begin >= 0
        return win[ok], begin[ok], begin[ok] + block.length[win[ok]] - 1
    # in order, nearest occurrences outwards from the rarest term
    at0 = np.repeat(rare, n)
    lo, hi = pos.copy(), pos.copy()
    for step in range(1, block.term.shape[1]):
        right = at0 + step < block.length[win]
        k = np.minimum(at0 + step, block.length[win] - 1)
        tt = number[win, k].astype(np.int64)
        at = np.searchsorted(key, tt << 32 | (hi + 1))
        at_ok = np.minimum(at, len(key) - 1)
        found = (at < len(key)) & (key[at_ok] >> 32 == tt)
        hi = np.where(right & found, key[at_ok] & 0xFFFFFFFF, hi)
        keep = ~right | found
        left = at0 - step >= 0
        k = np.maximum(at0 - step, 0)
        tt = number[win, k].astype(np.int64)
        at = np.searchsorted(key, tt << 32 | lo) - 1
        at_ok = np.maximum(at, 0)
        found = (at >= 0) & (key[at_ok] >> 32 == tt)
        lo = np.where(left & found, key[at_ok] & 0xFFFFFFFF, lo)
        keep &= (~left | found) & (hi - lo < block.length[win] + slop)
        win, at0, lo, hi = win[keep], at0[keep], lo[keep], hi[keep]
    return win, lo, hi


def search(index: DataFrame, windows: DataFrame, slop: int = 0, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per indexed document: its words, the covered token positions
    (``hits``: int32 positions within the document) and the items found
    (``near``: items with a proximity match, ``slop`` > 0)."""
    n_blocks = max(1, -(-windows.count() // block_windows))
    blocks = windows.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(n_blocks)))
    found = None
    for b in range(n_blocks):
        rows = blocks.where(F.col("block") == b).select("item_id", "words").collect()   # about block_windows rows
        terms = np.unique(np.array([w for r in rows for w in r["words"]], np.int64)).view(np.uint64)
        block = _Block(rows, corpus_frequency(index, terms))
        part = _search_block(index, block, slop)
        found = part if found is None else found.unionByName(part)
    if n_blocks == 1:
        return found
    return found.groupBy("segment", "doc").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        _union_hits(F.collect_list("hits")).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def _union_hits(parts):
    @F.udf("binary")
    def union(hits):
        return np.unique(np.concatenate([np.frombuffer(h, np.int32) for h in hits])).astype(np.int32).tobytes()
    return union(parts)


def _search_block(index: DataFrame, block: _Block, slop: int) -> DataFrame:
    schema = pa.schema([("segment", pa.string()), ("doc", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
                        ("hits", pa.binary()), ("items", pa.list_(pa.int64())), ("near", pa.list_(pa.int64()))])

    def by_doc(win, doc, n_docs):
        pair = np.unique(np.stack([doc, win], 1), axis=0) if len(doc) else np.empty((0, 2), np.int64)
        out = [[] for _ in range(n_docs)]
        for d, w in pair.tolist():
            item = None if block.null[w] else int(block.items[w])
            if item not in out[d]:
                out[d].append(item)
        return out

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                terms, starts, positions, first = _arrays(row)
                n_docs, n_tokens = len(row["doc_id"]), int(first[-1])
                cover = np.zeros(n_tokens + 1, np.int32)
                items, near = [[] for _ in range(n_docs)], [[] for _ in range(n_docs)]
                if len(terms) and len(block.items):
                    for how, into in ((0, True), *(((slop, False),) if slop else ())):
                        win, lo, hi = _phrase(block, terms, starts, positions, how)
                        doc = np.searchsorted(first, lo, side="right") - 1
                        ok = hi < first[np.minimum(doc + 1, n_docs)]
                        win, lo, hi, doc = win[ok], lo[ok], hi[ok], doc[ok]
                        if into:
                            np.add.at(cover, lo, 1)
                            np.add.at(cover, hi + 1, -1)
                            items = by_doc(win, doc, n_docs)
                        else:
                            near = by_doc(win, doc, n_docs)
                hit = np.flatnonzero(np.cumsum(cover)[:n_tokens] > 0)
                at = np.searchsorted(hit, first)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["segment"]] * n_docs, pa.string()), pa.array(np.arange(n_docs)),
                    pa.array(row["doc_id"], pa.int64()), pa.array(np.diff(first).astype(np.int64)),
                    pa.array([(hit[at[i]:at[i + 1]] - first[i]).astype(np.int32).tobytes() for i in range(n_docs)], pa.binary()),
                    pa.array(items, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.int64()))], schema=schema)

    return index.mapInArrow(run, MATCH_SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0,
                  segment_tokens: int = SEGMENT_TOKENS, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document row: ``doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated``, the ``items`` themselves, and ``near_items`` (proximity
    matches within ``slop``).  An item without an id is searched and counts,
    and is listed as an empty string."""
    index = materialize(build_index(docs, segment_tokens))
    windows = materialize(item_windows(benchmark, window))
    found = search(index, windows, slop, block_windows)
    ids = F.concat_ws(",", F.sort_array(F.transform("items", lambda x: F.coalesce(x.cast("string"), F.lit("")))))
    n_hit = (F.length("hits") / 4).cast("bigint")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "items",
                        F.col("near").alias("near_items"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a benchmark occurrence, all columns kept.  The
    decision depends on the text alone, so it is keyed by a hash of the text
    and repeated or unnumbered rows need no care."""
    key = fresh(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64("text", F.length("text")))
    texts = keyed.select(F.col(key).alias("doc_id"), "text")
    bad = materialize(contamination(texts, benchmark, **options).where("contaminated").select(F.col("doc_id").alias(key)).distinct())
    return keyed.join(shuffled(bad), key, "left_anti").select(*docs.columns)
