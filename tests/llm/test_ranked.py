"""Ranked search against scoring every document."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from spreadforge.llm import ranked as R


def terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in found]


def brute(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for d, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                    for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


VOCABULARY = [f"w{i}" for i in range(400)] + ["Dé", "the", "of"]
WEIGHTS = [1 / (i + 1) for i in range(400)] + [1, 3, 3]


@pytest.mark.parametrize("segment_terms, k, round_terms", [(300, 10, 100_000), (20_000, 3, 40), (10**6, 10, 100_000)])
def test_small_tables(spark, segment_terms, k, round_terms):
    rnd = random.Random(segment_terms)

    def text(n):
        return rnd.choice([" ", ", ", "\n"]).join(rnd.choices(VOCABULARY, WEIGHTS, k=n))

    docs = [(i, text(rnd.randrange(60))) for i in range(900)] + [(None, "w1 w2 w3"), (7, ""), (8, None), (9, "!!"), (3, "W1. w2; c")] * 2
    docs += [(5000, "w5 " * 20000 + "w7")]
    items = [(i, text(rnd.randrange(1, 40))) for i in range(40)] + [(100, None), (101, ""), (102, "unheard"), (None, "w3 w9"), (4, "w300 w5"), (4, "w300 w5"), (103, "the of")]
    frame = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, item_id string").repartition(3)
    asked = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id int, text string, doc_id int")
    assert got(R.ranking(frame, asked, k, segment_terms, round_terms)) == brute(docs, items, k)
    assert R.ranking(frame, asked.where("false")).collect() == R.ranking(frame.where("false"), asked).collect() == []


def test_long_lists_are_skipped():
    """One segment in which a rare term decides: most postings of the frequent
    ones are never read, and the result is that of reading all."""
    rnd = random.Random(1)
    sizes = [rnd.randrange(5, 60) for _ in range(20_000)]
    hashes = [np.array([rnd.choice([1, 2, 3]) if rnd.random() < 0.3 else rnd.randrange(10, 3000) for _ in range(n)], np.uint64) for n in sizes]
    for i in range(0, 20_000, 900):
        hashes[i][:2] = 5
    row = R._segment(hashes, list(range(20_000)), sizes)
    segment = R.Segment(row, 20_000, sum(sizes))
    at = np.searchsorted(segment.terms, np.array([1, 2, 3, 5], np.uint64))
    weight = np.array([300, 310, 320, 6000])
    best = R.Best(10)
    read = segment.rank(at, weight, best)
    total = np.zeros(20_000, np.int64)
    for t, w in zip(at, weight):
        a, b = segment.starts[t], segment.starts[t + 1]
        total[segment.docs[a:b]] += w * R.impact(segment.freqs[a:b], segment.m[segment.docs[a:b]])
    order = np.lexsort((np.arange(20_000), -total))[:10]
    assert best.doc.tolist() == order.tolist() and best.score.tolist() == total[order].tolist()
    assert read < 0.02 * sum(segment.starts[at[:3] + 1] - segment.starts[at[:3]])


def test_whole_table(spark):
    from spreadforge.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(QUERIES["op11_ranked"][0](spark, sf)) == brute(docs, items)
