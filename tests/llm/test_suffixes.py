"""Repeated 200-byte strings against brute force."""
import hashlib
from collections import Counter

import pytest

from spreadforge.llm import suffixes


def brute(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            seen[b[p:p + length]] += 1
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b) + 1)
        reach = 0
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                for k in range(max(p, reach), p + length):
                    gone[k] = 1
                reach = p + length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_whole_table_at_production_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, 200)
    assert got(suffixes.report(docs)) == want
    assert any(r[2] for r in want) and any(not r[2] for r in want)


@pytest.mark.parametrize("length,stretch", [(18, 4), (18, 1), (40, 12)])
def test_small_alphabet(spark, length, stretch):
    """Periodic and heavily repeating texts, cut at many different places."""
    import random
    rnd = random.Random(length + stretch)
    base = "".join(rnd.choice("ab") for _ in range(300))
    rows = [(0, "ab" * 60), (1, "a" * 100), (2, ""), (3, None), (None, base[:90]), (4, base[:90]), (4, base[:90]), (5, "é" * 30 + base[5:50])]
    for k in range(40):
        a = rnd.randrange(250)
        rows.append((10 + k, "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(60))) + base[a:a + rnd.randrange(60)]
                     + "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(60)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffixes.report(docs, length, stretch)) == brute(rows, length)


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x" * 450, 5, "k", 1.0)], "doc_id long, text string, n_bytes int, d string, kept double")
    out = suffixes.dedup_substrings(docs).collect()
    assert out[0]["_n_bytes"] == 450 and out[0]["n_removed"] == 450 and out[0]["_kept"] == b"" and out[0]["d"] == "k"
    assert suffixes.report(docs.limit(0)).count() == 0
