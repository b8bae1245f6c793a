"""Phrase and proximity search against brute force."""
import hashlib
import random
import re

from pyspark.sql import functions as F

from spreadforge.llm import decontaminate as D

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    grams = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[s:s + window]), set()).add(i)
    sizes = {len(g) for g in grams}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                got = grams.get(tuple(w[s:s + n]))
                if got:
                    hit |= set(range(s, s + n))
                    found |= got
        ids = ",".join(sorted("" if i is None else str(i) for i in found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def test_small_vocabulary_small_segments_and_blocks(spark):
    rnd = random.Random(4)
    vocabulary = ["a", "b", "c", "Dé", "ee", "f1", "g"]

    def text(n):
        return rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocabulary) for _ in range(n))

    docs = [(i, text(rnd.randrange(40))) for i in range(50)] + [(None, "a b c"), (7, ""), (8, None), (9, "!!"), (3, "A. B; c"), (3, "A. B; c")]
    items = [(i, text(rnd.randrange(1, 7))) for i in range(12)] + [(None, "f1 ee f1"), (5, None), (6, "..."), (4, "a b c"), (4, "a b c")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("segment", F.lit("x")).withColumn("terms", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("x"))
    want = brute(docs, items, 4)
    assert got(D.contamination(d, b, window=4, segment_tokens=30)) == want
    assert got(D.contamination(d, b, window=4, block_windows=5)) == want
    assert any(r[5] for r in want) and any(not r[5] for r in want)
    clean = D.clean_documents(d, b, window=4)
    assert clean.columns == d.columns
    keep = sorted(((i, t) for i, t in docs if not brute([(i, t)], items, 4)[0][5]), key=str)
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == keep


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert got(D.contamination(d, b.limit(0)))[0][:4] == (1, 2, 0, 0)
    assert D.contamination(d.limit(0), b).count() == 0


def test_proximity(spark):
    """In order, at most ``slop`` words more than the phrase."""
    docs = [(1, "x one two y three z"), (2, "one y y two three"), (3, "three two one"), (4, "one two three"), (5, "one one two q two three")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(9, "one two three")], "item_id long, text string")
    near = {s: {r.doc_id for r in D.contamination(d, b, slop=s).collect() if r.near_items} for s in (1, 2)}
    assert near == {1: {1, 4}, 2: {1, 2, 4, 5}}
    assert {r.doc_id for r in D.contamination(d, b, slop=2).where("contaminated").collect()} == {4}


def test_long_text(spark):
    text = " ".join(f"w{i % 977}" for i in range(200_000))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100, 112)))], "item_id long, text string")
    r = D.contamination(d, b, segment_tokens=1000).first()
    assert r.n_words == 200_000 and r.n_hit == 12 * (200_000 // 977 + (200_000 % 977 >= 112))
