"""Targets against step-by-step resharing; copies against plain systematic sampling."""
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from spreadforge.llm import mix


def reshared(sizes, weights=(5, 2, 1), most=3):
    """Share all sizes by weight; what is above ``most`` times a source's size is
    shared again among the others until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > most * sizes[s] * (1 + 1e-12)]
        if not over:
            target |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            free.discard(s)
        left = sum(sizes.values()) - sum(target.values())
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5, "d": 7, None: 3}, {"x": 10}, {"a": 0, "b": 10, "c": 0},
    {"s1": 3, "s10": 30, "s2": 300, "é": 7, "Z": 50, None: 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mix.targets(df).collect()}
    want = reshared(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], abs=1e-9)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def rows():
    out = [(i, "w " * (1 + (i * 7919) % 60), ("big", "mid", None)[0 if i % 3 else (1 if i % 2 else 2)]) for i in range(400)]
    return out + [(400, None, "mid"), (401, "", "mid"), (None, "no id here", "mid"), (5, out[5][1], out[5][2]), (403, "only", "tiny")]


def test_copies(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string").withColumn("copies", F.lit(9)).withColumn("size", F.lit("x"))
    size = {}
    for d, t, s in rows():
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = reshared(size)
    want = []
    for s in size:
        u = int(hashlib.md5(f"17:{'s' + s if s is not None else ''}".encode()).hexdigest()[:8], 16) / 2**32
        rate = target[s] / size[s]
        own = sorted([(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), (d or 0) % 64, d is not None, d or 0, hashlib.md5((t or "").encode()).hexdigest(), d)
                      for d, t, x in rows() if x == s])
        total = 0
        for k, r in enumerate(own):
            n = math.floor((k + 1) * rate + u) - math.floor(k * rate + u)
            want.append((r[5], r[0], s, n))
            total += n * r[0]
        assert abs(total - target[s]) <= max(r[0] for r in own)
    drawn = mix.copies(docs)
    got = [(r.doc_id, r["size"], r.source, r["copies"]) for r in drawn.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert max(r[3] for r in got) <= 3
    mixed = mix.mixed(docs)
    assert mixed.columns == docs.columns + ["copy"]
    assert mixed.count() == sum(r[3] for r in got)
    again = mix.mixed(docs)
    key = ["doc_id", "source", "copy"]
    assert sorted(map(str, mixed.select(*key).collect())) == sorted(map(str, again.select(*key).collect()))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix.copies(docs).count() == 0 and mix.mixed(docs).count() == 0
    wordless = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [r["copies"] * r["size"] for r in mix.copies(wordless).collect()] == [0, 0]
