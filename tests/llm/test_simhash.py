"""SimHash fingerprints and groups against brute force."""
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from spreadforge.llm import simhash

SF = "/root/testdata/sf0.001"


def brute_fp(text, width=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, bits=3):
    """rows: list of (doc_id, fp) -> component id by row."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    fp = np.array([f for _, f in rows], np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= bits):
            a, b = find(i), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
    by = {}
    for i, (d, _) in enumerate(rows):
        by.setdefault(find(i), []).append(d)
    return [min([x for x in by[find(i)] if x is not None], default=None) for i in range(len(rows))]


def test_groups_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, brute_fp(r.text)) for r in docs.collect())
    want = dict(zip([d for d, _ in rows], zip([f for _, f in rows], brute_groups(rows))))
    got = {r.doc_id: (int(r.h, 16), r.component_id) for r in simhash.groups(docs)
           .select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("h"), "component_id").collect()}
    assert got == want
    assert any(c != d for d, (_, c) in want.items())


def test_links_with_split_groups(spark):
    """Clusters around few centres, so upper nodes split down several levels."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = {0}
    for _ in range(700):
        x = int(centres[rng.integers(3)])
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            x ^= 1 << int(b)
        fps.add(x)
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    want = brute_groups(rows)
    signed = [(i, int(np.uint64(f).view(np.int64))) for i, f in rows]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    for leaf in (8, 100, 5000):
        got = simhash.components(simhash.links(df.select("fp"), 3, leaf), "u", "v")
        root = {r.node: r.root for r in got.collect()}
        label = {}
        for (i, f), w in zip(signed, want):
            label.setdefault(root.get(f, f), set()).add(w)
        assert all(len(x) == 1 for x in label.values())
        assert len(label) == len(set(want))


def test_near_pairs_prune_nothing_within_distance():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 300, dtype=np.uint64)
    x = np.unique(np.concatenate([x, x ^ np.uint64(5), x ^ np.uint64(1 << 40)]))
    x = x[np.argsort(simhash.gray_rank(x))]
    i, j = simhash.near_pairs(x, None, 3)
    d = np.bitwise_count(x[:, None] ^ x[None, :])
    want = {(a, b) for a, b in zip(*np.nonzero(d <= 3)) if a < b}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  \n", "y"), (None, "one two three four", "z"), (5, "one two three four", "z"),
            (6, "single", "a"), (6, "single", "a"), (7, "pair of", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component_id", F.lit(1)).withColumn("row_a", F.lit(2))
    got = [(r.doc_id, r.component_id) for r in simhash.groups(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (3, 1), (None, 5), (5, 5), (6, 6), (6, 6), (7, 7)], key=str)
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == [1, 5, 6, 7]
    assert simhash.groups(docs.limit(0)).count() == 0


def test_descent_over_many_groups_and_sides():
    """Groups of one to hundreds of entries, with one side or two, in one
    stretch; all pairs within the distance and no others, whatever the sizes."""
    rng = np.random.default_rng(3)
    g, side, fp = [], [], []
    for k, n in enumerate([1, 2, 3, 40, 49, 1, 700, 300, 2, 260]):
        base = rng.integers(0, 2**63, dtype=np.uint64)
        x = np.unique(base ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)))
        two = rng.integers(0, 2, len(x)) if k % 3 == 2 or k == 7 else np.zeros(len(x), int) + (k == 4)
        x, two = x[np.lexsort((simhash.gray_rank(x), two))], np.sort(two)
        g += [k] * len(x)
        side += two.tolist()
        fp += x.tolist()
    g, side, fp = np.array(g), np.array(side), np.array(fp, np.uint64)
    got = [(int(a), int(b)) for i, j in simhash.descend(fp, g, side, 3) for a, b in zip(i, j)]
    want = set()
    for k in set(g.tolist()):
        at = np.flatnonzero(g == k)
        if (side[at] == 1).all():
            continue                                        # one side of a pair of nodes, nothing to compare it with
        two = side[at].any()
        d = np.bitwise_count(fp[at][:, None] ^ fp[at][None, :]) <= 3
        want |= {(int(at[a]), int(at[b])) for a, b in zip(*np.nonzero(d)) if a < b and (not two or side[at[a]] != side[at[b]])}
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 1000


def test_every_link_of_the_table_comes_from_descent(spark, monkeypatch):
    """All fingerprints of the table: the same components as brute force, and
    none without the descent, as no group takes another way."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    fps = np.unique(np.array([r.fp for r in simhash.fingerprints(docs).collect()], np.int64).view(np.uint64))
    # groups as the index makes them: equal 16-bit segments
    g = np.concatenate([(fps >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.int64) + (k << 16) for k in range(4)])
    x, side = np.tile(fps, 4), np.zeros(4 * len(fps), np.int64)

    def labels(u, v):
        return simhash.spanning(len(fps), np.searchsorted(fps, u), np.searchsorted(fps, v))

    want = brute_groups([(i, int(f)) for i, f in enumerate(fps)])
    assert labels(*simhash._leaf_links(g, side, x, 3)).tolist() == want
    assert any(i != w for i, w in enumerate(want))
    monkeypatch.setattr(simhash, "descend", lambda *a: iter(()))
    assert len(simhash._leaf_links(g, side, x, 3)[0]) == 0
