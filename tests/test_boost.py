"""Boosted trees: by hand, against brute force, and their training loss."""
import numpy as np
import pytest

from spreadforge.operators import boost as B


def frame(spark, rows):
    return spark.createDataFrame(rows, "idx long, group int, train boolean, y double, size double, x array<double>")


def test_one_split_by_hand(spark):
    rows = [(i, 0, True, float(i >= 40), 10.0 * (i >= 40), [float(i >= 40), 1.0]) for i in range(80)]
    rows += [(100, 0, False, 1.0, 10.0, [1.0, 1.0]), (101, 0, False, 0.0, 0.0, [0.0, 1.0])]
    models = [B.Model(0, "up", [0, 1]), B.Model(0, "size", [0, 1])]
    s = B.Settings(rounds=1, depth=1, columns=1.0, rate=0.03, l1=0.1, l2=1.0, min_rows=30)
    got = {r.idx: r for r in B.predictions(B.fit(B.binned_rows(frame(spark, rows), 2, 8), models, s), models).where("NOT train").collect()}
    # gradients 0.5 and -0.5, hessians 0.25; 40 rows a side
    leaf = 0.03 * (40 * 0.5 - 0.1) / (40 * 0.25 + 1.0)
    assert got[100].up == pytest.approx(1 / (1 + np.exp(-leaf))) and got[101].up == pytest.approx(1 / (1 + np.exp(leaf)))
    # from the mean 5: gradients 5 and -5, hessians 1
    leaf = 0.03 * (40 * 5 - 0.1) / (40 + 1.0)
    assert got[100].value == pytest.approx(5 + leaf) and got[101].value == pytest.approx(5 - leaf)
    assert models[0].split_counts(2).tolist() == [1, 0]


def test_best_split_is_the_best_of_all():
    rnd = np.random.default_rng(5)
    s = B.Settings(min_rows=4, l1=0.3, l2=2.0)
    for _ in range(50):
        sums = np.stack([rnd.normal(size=(5, 6)), rnd.random((5, 6)), rnd.integers(0, 6, (5, 6))], 2)
        sums[1:] *= sums[:1].sum(1, keepdims=True) / sums[1:].sum(1, keepdims=True)       # every feature sees the same rows
        best = None
        for f in range(5):
            for b in range(5):
                left, right, total = sums[f, :b + 1].sum(0), sums[f, b + 1:].sum(0), sums[0].sum(0)
                worth = [np.sign(g) * max(abs(g) - 0.3, 0) for g in (left[0], right[0], total[0])]
                gain = worth[0] ** 2 / (left[1] + 2) + worth[1] ** 2 / (right[1] + 2) - worth[2] ** 2 / (total[1] + 2)
                if left[2] >= 4 and right[2] >= 4 and gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                    best = gain, f, b
        got = B.best_split(sums, s)
        assert (got is None) == (best is None)
        if best:
            assert got[2] == pytest.approx(best[0]) and got[:2] == best[1:]


def test_the_leaf_of_the_largest_gain_goes_first():
    splits = {1: (5.0,), 2: (1.0,), 3: (4.0,), 6: (0.5,), 7: (3.0,), 4: (9.0,)}
    assert B.leaf_first(splits, 4) == {1, 3, 7}
    assert B.leaf_first(splits, 6) == {1, 3, 7, 2, 4}
    assert B.leaf_first(splits, 63) == set(splits) and B.leaf_first({}, 63) == set()


def test_pool_of_models_learns_every_round_and_equals_each_model_alone(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for g in range(3):
        for i in range(400):
            x = rnd.normal(size=4)
            size = x[g] * 2 + (x[3] > 0) + 0.2 * rnd.normal()
            x = [None if rnd.random() < 0.1 else float(v) for v in x]
            rows.append((i, g, i < 320, float(size > 0), float(size), x))
    binned = B.binned_rows(frame(spark, rows), 4, 16)
    s = B.Settings(rounds=12, rate=0.2, leaves=6, depth=3, min_rows=10)

    def models():
        return [B.Model(g, t, [0, 1, 2, 3]) for g in range(3) for t in ("up", "size")]

    pool = models()
    state = B.fit(binned, pool, s)
    kept = binned.orderBy("group", "idx").collect()
    for m in pool:
        mine = [r for r in kept if r.group == m.group and r.train]
        x = np.frombuffer(b"".join(bytes(r.x) for r in mine), np.uint8).reshape(len(mine), 4)
        y, size = np.array([r.y for r in mine]), np.array([r["size"] for r in mine])
        losses = []
        for k in range(s.rounds + 1):
            score = m.start + B.apply_trees(m.trees[:k], x)
            losses.append(np.mean(np.log1p(np.exp(-(2 * y - 1) * score))) if m.target == "up" else np.mean((score - size) ** 2))
        assert all(b < a for a, b in zip(losses, losses[1:])) and losses[-1] < 0.6 * losses[0]
        assert all((t["feature"] >= 0).sum() <= 5 for t in m.trees)
    # scores kept beside the rows are those of the trees
    for r in B.predictions(state, pool).collect():
        x = np.frombuffer(bytes(next(k.x for k in kept if (k.group, k.idx) == (r.group, r.idx))), np.uint8)[None, :]
        size = next(m for m in pool if (m.group, m.target) == (r.group, "size"))
        assert r.value == pytest.approx(size.start + B.apply_trees(size.trees, x)[0])


def test_a_model_does_not_depend_on_its_pool(spark):
    rnd = np.random.default_rng(9)
    rows = [(i, g, True, float(rnd.random() < 0.5 + 0.3 * np.sign(x[g])), 0.0, [float(v) for v in x])
            for g in range(2) for i in range(200) for x in [rnd.normal(size=6)]]
    binned, s = B.binned_rows(frame(spark, rows), 6, 8), B.Settings(rounds=3, min_rows=5, columns=0.5)
    alone, pool = [B.Model(1, "up", list(range(6)), 77)], [B.Model(0, "up", list(range(6)), 5), B.Model(1, "up", list(range(6)), 77)]
    B.fit(binned, alone, s)
    B.fit(binned, pool, s)
    for a, b in zip(alone[0].trees, pool[1].trees):
        assert a["feature"].tolist() == b["feature"].tolist() and a["bin"].tolist() == b["bin"].tolist()
        assert a["value"] == pytest.approx(b["value"])


def test_bins_and_medians(spark):
    rows = [(i, 0, True, 0.0, 0.0, [float(i), None, float("nan") if i % 2 else 7.0]) for i in range(101)]
    rows += [(200, 0, False, 0.0, 0.0, [None, 1.0, None]), (201, 0, False, 0.0, 0.0, [-5.0, None, 8.0]), (202, 0, False, 0.0, 0.0, [1e9, None, 7.0])]
    got = {r.idx: list(bytes(r.x)) for r in B.binned_rows(frame(spark, rows), 3, 4).collect()}
    assert got[200][0] == got[50][0] and got[201][0] == 0 and got[202][0] == 3      # the median's bin, below all cuts, above all cuts
    assert got[200][2] == got[0][2] == got[202][2] == 0 and got[201][2] == 1
    assert {v[1] for v in got.values()} <= {0, 1}


def test_folds_by_hand(spark):
    """Ranges of a transition's usable rows: fold k tests the k-th last sixth
    and trains on all before it."""
    from pyspark.sql import functions as F

    from spreadforge.config import ModelConfig, TransitionSpec
    from spreadforge.operators import models as M
    wide = spark.range(700).select(F.col("id").alias("idx"), F.expr("timestamp'2024-01-01' + make_interval(0,0,0,0,0,30*id)").alias("ts"),
                                   F.when(F.col("id") % 7 == 0, 0.0).otherwise(F.sin("id") + F.col("id") % 3 - 1).alias("spr_IDA1_DAM"),
                                   (F.col("id") % 3).cast("double").alias("PriceDAM"), F.sin("id").alias("wave_DAM"))
    spec = TransitionSpec("DAM→IDA1", "spr_IDA1_DAM", ("_DAM", "PRICEDAM"), ())
    cfg = ModelConfig(max_iter=3, burn_in=10, cv_splits=5, step_size=0.5)
    study = M.fit_all(wide, [spec], cfg, folds=True)
    usable = [i for i in range(10, 700) if i % 7]
    n, m = len(usable), len(usable) // 6
    assert sorted((r.fold, r.n_test) for r in study.folds.collect()) == [(k, m) for k in range(5)]
    test = [r.idx for r in study.fits[0].scored.orderBy("idx").collect()]
    assert test == usable[int(n * 0.8):]
    assert all(r.accuracy > 0.8 for r in study.folds.collect())
    assert study.fits[0].losses["log_loss"] < 0.7 * study.fits[0].losses["log_loss_of_share"]


def test_exact_medians_and_few_values_exchanged(spark):
    """Medians of each group's training rows, from even and odd numbers of rows, heavy values and missing ones."""
    rnd = np.random.default_rng(7)
    rows = []
    for g, n in ((0, 1001), (3, 500), (5, 1)):
        x = np.stack([rnd.normal(size=n), rnd.integers(0, 3, n).astype(float), np.where(rnd.random(n) < 0.4, np.nan, rnd.random(n)),
                      np.full(n, np.nan), rnd.integers(0, 2, n) * 100.0], 1)
        rows += [(i, g, True, 0.0, 0.0, [None if np.isnan(v) and i % 2 else float(v) for v in r]) for i, r in enumerate(x)]
    train = frame(spark, rows).repartition(6)
    got = B.medians(train, 5, B.cut_points(train, 5, 16))
    for g in (0, 3, 5):
        x = np.array([[np.nan if v is None else v for v in r[5]] for r in rows if r[1] == g])
        for j in range(5):
            mine = x[:, j][~np.isnan(x[:, j])]
            assert (j not in got[g]) if not len(mine) else got[g][j] == pytest.approx(np.median(mine), abs=1e-12)


def test_a_round_passes_its_trees_once(spark, monkeypatch):
    """The rows' scores are kept from round to round: a level's job takes along the tree that grows, not those before."""
    rnd = np.random.default_rng(2)
    rows = [(i, 0, True, float(x[0] > 0), float(x[0]), [float(v) for v in x]) for i in range(300) for x in [rnd.normal(size=3)]]
    seen, level = [], B._level
    monkeypatch.setattr(B, "_level", lambda state, *a: seen.append(state) or level(state, *a))
    models = [B.Model(0, "up", [0, 1, 2])]
    B.fit(B.binned_rows(frame(spark, rows), 3, 8), models, B.Settings(rounds=12, rate=0.3, depth=2, min_rows=10, columns=1.0))
    for state, r in [(seen[0], 0), (seen[-1], 11)]:
        for group, x, y, size, score in state.collect():
            assert score["up"] == pytest.approx(models[0].start + B.apply_trees(models[0].trees[:r], x.T))
    assert len({id(s) for s in seen}) == 12 and seen[-1].getStorageLevel().useMemory is False


def test_a_model_grown_by_one_task_is_the_one_grown_level_by_level(spark):
    """Also where a pool has both kinds: the group of 150 rows is grown alone, that of 400 level by level."""
    from dataclasses import replace
    rnd = np.random.default_rng(13)
    rows = []
    for g, n in ((0, 400), (1, 150)):
        for i in range(n):
            x = rnd.normal(size=5)
            size = 2 * x[g] + x[2] * (x[3] > 0) + 0.3 * rnd.normal()
            rows.append((i, g, i % 10 > 0, float(size > 0), float(size), [None if rnd.random() < 0.1 else float(v) for v in x]))
    binned = B.binned_rows(frame(spark, rows), 5, 16)
    s = B.Settings(rounds=12, rate=0.2, depth=4, leaves=7, min_rows=5, columns=0.7)
    # one feature is left out: it is not a draw's
    pools = [[B.Model(g, t, [0, 1, 2, 3], 10 * g + len(t)) for g in (0, 1) for t in ("up", "size")] for _ in range(3)]
    told = []
    for pool, alone in zip(pools, (0, 400, 150)):
        state = B.predictions(B.fit(binned, pool, replace(s, alone=alone)), pool)
        told.append({(r.group, r.idx): (r.up, r.value) for r in state.collect()})
    for pool in pools[1:]:
        for a, b in zip(pools[0], pool):
            assert len(a.trees) == len(b.trees) == 12 and any((t["feature"] >= 0).sum() == 6 for t in a.trees)
            for t, u in zip(a.trees, b.trees):
                assert t["feature"].tolist() == u["feature"].tolist() and t["bin"].tolist() == u["bin"].tolist()
                assert t["value"] == pytest.approx(u["value"])
    for k, v in told[0].items():
        assert told[1][k] == pytest.approx(v) and told[2][k] == pytest.approx(v)


def test_folders_of_earlier_rounds_are_deleted(spark):
    """Level by level, the scores of every tenth round are kept on disk until the next ones are."""
    import glob
    rnd = np.random.default_rng(4)
    rows = [(i, 0, True, float(x[0] > 0), float(x[0]), [float(v) for v in x]) for i in range(120) for x in [rnd.normal(size=2)]]
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(glob.glob(f"{folder}/rdd-*"))
    models = [B.Model(0, "up", [0, 1])]
    B.fit(B.binned_rows(frame(spark, rows), 2, 8), models, B.Settings(rounds=32, depth=1, min_rows=10, columns=1.0))
    assert len(models[0].trees) == 32 and len(set(glob.glob(f"{folder}/rdd-*")) - before) == 1
