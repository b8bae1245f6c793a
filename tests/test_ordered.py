"""Chunk-and-halo windows, prefix scans and row index equal the global
(single-partition) window results."""
import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from spreadforge.operators.ordered import (halo_rolling, halo_windows, lag_expr, row_index, running_sum_max,
                                           shifted_rolling)


def _series(spark, n=700, series=3, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(series):
        for i in range(n - 37 * s):
            v = None if rng.random() < 0.2 else float(rng.normal(100, 15))
            rows.append((s, i, v))
    return spark.createDataFrame(rows, "sid int, idx long, v double")


def test_halo_equals_global_window(spark):
    df = _series(spark)
    exprs = {"lag5": lag_expr("v", 5), "m": shifted_rolling("v", 3, 40, 10, "mean"),
             "s": shifted_rolling("v", 3, 40, 10, "std")}
    got = halo_windows(df, "idx", exprs, reach=42, by="sid", chunk=97).toPandas().sort_values(["sid", "idx"])
    w = Window.partitionBy("sid").orderBy("idx")
    want = df.select("*", *[fn(w).alias(n) for n, fn in exprs.items()]).toPandas().sort_values(["sid", "idx"])
    assert len(got) == len(want)
    for c in exprs:
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-12, equal_nan=True)


def test_prefix_rolling_matches_pandas(spark):
    df = _series(spark, n=500, series=2)
    got = halo_rolling(df, "idx", {"lag2": ("v", 2)},
                       {"m": ("v", 4, 30, 8, "mean"), "s": ("v", 4, 30, 8, "std")},
                       by="sid", chunk=61).toPandas().sort_values(["sid", "idx"])
    for sid, g in got.groupby("sid"):
        v = g["v"].astype(float).reset_index(drop=True)
        np.testing.assert_allclose(g["lag2"].to_numpy(float), v.shift(2).to_numpy(), equal_nan=True)
        np.testing.assert_allclose(g["m"].to_numpy(float), v.shift(4).rolling(30, min_periods=8).mean().to_numpy(),
                                   rtol=1e-9, atol=1e-9, equal_nan=True)
        np.testing.assert_allclose(g["s"].to_numpy(float), v.shift(4).rolling(30, min_periods=8).std().to_numpy(),
                                   rtol=1e-7, atol=1e-7, equal_nan=True)


def test_row_index_and_prefix_scan(spark):
    rng = np.random.default_rng(3)
    ts = pd.date_range("2024-01-01", periods=900, freq="37min")
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 900), "ts": ts, "x": rng.normal(0, 10, 900)})
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    ri = row_index(df, "ts", by="k").toPandas()
    for k, g in ri.groupby("k"):
        assert sorted(g.sort_values("ts")["idx"]) == list(range(len(g)))
        assert (g.sort_values("ts")["idx"].diff().dropna() == 1).all()
    rs = running_sum_max(df, "x", "ts", by="k", bucket=F.date_trunc("HOUR", "ts")).toPandas()
    for k, g in rs.groupby("k"):
        g = g.sort_values("ts")
        np.testing.assert_allclose(g["cum"], g["x"].cumsum(), atol=1e-9)
        np.testing.assert_allclose(g["cum_max"], g["x"].cumsum().cummax(), atol=1e-9)


def test_regular_calendar_fills_gaps(spark):
    from spreadforge.operators.ordered import regular_calendar
    df = spark.createDataFrame([("2024-01-01 00:00:00", 1.0), ("2024-01-01 02:00:00", 2.0)], "t string, v double") \
        .select(F.col("t").cast("timestamp_ntz").alias("ts"), "v")
    out = regular_calendar(df).orderBy("ts").collect()
    assert len(out) == 5 and [r["v"] for r in out] == [1.0, None, None, None, 2.0]


def test_rolling_infinite_and_constant_windows(spark):
    """An infinite value marks the frames that hold it only; a constant window
    after a volatile stretch has deviation 0."""
    v = [float(1e6 * (-1) ** i) for i in range(150)] + [3.25] * 150
    v[100] = float("inf")
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "idx long, v double")
    got = halo_rolling(df, "idx", {}, {"m": ("v", 2, 20, 5, "mean"), "s": ("v", 2, 20, 5, "std")}, chunk=64) \
        .toPandas().sort_values("idx").set_index("idx")
    held = [i for i in range(300) if i - 21 <= 100 <= i - 2]
    assert np.isinf(got.loc[held, "m"].astype(float)).all()
    rest = [i for i in range(10, 300) if i not in held]
    assert np.isfinite(got.loc[rest, ["m", "s"]].astype(float)).all().all()
    constant = list(range(171, 300))
    assert (got.loc[constant, "s"] == 0.0).all() and (got.loc[constant, "m"] == 3.25).all()


def test_row_index_keeps_null_keys_and_orders(spark):
    rows = [("a", 3), ("a", None), (None, 5), (None, 1), ("a", 1)]
    df = spark.createDataFrame(rows, "k string, o long")
    got = {(r["k"], r["o"]): r["idx"] for r in row_index(df, "o", by="k", bucket=F.floor(F.col("o") / 2), fan=1).collect()}
    assert got == {("a", None): 0, ("a", 1): 1, ("a", 3): 2, (None, 1): 0, (None, 5): 1}
    rs = running_sum_max(df, "o", "o", by="k", bucket=F.floor(F.col("o") / 2)).count()
    assert rs == 5


def test_order_check_with_gaps_in_ids(spark):
    from spreadforge.operators.quality import order_check
    df = spark.createDataFrame([(19990, 10), (20005, 4), (70000, 9), (None, 1)], "id long, t long")
    assert order_check(df, "t", "id").first()["negative_steps"] == 1
