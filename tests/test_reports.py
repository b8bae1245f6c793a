"""Report operators on tiny hand-computed frames."""
from pyspark.sql import functions as F

from spreadforge.operators import explore as EX
from spreadforge.operators import quality as QA


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 10]], "x double")
    h = {r["bin"]: r["count"] for r in EX.histogram(df, ["x"], bins=5).collect()}
    assert h == {0: 2, 1: 2, 2: 1, 4: 1}          # max (10) falls in the last bin


def test_structural_check_counts(spark):
    df = spark.createDataFrame([(12.0, None), (12.5, 1.0), (3.0, None), (4.0, 2.0)],
                               "hod double, PriceIDA2 double")
    r = QA.structural_check(df, pairs=(("PriceIDA2", "ida2"),)).first()
    assert (r["inside_total"], r["inside_missing"], r["outside_total"], r["outside_missing"],
            r["outside_nonmissing"]) == (2, 1, 2, 1, 1)
    assert r["inside_rate"] == 0.5


def test_validity_columns_and_proportion(spark):
    df = spark.createDataFrame([(-1.0, 5.0, -3.0), (2.0, None, 1.0)],
                               "EirgridActualWind double, ISEMSOLAR_DAM double, PredictedICFlow double")
    assert QA.validity_columns(df) == ["EirgridActualWind", "ISEMSOLAR_DAM"]
    rep = {r["column"]: r for r in QA.validity_report(df).collect()}
    assert rep["EirgridActualWind"]["negative_values"] == 1 and rep["EirgridActualWind"]["proportion_negative"] == 0.5
    assert rep["ISEMSOLAR_DAM"]["non_missing_values"] == 1


def test_missing_intervals_and_order_check(spark):
    ts = ["2024-01-01 00:00:00", "2024-01-01 00:30:00", "2024-01-01 02:00:00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "id long, t string") \
        .select("id", F.col("t").cast("timestamp_ntz").alias("ts"))
    miss = sorted(str(r["ts"]) for r in QA.missing_intervals(df).collect())
    assert miss == ["2024-01-01 01:00:00", "2024-01-01 01:30:00"]
    assert QA.order_check(df, "ts", "id").first()["negative_steps"] == 0
    rev = df.withColumn("id", -F.col("id") + 2)
    assert QA.order_check(rev, "ts", "id").first()["negative_steps"] == 2


def test_extremes_inclusive(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)], "spr_X double")
    r = EX.extremes(df, ["spr_X"]).first()
    assert r["q01"] == 1.0 and r["q99"] == 99.0
    assert r["n_extreme_low"] == 2 and r["n_extreme_high"] == 2


def test_correlations_with_constant_columns(spark):
    """A side that is constant over the pair's complete rows has no r; the other pairs keep theirs."""
    rows = [(1.0, 0.1, 5.0, 2.0, None), (2.0, 0.1, 3.0, 2.0, None), (4.0, 0.1, 8.0, None, 7.0), (3.0, 0.1, None, 3.0, None)]
    df = spark.createDataFrame(rows * 5, "`a b` double, c double, d double, e double, f double").repartition(7)
    got = {(r.x, r.y): r.r for r in EX.correlations(df, df.columns).collect()}
    assert len(got) == 25 and all(got[x, y] == got[y, x] or got[x, y] != got[x, y] for x, y in got)
    want = df.toPandas().corr()
    for x, y in [("a b", "d"), ("a b", "e"), ("a b", "a b"), ("c", "c")]:
        assert abs(got[x, y] - (1.0 if x == y else want[x][y])) < 1e-9
    for x, y in [("a b", "c"), ("c", "d"), ("c", "e"), ("a b", "f"), ("d", "e")]:
        assert got[x, y] != got[x, y]                 # e is constant where d is present
    assert got["e", "f"] is None                      # no complete row
    one = {(r.x, r.y): r.r for r in EX.correlations(df.limit(1), ["c", "d", "f"]).collect()}
    assert set(one.values()) == {None} and len(one) == 9
