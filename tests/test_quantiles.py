import numpy as np
import pandas as pd

from spreadforge.operators.explore import qcut_bins
from spreadforge.operators.quantiles import exact_percentiles


def test_exact_percentiles_small_groups(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 3000), "x": rng.normal(0, 1, 3000).round(2)})
    pdf.loc[::17, "x"] = np.nan
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_percentiles(spark.createDataFrame(pdf), "x", probs, by="g").toPandas().set_index("g")
    for g, grp in pdf.dropna().groupby("g"):
        want = np.percentile(grp["x"].to_numpy(), [p * 100 for p in probs])
        np.testing.assert_allclose(got.loc[g, [f"q_{p:g}" for p in probs]].to_numpy(float), want, rtol=1e-12)


def test_exact_percentiles_wide_brackets_on_hot_group(spark):
    # a coarse sketch makes the brackets wide; one hot group, a null group key
    rng = np.random.default_rng(11)
    g = np.where(rng.random(20000) < 0.9, 0, rng.integers(1, 5, 20000))
    pdf = pd.DataFrame({"g": [None if k == 4 else int(k) for k in g], "x": rng.exponential(3.0, 20000)})
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    df = spark.createDataFrame([(None if pd.isna(a) else int(a), float(b)) for a, b in pdf.itertuples(index=False)], "g long, x double")
    got = {r["g"]: r for r in exact_percentiles(df, "x", probs, by="g", accuracy=50).collect()}
    assert len(got) == 5
    for k in range(5):
        x = pdf["x"][g == k].to_numpy()
        want = np.percentile(x, [p * 100 for p in probs])
        row = got[None if k == 4 else k]
        np.testing.assert_allclose([row[f"q_{p:g}"] for p in probs], want, rtol=1e-12)
        assert row["n"] == len(x)


def test_exact_percentiles_with_half_ties(spark):
    """Half of all rows share one value: it is one counted row, and the
    returned plan windows no raw rows."""
    x = np.concatenate([np.full(5000, 7.0), np.arange(5000) / 500.0])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    for accuracy in (20, 100_000):
        row = exact_percentiles(df, "x", [0.1, 0.5, 0.61, 0.95], accuracy=accuracy).first()
        np.testing.assert_allclose([row["q_0.1"], row["q_0.5"], row["q_0.61"], row["q_0.95"]],
                                   np.percentile(x, [10, 50, 61, 95]), rtol=1e-12)


def test_exact_percentiles_tiny_groups(spark):
    rows = [(n, float(v)) for n in range(1, 9) for v in range(n)]
    got = exact_percentiles(spark.createDataFrame(rows, "g int, x double"), "x", [0.25, 0.4, 0.5, 0.99], by="g").collect()
    for r in got:
        np.testing.assert_allclose([r["q_0.25"], r["q_0.4"], r["q_0.5"], r["q_0.99"]],
                                   np.percentile(np.arange(r["g"]), [25, 40, 50, 99]), rtol=1e-12)


def test_qcut_matches_pandas(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.zeros(300), rng.normal(5, 2, 700)])
    pdf = pd.DataFrame({"x": x})
    got = qcut_bins(spark.createDataFrame(pdf), "x", 5, "b").toPandas()
    want = pd.qcut(got["x"], q=5, labels=False, duplicates="drop")
    assert (got["b"].to_numpy() == want.to_numpy()).all()


def test_approximate_switch(spark):
    pdf = pd.DataFrame({"x": np.arange(1000, dtype=float)})
    got = exact_percentiles(spark.createDataFrame(pdf), "x", [0.5], exact=False).first()
    assert got["n"] == 1000 and abs(got["q_0.5"] - 499.5) <= 1.0


def test_narrowing_until_brackets_are_bounded(spark):
    """A bound far below the bracket's rows makes further sketches narrow it;
    heavy ties stand at and between the wanted ranks."""
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(0, 1, 30_000), np.full(9_000, 0.25), np.full(9_000, -0.25), np.full(500, np.inf)])
    g = np.where(np.arange(len(x)) % 10 == 0, 1, 0)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x": x}))
    probs = [0.0, 0.05, 0.3, 0.5, 0.7, 0.9, 0.999]
    got = {r["g"]: r for r in exact_percentiles(df, "x", probs, by="g", accuracy=20, bound=50).collect()}
    for k in (0, 1):
        want = np.percentile(x[g == k], [p * 100 for p in probs])
        np.testing.assert_allclose([got[k][f"q_{p:g}"] for p in probs], want, rtol=1e-12)
    row = exact_percentiles(df, "x", probs, accuracy=20, bound=50).first()
    np.testing.assert_allclose([row[f"q_{p:g}"] for p in probs], np.percentile(x, [p * 100 for p in probs]), rtol=1e-12)
    assert row["n"] == len(x)


def test_million_distinct_values_are_not_exchanged(spark, tmp_path):
    """No exchange below the returned plan carries the values outside the brackets."""
    n = 1_000_000
    spark.range(n).selectExpr("id % 3 AS g", "CAST(id * 7919 % 1000003 AS DOUBLE) AS x").write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))
    got = exact_percentiles(df, "x", [0.01, 0.5, 0.99], by="g", names=["a", "b", "c"])
    rows = {r["g"]: r for r in got.collect()}
    ids = np.arange(n)
    x = (ids * 7919 % 1000003).astype(float)
    for k in range(3):
        np.testing.assert_allclose([rows[k]["a"], rows[k]["b"], rows[k]["c"]], np.percentile(x[ids % 3 == k], [1, 50, 99]), rtol=1e-12)
    plan = got._jdf.queryExecution().executedPlan()
    sizes = exchange_rows(plan)
    assert sizes and max(sizes) < n // 100


def exchange_rows(plan):
    """Rows written by every exchange of an executed plan."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return exchange_rows(plan.executedPlan())
    if name.endswith("QueryStage"):
        return exchange_rows(plan.plan())
    own = []
    if name == "Exchange":
        own = [plan.metrics().apply("shuffleRecordsWritten").value()]
    kids = plan.children()
    return own + [v for k in range(kids.size()) for v in exchange_rows(kids.apply(k))]


def test_empty_table_has_no_percentiles(spark):
    none = spark.createDataFrame([], "g int, x double")
    assert exact_percentiles(none, "x", [0.5], by="g").count() == 0
    row = exact_percentiles(none, "x", [0.5]).first()
    assert row["n"] == 0 and row["q_0.5"] is None
