"""Property checks on the derived sf0.001 tables."""
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def wide(spark):
    from spreadforge.plans.catalog import features
    return features(spark, SF)


def test_spread_additivity(wide):
    bad = wide.where(F.abs(F.col("spr_BM_DAM") - (F.col("spr_BM_IDA1") + F.col("spr_IDA1_DAM"))) > 1e-9).count()
    assert bad == 0


def test_no_nan_emitted(wide):
    dbl = [f.name for f in wide.schema.fields if isinstance(f.dataType, T.DoubleType)]
    row = wide.agg(*[F.count(F.when(F.isnan(F.col(f"`{c}`")), 1)).alias(f"n{i}") for i, c in enumerate(dbl)]).first()
    assert sum(row) == 0


def test_burn_in_and_classes(wide):
    from spreadforge.operators.dataset import long_dataset
    ds = long_dataset(wide)
    agg = ds.agg(F.min("idx").alias("m"), F.collect_set("y_dir").alias("c")).first()
    assert agg["m"] >= 672 and set(agg["c"]) <= {-1, 1}


def test_walk_forward_fold_sizes(wide):
    from spreadforge.operators.dataset import fold_summary, long_dataset, walk_forward_roles
    ds = long_dataset(wide)
    n = {r["transition"]: r["count"] for r in ds.groupBy("transition").count().collect()}
    fs = fold_summary(walk_forward_roles(ds)).where("role = 'test'").groupBy("transition") \
        .agg(F.sum("rows").alias("t")).collect()
    for r in fs:
        assert r["t"] == 5 * (n[r["transition"]] // 6)


def test_collapse_idempotent(spark):
    from spreadforge.functions.calendar import add_clock_parts, parse_market_time
    from spreadforge.operators.clean import collapse_duplicate_ts
    from spreadforge.sources.fixtures import dirty_panel
    p = add_clock_parts(parse_market_time(dirty_panel(spark, SF)))
    once = collapse_duplicate_ts(p, order_col="seq")
    twice = collapse_duplicate_ts(once.withColumn("seq", F.lit(0)), order_col="seq")
    assert once.count() == twice.count() == p.select("ts").distinct().count()
    assert once.exceptAll(twice).count() == 0
