"""Data-quality reports: A2-A8, A20, F3, F4, J3/U2, W4."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadforge.config import IDA2_WINDOW, IDA3_WINDOW, VALIDITY_EXCLUDE, VALIDITY_INCLUDE
from spreadforge.functions.scalar import col
from spreadforge.operators.clean import must_have_columns
from spreadforge.operators.ordered import halo_windows, missing_slots, row_index
from spreadforge.operators.quantiles import exact_percentiles

_NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def dup_counts(df: DataFrame, ts: str = "ts") -> DataFrame:
    """A2 + A3: rows, duplicated full rows, duplicated timestamps (missing ts
    counts as one value).  Both are group-bys combined map-side."""
    rows = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("c")) \
        .agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct_rows"))
    out = rows.select("n_rows", (F.col("n_rows") - F.col("n_distinct_rows")).alias("dup_rows"))
    if ts in df.columns:
        t = df.groupBy(col(ts)).agg(F.count(F.lit(1)).alias("c")) \
            .agg((F.sum("c") - F.count(F.lit(1))).alias("dup_ts"))
        # both sides are single global-aggregate rows: scalar subquery, no join
        out = out.withColumn("dup_ts", t.scalar())
    return out


def colliding_ts(df: DataFrame, ts: str = "ts") -> DataFrame:
    """every row whose timestamp occurs more than once.  The per-ts counts
    are a small keyed table joined back (semi-join), so a hot timestamp never
    needs its rows in one window partition."""
    dups = df.groupBy(col(ts).alias("__t")).agg(F.count(F.lit(1)).alias("__c")).where("__c > 1")
    return df.join(dups, col(ts).eqNullSafe(F.col("__t")), "left_semi")


def negative_rows(df: DataFrame, column: str = "EirgridActualWind", ts: str = "ts", n: int = 10) -> DataFrame:
    """the ``n`` most negative rows of ``column`` (top-k report)."""
    return df.where(col(column) < 0).orderBy(col(column).asc(), col(ts).asc()).limit(n) \
        .select(col(ts), col(column))


def validity_columns(df: DataFrame) -> list[str]:
    return [c for c in numeric_columns(df)
            if any(k in c.upper() for k in VALIDITY_INCLUDE)
            and not any(x in c.upper() for x in VALIDITY_EXCLUDE)]


def _long_counts(df: DataFrame, columns: Sequence[str], aggs: dict) -> DataFrame:
    """One aggregate row with ``len(columns) * len(aggs)`` cells -> long table."""
    exprs = []
    for i, c in enumerate(columns):
        for name, fn in aggs.items():
            exprs.append(fn(col(c)).alias(f"{name}__{i}"))
    row = df.agg(*exprs)
    items = [F.struct(F.lit(c).alias("column"), *[F.col(f"{name}__{i}").alias(name) for name in aggs])
             for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*items)).alias("e")).select("e.*")


def validity_report(df: DataFrame) -> DataFrame:
    """A4: non-missing, negative and share negative (6 dp) for the non-negative
    physical columns (name tokens)."""
    cols = validity_columns(df)
    out = _long_counts(df, cols, {"non_missing_values": lambda c: F.count(c),
                                  "negative_values": lambda c: F.count(F.when(c < 0, 1))})
    return out.withColumn("proportion_negative",
                          F.bround(F.try_divide(F.col("negative_values").cast("double"),
                                                F.col("non_missing_values").cast("double")), 6))


def missing_report(df: DataFrame, top: int | None = 20) -> DataFrame:
    """A5: missing count and % (2 dp) per column, largest first (top-k report)."""
    out = _long_counts(df, df.columns, {"missing_count": lambda c: F.count(F.when(c.isNull(), 1)),
                                        "n": lambda c: F.count(F.lit(1))})
    out = out.select("column", "missing_count",
                     F.bround(F.col("missing_count") * 100.0 / F.col("n"), 2).alias("missing_pct"))
    if top is not None:
        out = out.orderBy(F.desc("missing_count"), F.asc("column")).limit(top)
    return out


def must_have_missing(df: DataFrame) -> DataFrame:
    """Must-have columns that have missing values."""
    mh = must_have_columns(df.columns)
    rep = _long_counts(df, mh, {"missing_count": lambda c: F.count(F.when(c.isNull(), 1))})
    return rep.where("missing_count > 0")


def _windows(hod: str):
    h = col(hod)
    return {"all": F.lit(True),
            "ida2": (h >= IDA2_WINDOW[0]) & (h < IDA2_WINDOW[1]),
            "ida3": (h >= IDA3_WINDOW[0]) & (h < IDA3_WINDOW[1])}


STRUCTURAL_PAIRS = (
    ("PriceIDA1", "all"), ("PriceIDA2", "ida2"), ("PriceIDA3", "ida3"),
    ("EirGridDemandFc_IDA2", "ida2"), ("EirGridWindFc_IDA2", "ida2"), ("ISEMSOLAR_IDA2", "ida2"),
    ("EirGridDemandFc_IDA3", "ida3"), ("EirGridWindFc_IDA3", "ida3"), ("ISEMSOLAR_IDA3", "ida3"),
)


def structural_check(df: DataFrame, pairs=STRUCTURAL_PAIRS, hod: str = "hod") -> DataFrame:
    """Missingness inside vs outside each delivery window, one aggregate."""
    win = _windows(hod)
    pairs = [(c, w) for c, w in pairs if c in df.columns]
    exprs, items = [], []
    for i, (c, w) in enumerate(pairs):
        ins = win[w]
        exprs += [F.count(F.when(ins, 1)).alias(f"it{i}"),
                  F.count(F.when(ins & col(c).isNull(), 1)).alias(f"im{i}"),
                  F.count(F.when(~ins, 1)).alias(f"ot{i}"),
                  F.count(F.when(~ins & col(c).isNull(), 1)).alias(f"om{i}")]
        items.append(F.struct(
            F.lit(c).alias("column"), F.lit(w).alias("window"),
            F.col(f"it{i}").alias("inside_total"), F.col(f"im{i}").alias("inside_missing"),
            F.try_divide(F.col(f"im{i}").cast("double"), F.col(f"it{i}").cast("double")).alias("inside_rate"),
            F.col(f"ot{i}").alias("outside_total"), F.col(f"om{i}").alias("outside_missing"),
            F.try_divide(F.col(f"om{i}").cast("double"), F.col(f"ot{i}").cast("double")).alias("outside_rate"),
            (F.col(f"ot{i}") - F.col(f"om{i}")).alias("outside_nonmissing")))
    row = df.agg(*exprs)
    return row.select(F.explode(F.array(*items)).alias("e")).select("e.*")


OUTLIER_COLUMNS = ("PriceDAM", "PriceIDA1", "PriceIDA2", "PriceIDA3", "PriceImbalance",
                   "EirGridDemandFc_DAM", "EirGridDemandFc_IDA1", "EirGridDemandFc_IDA2",
                   "EirGridDemandFc_IDA3")


def outlier_report(df: DataFrame, columns: Sequence[str] = OUTLIER_COLUMNS, k: float = 3.0) -> DataFrame:
    """Min, max, bias-corrected skew, q1 -/+ k IQR bounds, count and % outside."""
    from spreadforge.operators.explore import long_form
    cols = [c for c in columns if c in df.columns]
    lf = long_form(df, cols).where(F.col("value").isNotNull())
    v = F.col("value")
    mom = lf.groupBy("column").agg(F.min(v).alias("minimum"), F.max(v).alias("maximum"),
                                   F.skewness(v).alias("__g1"), F.count(v).alias("__n"))
    n = F.col("__n").cast("double")
    mom = mom.withColumn("skewness", F.when(n > 2, F.col("__g1") * F.sqrt(n * (n - 1)) / (n - 2))) \
        .drop("__g1")
    q = exact_percentiles(lf, "value", [0.25, 0.75], by="column", names=["q1", "q3"]).drop("n")
    b = mom.join(q, "column").withColumn("lower_bound", F.col("q1") - F.lit(k) * (F.col("q3") - F.col("q1"))) \
        .withColumn("upper_bound", F.col("q3") + F.lit(k) * (F.col("q3") - F.col("q1")))
    cnt = lf.join(b.select("column", "lower_bound", "upper_bound"), "column") \
        .groupBy("column").agg(F.count(F.when((v < F.col("lower_bound")) | (v > F.col("upper_bound")), 1))
                               .alias("outlier_count"))
    return b.join(cnt, "column").select(
        "column", "minimum", "maximum", "skewness", "lower_bound", "upper_bound", "outlier_count",
        (F.col("outlier_count") * 100.0 / F.col("__n")).alias("outlier_pct"))


def inf_count(df: DataFrame) -> DataFrame:
    """Number of +/-infinite values per numeric column."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return _long_counts(df, cols, {"n_inf": lambda c: F.count(F.when(F.abs(c) == F.lit(float("inf")), 1))})


def missing_intervals(df: DataFrame, ts: str = "ts", step_minutes: int = 30, by=None) -> DataFrame:
    """Expected half-hours between min and max ``ts`` (of each series)
    that are absent, from the gaps between neighbouring times."""
    return missing_slots(df.withColumnRenamed(ts, "ts") if ts != "ts" else df, "ts", by, step_minutes)


def order_check(df: DataFrame, ts: str, order: str) -> DataFrame:
    """Number of steps where ``ts`` goes backwards in the ``order`` column's
    sequence (``order`` is an integer, e.g. an ingestion id, gaps allowed; a row
    without one has no place in the sequence)."""
    d = df.select(col(order).cast("bigint").alias("__o"), col(ts).alias("__t")).where(F.col("__o").isNotNull())
    d = row_index(d, "__o", bucket=F.floor(F.col("__o") / F.lit(20_000)), name="__i")
    w = halo_windows(d, "__i", {"__prev": lambda w: F.lag("__t", 1).over(w)}, reach=1, chunk=20_000)
    return w.agg(F.count(F.when(F.col("__t") < F.col("__prev"), 1)).alias("negative_steps"))
