"""Exploratory statistics: A9-A19, A21, A22.  Wide inputs are unpivoted to
long ``(column, value)`` form so that one grouped job covers every column;
per-column groups are hot by construction and are handled by map-side
partial aggregation and the distributed exact percentiles."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadforge.functions.scalar import col
from spreadforge.operators.quantiles import attach, exact_percentiles

DESCRIBE_PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def spread_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("spr_")]


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (),
              name: str = "column", value: str = "value") -> DataFrame:
    """Unpivot ``columns`` (cast to double) to ``(keep..., name, value)``; a
    narrow projection, no shuffle."""
    src = df.select(*[col(k).alias(k) for k in keep],
                    *[col(c).cast("double").alias(c) for c in columns])
    return src.unpivot(list(keep) or None, list(columns), name, value) if keep else \
        src.unpivot([], list(columns), name, value)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, percentiles 1..99, max per column."""
    lf = long_form(df, columns).where(F.col("value").isNotNull())
    mom = lf.groupBy("column").agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                                   F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                   F.max("value").alias("max"))
    names = ["p01", "p05", "p25", "p50", "p75", "p95", "p99"]
    q = exact_percentiles(lf, "value", DESCRIBE_PROBS, by="column", names=names).drop("n")
    return mom.join(q, "column")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A10: pairwise-complete Pearson r for every pair, long ``(x, y, r)`` with
    both orders and the diagonal.  Rows are dealt to their pairs and one keyed
    aggregate, merged map-side, serves all of them, however many columns there
    are.  NULL with fewer than two complete rows, NaN where a side is constant in them."""
    k = len(columns)
    v = df.select(F.array(*[col(c).cast("double") for c in columns]).alias("v"))
    cells = (v.select("v", F.posexplode("v").alias("i", "a")).where(F.col("a").isNotNull())
             .select("i", "a", F.posexplode("v").alias("j", "b")).where((F.col("j") >= F.col("i")) & F.col("b").isNotNull()))

    def constant(c):
        # by its ends: a merged variance of equal values need not be exactly zero
        lo, hi = F.min(c), F.max(c)
        return (lo == hi) & ~F.isnan(hi) & (F.abs(hi) < float("inf"))

    r = F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b"))
    r = F.when(constant("a") | constant("b"), F.lit(float("nan"))).otherwise(F.coalesce(r, F.lit(float("nan"))))
    found = cells.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) > 1, r).alias("r"))
    # k * k rows, from the column list alone
    names = df.sparkSession.createDataFrame([(min(i, j), max(i, j), columns[i], columns[j]) for i in range(k) for j in range(k)],
                                            "i int, j int, x string, y string")
    one = F.when(F.col("n") > 1, F.lit(1.0))
    return names.join(found, ["i", "j"], "left").select("x", "y", F.when(F.col("i") == F.col("j"), one).otherwise(F.col("r")).alias("r"))


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 80) -> DataFrame:
    """Equal-width bins over [min, max] per column, last bin closed."""
    lf = long_form(df, columns).where(F.col("value").isNotNull())
    rng = lf.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    j = lf.join(rng, "column")
    width = F.col("hi") - F.col("lo")
    b = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / width * F.lit(float(bins))),
                                  F.lit(bins - 1))).otherwise(F.lit(0)).cast("bigint")
    out = j.groupBy("column", b.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("count"))
    return out.select("column", "bin",
                      (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / F.lit(float(bins))).alias("bin_lo"),
                      (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") + 1) / F.lit(float(bins))).alias("bin_hi"),
                      "count")


def hod_profile(df: DataFrame, spreads: Sequence[str] | None = None, hod: str = "hod") -> DataFrame:
    """A12 (+ A14 per half-hour): mean, sample std and direction balance of each
    spread by half-hour of day."""
    spreads = list(spreads or spread_columns(df))
    lf = long_form(df, spreads, keep=[hod], name="spread").where(F.col("value").isNotNull())
    v = F.col("value")
    return lf.groupBy(hod, "spread").agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.avg((v < 0).cast("double")).alias("neg_share"),
        F.avg((v == 0).cast("double")).alias("zero_share"),
        F.avg((v > 0).cast("double")).alias("pos_share"),
        F.count(v).alias("n"))


def monthly_stats(df: DataFrame, spreads: Sequence[str] | None = None, ts: str = "ts") -> DataFrame:
    """Mean and sample std of every spread per calendar month 'yyyy-MM'."""
    spreads = list(spreads or spread_columns(df))
    d = df.withColumn("month_label", F.date_format(col(ts), "yyyy-MM"))
    lf = long_form(d, spreads, keep=["month_label"], name="spread")
    return lf.groupBy("month_label", "spread").agg(F.avg("value").alias("mean"),
                                                   F.stddev_samp("value").alias("std"),
                                                   F.count("value").alias("n"))


def direction_balance(df: DataFrame, on: str = "spread", spreads: Sequence[str] | None = None) -> DataFrame:
    """Shares < 0, = 0, > 0 and n over the non-missing values, per spread;
    ``on='dir'`` feeds the ``dir_`` labels instead (as the reference does,
    where a missing spread counts as -1)."""
    spreads = list(spreads or spread_columns(df))
    cols = [f"dir_{s}" for s in spreads] if on == "dir" else spreads
    lf = long_form(df, cols, name="column").where(F.col("value").isNotNull())
    lf = lf.withColumn("spread", F.regexp_replace("column", "^dir_", ""))
    v = F.col("value")
    return lf.groupBy("spread").agg(F.avg((v < 0).cast("double")).alias("neg_share"),
                                    F.avg((v == 0).cast("double")).alias("zero_share"),
                                    F.avg((v > 0).cast("double")).alias("pos_share"),
                                    F.count(v).alias("n"))


def extreme_bounds(df: DataFrame, spreads: Sequence[str] | None = None,
                   lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    spreads = list(spreads or spread_columns(df))
    lf = long_form(df, spreads, name="spread").where(F.col("value").isNotNull())
    return exact_percentiles(lf, "value", [lo, hi], by="spread", names=["q01", "q99"])


def extremes(df: DataFrame, spreads: Sequence[str] | None = None) -> DataFrame:
    """q01, q99, counts at or beyond them, share of extreme rows (4 dp)."""
    spreads = list(spreads or spread_columns(df))
    b = extreme_bounds(df, spreads)
    lf = long_form(df, spreads, name="spread").where(F.col("value").isNotNull()).join(b, "spread")
    v = F.col("value")
    low, high = v <= F.col("q01"), v >= F.col("q99")
    return lf.groupBy("spread", "q01", "q99").agg(
        F.count(F.when(low, 1)).alias("n_extreme_low"),
        F.count(F.when(high, 1)).alias("n_extreme_high"),
        F.bround(F.avg((low | high).cast("double")), 4).alias("pct_extreme_total"))


def extremes_by(df: DataFrame, key: str, spreads: Sequence[str] | None = None,
                side: str = "both") -> DataFrame:
    """A16 (key = 'hod', both tails) / A17 (key = month label, high tail):
    number of extreme events per spread and key."""
    spreads = list(spreads or spread_columns(df))
    b = extreme_bounds(df, spreads)
    lf = long_form(df, spreads, keep=[key], name="spread").where(F.col("value").isNotNull()).join(b, "spread")
    v = F.col("value")
    cond = {"both": (v <= F.col("q01")) | (v >= F.col("q99")), "high": v >= F.col("q99"),
            "low": v <= F.col("q01")}[side]
    return lf.where(cond).groupBy("spread", key).agg(F.count(F.lit(1)).alias("n_events"))


def qcut_bins(df: DataFrame, x: str, q: int = 5, label: str | None = None) -> DataFrame:
    """Quantile bin label (pandas ``qcut``, duplicate edges dropped, right-closed,
    lowest included) as column ``label``: the number of distinct inner edges
    strictly below x.  Edges are exact percentiles."""
    label = label or f"{x}_q"
    probs = [i / q for i in range(q + 1)]
    e = exact_percentiles(df, x, probs, names=[f"e{i}" for i in range(q + 1)]).drop("n")
    edges = F.array_sort(F.array_distinct(F.array(*[F.col(f"e{i}") for i in range(q + 1)])))
    e = e.select(F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0))).alias("__inner"))
    # ``e`` is one global aggregate row: a scalar subquery, no join
    j = df.withColumn("__inner", e.scalar())
    lab = F.when(col(x).isNotNull(), F.size(F.filter("__inner", lambda v: v < col(x))))
    return j.withColumn(label, lab.cast("bigint")).drop("__inner")


def qcut_means(df: DataFrame, drivers: dict[str, Sequence[str]], q: int = 5) -> DataFrame:
    """Mean spread per quantile bin of every driver; long ``(driver, bin,
    spread, mean, n)``.  The drivers are unpivoted once, their edges are one
    keyed percentile job, joined back on the driver's name."""
    probs = [i / q for i in range(q + 1)]
    spreads = list(dict.fromkeys(s for ss in drivers.values() for s in ss))
    lf = long_form(df, list(drivers), keep=spreads, name="driver", value="x").where(F.col("x").isNotNull())
    names = [f"e{i}" for i in range(q + 1)]
    e = exact_percentiles(lf, "x", probs, by="driver", names=names).drop("n")
    edges = F.array_sort(F.array_distinct(F.array(*[F.col(n) for n in names])))
    e = e.select("driver", F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0))).alias("__inner"))
    b = attach(lf, e, ["driver"]).withColumn("bin", F.size(F.filter("__inner", lambda v: v < F.col("x"))).cast("bigint"))
    b = b.unpivot(["driver", "bin"], spreads, "spread", "value")
    wanted = F.lit(False)
    for x, ss in drivers.items():
        wanted = wanted | ((F.col("driver") == x) & F.col("spread").isin(list(ss)))
    return b.where(wanted).groupBy("driver", "bin", "spread").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def line_fit(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Least-squares straight line y = a + b x on all pairwise-complete rows."""
    aggs = []
    for i, (x, y) in enumerate(pairs):
        aggs += [F.regr_slope(col(y), col(x)).alias(f"b{i}"), F.regr_intercept(col(y), col(x)).alias(f"a{i}"),
                 F.regr_count(col(y), col(x)).alias(f"n{i}")]
    row = df.agg(*aggs)
    items = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"b{i}").alias("slope"),
                      F.col(f"a{i}").alias("intercept"), F.col(f"n{i}").alias("n"))
             for i, (x, y) in enumerate(pairs)]
    return row.select(F.explode(F.array(*items)).alias("e")).select("e.*")


def scatter_sample(df: DataFrame, x: str, y: str, n: int = 8000, seed: int = 42,
                   ts: str = "ts") -> DataFrame:
    """A19 extract: at most ``n`` pairwise-complete rows ``(ts, x, y)``, chosen by
    a seeded multiplicative hash of the minute (a sampling operator, so the
    limit is the feature)."""
    d = df.where(col(x).isNotNull() & col(y).isNotNull())
    minute = F.floor(F.unix_seconds(col(ts).cast("timestamp")) / 60)
    h = (minute * F.lit(48271) + F.lit(seed)) % F.lit(2147483647)
    return d.orderBy(h, col(ts)).limit(n).select(col(ts), col(x), col(y))


PRICE_MARKETS = (("DAM", "PriceDAM"), ("IDA1", "PriceIDA1"), ("IDA2", "PriceIDA2"),
                 ("IDA3", "PriceIDA3"), ("BM", "PriceImbalance"))


def price_summary(df: DataFrame) -> DataFrame:
    """Mean, std, median, min, max, observations per market."""
    present = [(m, c) for m, c in PRICE_MARKETS if c in df.columns]
    lf = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("market"), col(c).cast("double").alias("value"))
                                       for m, c in present])).alias("e")).select("e.*") \
        .where(F.col("value").isNotNull())
    mom = lf.groupBy("market").agg(F.avg("value").alias("mean_eur_mwh"), F.stddev_samp("value").alias("std_eur_mwh"),
                                   F.min("value").alias("min_eur_mwh"), F.max("value").alias("max_eur_mwh"),
                                   F.count("value").alias("observations"))
    med = exact_percentiles(lf, "value", [0.5], by="market", names=["median_eur_mwh"]).drop("n")
    return mom.join(med, "market")


def spread_summary(df: DataFrame, spreads: Sequence[str] | None = None) -> DataFrame:
    """Mean, std, mean |spread|, q01, q99 per spread."""
    spreads = list(spreads or spread_columns(df))
    lf = long_form(df, spreads, name="spread").where(F.col("value").isNotNull())
    mom = lf.groupBy("spread").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                   F.avg(F.abs("value")).alias("mean_abs"))
    return mom.join(extreme_bounds(df, spreads).drop("n"), "spread")
