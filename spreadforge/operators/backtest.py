"""Trading backtest on scored rows ``(transition, ts, spread, p_up, pred_mag)``:
B1-B10, W5-W7, W11, J2, T2, T5.

All thresholds are evaluated in ONE grouped pass with conditional aggregates
(no row explode); sums, counts, mean and population std merge map-side, so a
transition holding a third of all rows is no hotter than the others."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadforge.config import BacktestConfig
from spreadforge.functions.scalar import clip
from spreadforge.operators.ordered import running_sum_max
from spreadforge.operators.quantiles import exact_percentiles

KEY = "transition"


def confidence(p_up: Column) -> Column:
    """B1: |p_up - 0.5|."""
    return F.abs(p_up - F.lit(0.5))


def signal(p_up: Column, threshold: float | Column) -> Column:
    """B2: sign(p_up - 0.5), 0 when the confidence is at or below the threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(confidence(p_up) <= t, F.lit(0)).otherwise(F.signum(p_up - F.lit(0.5)).cast("int"))


def add_sizing(scored: DataFrame, cfg: BacktestConfig = BacktestConfig(), pred: str = "pred_mag") -> DataFrame:
    """volume = clip(|pred| / max(p25(|pred|), 0.5), 0.1, max_vol); the exact
    25th percentile is per transition over its whole scored set."""
    absd = scored.withColumn("__abs_pred", F.abs(F.col(pred)))
    p25 = exact_percentiles(absd, "__abs_pred", [cfg.size_quantile], by=KEY, names=["__p25"]).drop("n")
    p25 = p25.withColumn("size_base", F.greatest(F.col("__p25"), F.lit(cfg.size_floor))).drop("__p25")
    return absd.join(p25, KEY).withColumn(
        "volume", clip(F.col("__abs_pred") / F.col("size_base"), cfg.min_volume, cfg.max_volume)).drop("__abs_pred")


def row_pnl(sized: DataFrame, threshold: float, spread: str = "spread") -> DataFrame:
    """Per-row P&L at one threshold: +-|spread| x volume, 0 when not traded."""
    sig = signal(F.col("p_up"), threshold)
    s = F.col(spread)
    correct = (sig == F.signum(s).cast("int")) & (sig != 0)
    pnl_mwh = F.when(correct, F.abs(s)).otherwise(-F.abs(s))
    return sized.withColumns({"signal": sig, "traded": sig != 0, "correct": correct,
                              "pnl": F.when(sig != 0, pnl_mwh * F.col("volume")).otherwise(F.lit(0.0))})


def trading_table(scored: DataFrame, cfg: BacktestConfig = BacktestConfig(), spread: str = "spread",
                  sized: DataFrame | None = None) -> DataFrame:
    """B5 (+B10): one row per (transition, threshold): n_trades, hit_rate,
    eur_per_mwh, total_pnl_eur, sharpe_proxy (rounded half-even), test_size,
    pct_traded."""
    d = sized if sized is not None else add_sizing(scored, cfg)
    s, vol, conf = F.col(spread), F.col("volume"), confidence(F.col("p_up"))
    direction = F.signum(F.col("p_up") - F.lit(0.5)).cast("int")
    correct = direction == F.signum(s).cast("int")
    pnl = F.when(correct, F.abs(s)).otherwise(-F.abs(s)) * vol
    aggs = [F.count(F.lit(1)).alias("test_size")]
    for i, t in enumerate(cfg.thresholds):
        tr = conf > F.lit(float(t))
        aggs += [F.count(F.when(tr, 1)).alias(f"n{i}"),
                 F.count(F.when(tr & correct, 1)).alias(f"h{i}"),
                 F.sum(F.when(tr, vol)).alias(f"v{i}"),
                 F.sum(F.when(tr, pnl)).alias(f"p{i}"),
                 F.avg(F.when(tr, pnl)).alias(f"m{i}"),
                 F.stddev_pop(F.when(tr, pnl)).alias(f"s{i}")]
    g = d.groupBy(KEY).agg(*aggs)
    items = []
    for i, t in enumerate(cfg.thresholds):
        n = F.col(f"n{i}")
        items.append(F.struct(
            F.lit(float(t)).alias("conf_thresh"),
            n.alias("n_trades"),
            F.bround(F.when(n > 0, F.col(f"h{i}") / n), 4).alias("hit_rate"),
            F.bround(F.when(F.col(f"v{i}") > 0, F.col(f"p{i}") / F.col(f"v{i}")), 4).alias("eur_per_mwh"),
            F.bround(F.coalesce(F.col(f"p{i}"), F.lit(0.0)), 2).alias("total_pnl_eur"),
            F.bround(F.when(n > 1, F.col(f"m{i}") / (F.col(f"s{i}") + F.lit(1e-9))), 4).alias("sharpe_proxy")))
    return g.select(KEY, "test_size", F.explode(F.array(*items)).alias("e")).select(
        KEY, "e.*", "test_size",
        F.bround(F.try_divide(F.col("e.n_trades").cast("double"), F.col("test_size").cast("double")), 4)
        .alias("pct_traded"))


def best_per_transition(trading: DataFrame) -> DataFrame:
    """The threshold with the highest EUR/MWh per transition (ties: lower
    threshold)."""
    w = Window.partitionBy(KEY).orderBy(F.desc_nulls_last("eur_per_mwh"), F.asc("conf_thresh"))
    return trading.withColumn("__rk", F.row_number().over(w)).where("__rk = 1").drop("__rk")


def leaderboard(trading: DataFrame, metrics: DataFrame) -> DataFrame:
    """Best threshold per transition joined (J2) to model metrics, ordered by
    EUR/MWh (T2).  ``metrics`` is the caller's table: how it is joined is left
    to its size at run time."""
    best = best_per_transition(trading).drop("test_size", "pct_traded")
    return best.join(metrics, KEY).orderBy(F.desc_nulls_last("eur_per_mwh"), F.asc(KEY))


def threshold_sensitivity(trading: DataFrame) -> DataFrame:
    """EUR/MWh and trades against threshold, per transition."""
    return trading.select(KEY, "conf_thresh", "eur_per_mwh", "n_trades")


def pnl_series(scored: DataFrame, cfg: BacktestConfig = BacktestConfig(), threshold: float | None = None,
               spread: str = "spread", sized: DataFrame | None = None) -> DataFrame:
    """B7 + W5-W7: P&L per (transition, ts) at ``threshold`` (default 0.20),
    cumulative P&L, running maximum and drawdown, by a prefix scan."""
    t = cfg.best_threshold if threshold is None else threshold
    d = sized if sized is not None else add_sizing(scored, cfg)
    per_ts = row_pnl(d, t, spread).groupBy(KEY, "ts").agg(F.sum(money(F.col("pnl"))).alias("pnl"))
    rs = running_sum_max(per_ts, "pnl", "ts", by=KEY, cum="cum_pnl", cum_max="cum_max")
    rs = rs.withColumn("drawdown", F.col("cum_pnl") - F.col("cum_max"))
    return rs.select(KEY, "ts", *[F.col(c).cast("double").alias(c) for c in ("pnl", "cum_pnl", "cum_max", "drawdown")])


def money(c: Column) -> Column:
    """EUR amount rounded to micro-euros as DECIMAL(38,6): sums of it are exact,
    so cumulative P&L does not depend on partitioning or summation order.  An
    amount beyond that type raises."""
    return (F.rint(c * F.lit(1e6)) / F.lit(1e6)).cast("decimal(38,6)")


def max_drawdown(series: DataFrame) -> DataFrame:
    """Largest drawdown (most negative) and final cumulative P&L per transition."""
    return series.groupBy(KEY).agg(F.min("drawdown").alias("max_drawdown"),
                                   F.max_by("cum_pnl", "ts").alias("final_pnl"))


def top_rows(board: DataFrame) -> DataFrame:
    """T5: the leaderboard rows with the best total P&L and the best accuracy."""
    cols = board.columns
    row = board.agg(F.max_by(F.struct(*cols), F.struct("total_pnl_eur", F.col(KEY))).alias("best_profit"),
                    F.max_by(F.struct(*cols), F.struct("test_accuracy", F.col(KEY))).alias("best_accuracy"))
    return row.select(F.explode(F.array(
        F.struct(F.lit("best_profit").alias("kind"), F.col("best_profit").alias("r")),
        F.struct(F.lit("best_accuracy").alias("kind"), F.col("best_accuracy").alias("r")))).alias("e")) \
        .select("e.kind", "e.r.*")
