"""Model data sets in long form: F5-F9, W9, W10, A23, P23 wiring.

All seven transitions are stacked into one long table ``(transition, idx, ts,
y_dir, y_mag)`` with a per-row array filter + explode (no per-transition
re-scan of the feature table), so later steps are one grouped job."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadforge.config import LAG_BURNIN, TEST_FRACTION, TRANSITIONS, TransitionSpec
from spreadforge.functions.scalar import col
from spreadforge.functions.selection import build_xcols
from spreadforge.operators.ordered import row_index
from spreadforge.operators.quantiles import _join

KEY = "transition"


def usable_target(spread: str, window: str | None, idx: str = "idx", burn_in: int = LAG_BURNIN):
    """F5 (window text) AND F6 (burn-in) AND F7 (present, non-zero)."""
    c = (col(idx) >= burn_in) & col(spread).isNotNull() & (F.signum(col(spread)) != 0)
    if window:
        c = c & F.expr(window)
    return c


def transition_guard(df: DataFrame, transitions: Sequence[TransitionSpec] = TRANSITIONS,
                     min_rows: int = 500) -> DataFrame:
    """F8: non-missing count per transition spread (one aggregate) and whether
    the transition is fitted (spread present and >= ``min_rows`` values)."""
    present = [t for t in transitions if t.spread in df.columns]
    row = df.agg(*[F.count(col(t.spread)).alias(f"n{i}") for i, t in enumerate(present)])
    items = [F.struct(F.lit(t.name).alias(KEY), F.lit(t.spread).alias("spread"),
                      F.col(f"n{i}").alias("n_non_missing"), (F.col(f"n{i}") >= min_rows).alias("usable"))
             for i, t in enumerate(present)]
    return row.select(F.explode(F.array(*items)).alias("e")).select("e.*")


def long_dataset(df: DataFrame, transitions: Sequence[TransitionSpec] = TRANSITIONS, idx: str = "idx",
                 ts: str = "ts", burn_in: int = LAG_BURNIN, by: Sequence[str] = ()) -> DataFrame:
    """one row per (transition, usable row): idx, ts, sign target, float target."""
    present = [t for t in transitions if t.spread in df.columns]
    items = [F.when(usable_target(t.spread, t.window, idx, burn_in),
                    F.struct(F.lit(t.name).alias(KEY), F.signum(col(t.spread)).cast("int").alias("y_dir"),
                             col(t.spread).cast("double").alias("y_mag")))
             for t in present]
    arr = F.filter(F.array(*items), lambda s: s.isNotNull())
    return df.select(*[col(b) for b in by], col(idx).alias(idx), col(ts).alias(ts), F.explode(arr).alias("e")) \
        .select(*by, "e.transition", idx, ts, "e.y_dir", "e.y_mag")


def add_positions(ds: DataFrame, idx: str = "idx", chunk: int = 20_000, by: Sequence[str] = ()) -> DataFrame:
    """Position ``rn0`` of each row inside its transition and series (ordered by
    ``idx``) and their size ``n``; numbering is bucketed by ``idx``, with two
    levels of offsets, so a big transition is never numbered in one task."""
    r = row_index(ds, idx, by=[KEY, *by], bucket=F.floor(col(idx) / F.lit(chunk)), name="rn0")
    n = ds.groupBy(KEY, *by).agg(F.count(F.lit(1)).alias("n"))
    return _join(r, n, [KEY, *by])


def temporal_split(ds: DataFrame, frac: float = TEST_FRACTION, idx: str = "idx", by: Sequence[str] = ()) -> DataFrame:
    """First floor(n * (1 - frac)) rows of each transition (and series) train, rest test."""
    p = add_positions(ds, idx, by=by)
    cut = F.floor(F.col("n").cast("double") * F.lit(1 - frac))
    return p.withColumn("split", F.when(F.col("rn0") < cut, F.lit("train")).otherwise(F.lit("test")))


def walk_forward_roles(ds: DataFrame, splits: int = 5, idx: str = "idx", by: Sequence[str] = ()) -> DataFrame:
    """Expanding-window folds over all rows of a transition: test size
    m = n div (splits + 1); fold k tests [n - (splits - k) m, n - (splits - k - 1) m)
    and trains on everything before.  Rows get (fold, role) per fold they take
    part in (explode over at most ``splits`` folds)."""
    p = add_positions(ds, idx, by=by)
    folds = F.sequence(F.lit(0), F.lit(splits - 1))
    p = p.withColumn("fold", F.explode(folds))
    return p.withColumn("role", fold_role(F.col("fold"), splits)).where(F.col("role").isNotNull())


def fold_role(fold, splits: int):
    """'train', 'test' or NULL for a row at position ``rn0`` of ``n``."""
    m = (F.col("n") / F.lit(splits + 1)).cast("bigint")
    start = F.col("n") - (F.lit(splits) - fold) * m
    return F.when(F.col("rn0") < start, "train").when(F.col("rn0") < start + m, "test")


def fold_summary(roles: DataFrame) -> DataFrame:
    return roles.groupBy(KEY, "fold", "role").agg(F.count(F.lit(1)).alias("rows"),
                                                  F.min("idx").alias("idx_min"), F.max("idx").alias("idx_max"))


def class_balance(split: DataFrame) -> DataFrame:
    """Class counts and up-share of the training part per transition."""
    tr = split.where(F.col("split") == "train")
    return tr.groupBy(KEY).agg(F.count(F.when(F.col("y_dir") == 1, 1)).alias("n_up"),
                               F.count(F.when(F.col("y_dir") == -1, 1)).alias("n_down"),
                               F.avg((F.col("y_dir") == 1).cast("double")).alias("up_share"))


def feature_table(spark, columns: Sequence[str], transitions: Sequence[TransitionSpec] = TRANSITIONS,
                  strict_gate: bool = False) -> DataFrame:
    """P23 for every transition as a small DataFrame ``(transition, feature)``
    (the selection itself is a pure function of the column names)."""
    rows = []
    for t in transitions:
        horizon = t.name.split("→")[0] if strict_gate else None
        for c in build_xcols(columns, t.tokens, t.always, strict_gate_horizon=horizon):
            rows.append((t.name, c))
    return spark.createDataFrame(rows, f"{KEY} string, feature string")
