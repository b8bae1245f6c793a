"""Model stage: M1-M8, A29.

Feature names by token rule (P23) -> usable rows (F5-F7) -> temporal split (W9)
and walk-forward folds (W10) -> exact medians of each model's own training rows
(M1) -> boosted trees (M4, M5; ``operators/boost.py``) -> scored test rows (M6).
Every transition, target and fold is one model of one pool that is fitted together
(M7, M8).  Trees only compare values, so the published scaling step (M2) changes
nothing in them and is not run here.  The driver holds model parameters (medians,
cuts, trees) and the first and last index of each part.
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass
from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadforge.config import TRANSITIONS, ModelConfig, TransitionSpec
from spreadforge.functions.scalar import col
from spreadforge.functions.selection import build_xcols
from spreadforge.operators import boost as BO
from spreadforge.operators import dataset as DS
from spreadforge.operators import metrics as MT
from spreadforge.operators.quantiles import exact_percentiles
from spreadforge.session import materialize

KEY = "transition"


def column_medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """M1: exact median of every column over the training rows (one grouped
    job over the unpivoted rows); all-missing columns are absent."""
    from spreadforge.operators.explore import long_form
    lf = long_form(train, columns).where(F.col("value").isNotNull())
    med = exact_percentiles(lf, "value", [0.5], by="column", names=["median"])
    return {r["column"]: r["median"] for r in med.collect()}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(col(c).cast("double"), F.lit(float(v))) for c, v in medians.items()})


@dataclass
class FittedTransition:
    spec: TransitionSpec
    features: list[str]
    columns: list[str]
    clf: BO.Model
    reg: BO.Model | None
    scored: DataFrame
    #: mean training losses of the classifier (log loss) and the regressor (squared), and those of constants
    losses: dict[str, float]


@dataclass
class Study:
    """Fitted transitions, and the folds' accuracies (``transition, fold,
    n_test, accuracy``; None if no folds were asked for)."""
    fits: list[FittedTransition]
    folds: DataFrame | None


def settings(cfg: ModelConfig) -> BO.Settings:
    return BO.Settings(rounds=cfg.max_iter, rate=cfg.step_size, depth=cfg.max_depth, leaves=cfg.leaves,
                       min_rows=cfg.min_instances_per_node, columns=cfg.column_share, l1=cfg.l1, l2=cfg.l2,
                       bins=cfg.bins, seed=cfg.seed, alone=cfg.alone_rows)


def _parts(wide: DataFrame, specs: Sequence[TransitionSpec], cfg: ModelConfig, split: bool, folds: bool) -> list[dict]:
    """Training and test ranges of ``idx`` of every model's rows: a few per
    transition.  Positions are numbered on a table without features."""
    at = materialize(DS.add_positions(DS.long_dataset(wide, specs, burn_in=cfg.burn_in)).select(KEY, "idx", "rn0", "n"))
    size = {r[KEY]: r["n"] for r in at.groupBy(KEY).agg(F.max("n").alias("n")).collect()}
    parts = []
    for spec in specs:
        n = size.get(spec.name, 0)
        if split and n:
            parts.append({"spec": spec, "fold": None, "first": int(n * (1 - cfg.test_fraction)), "end": n})
        m = n // (cfg.cv_splits + 1)
        parts += [{"spec": spec, "fold": k, "first": n - (cfg.cv_splits - k) * m, "end": n - (cfg.cv_splits - k - 1) * m}
                  for k in range(cfg.cv_splits) if folds and m]
    wanted = F.lit(False)
    for p in parts:
        wanted = wanted | ((F.col(KEY) == p["spec"].name) & F.col("rn0").isin(p["first"], p["end"] - 1))
    index = {(r[KEY], r["rn0"]): r["idx"] for r in at.where(wanted).select(KEY, "rn0", "idx").collect()}
    for p in parts:
        p["from"], p["to"] = index[p["spec"].name, p["first"]], index[p["spec"].name, p["end"] - 1]
    return parts


def fit_all(wide: DataFrame, specs: Sequence[TransitionSpec], cfg: ModelConfig = ModelConfig(), strict_gate: bool = False,
            split: bool = True, regressor: bool = True, folds: bool = False) -> Study:
    """M1, M4-M8 on the engineered table ``wide`` (with ``idx``): the models of
    the temporal split and of the walk-forward folds, in one pool."""
    names = {t.name: build_xcols(wide.columns, t.tokens, t.always, strict_gate_horizon=t.name.split("→")[0] if strict_gate else None) for t in specs}
    columns = [c for c in wide.columns if any(c in x for x in names.values())]
    parts = _parts(wide, specs, cfg, split, folds)
    idx = F.col("idx")

    def member(g, p):
        spread = col(p["spec"].spread).cast("double")
        here = DS.usable_target(p["spec"].spread, p["spec"].window, "idx", cfg.burn_in) & (idx <= p["to"])
        return F.when(here, F.struct(F.lit(g).alias("group"), (idx < p["from"]).alias("train"), (spread > 0).cast("double").alias("y"), spread.alias("size")))

    x = F.array(*[col(c).cast("double") for c in columns]).alias("x")
    members = F.filter(F.array(*[member(g, p) for g, p in enumerate(parts)]), lambda e: e.isNotNull()).alias("e")
    # a stored table may be a few files of one row group each; its rows are binned by all cores
    spread = max(2 * wide.sparkSession.sparkContext.defaultParallelism, wide.count() // 20_000)
    rows = (wide.select("idx", "ts", x, members).repartition(spread, "idx").withColumn("e", F.explode("e"))
            .select("idx", "ts", "x", "e.group", "e.train", "e.y", "e.size"))
    binned = materialize(BO.binned_rows(rows, len(columns), cfg.bins))
    models = []
    for g, p in enumerate(parts):
        allowed = [k for k, c in enumerate(columns) if c in names[p["spec"].name]]
        for target in ("up", "size"):
            if target == "up" or (p["fold"] is None and regressor):
                models.append(BO.Model(g, target, allowed, zlib.crc32(f"{p['spec'].name}:{p['fold']}:{target}".encode())))
    if not models:
        return Study([], None)
    state = BO.fit(binned, models, settings(cfg))
    every = BO.predictions(state, models)
    told = materialize(every.where("NOT train"))
    p, share = F.col("up"), F.avg("y")
    loss = {r["group"]: r for r in every.where("train").groupBy("group").agg(
        F.avg(-F.when(F.col("y") == 1, F.log(p)).otherwise(F.log1p(-p))).alias("log_loss"),
        (-share * F.log(share) - (1 - share) * F.log1p(-share)).alias("log_loss_of_share"),
        F.avg(F.pow(F.col("value") - F.col("size"), F.lit(2.0))).alias("squared"), F.var_pop("size").alias("squared_of_mean")).collect()}
    by = {(m.group, m.target): m for m in models}
    up = F.when(F.col("up") > 0.5, 1).otherwise(-1)
    fits = []
    for g, p in enumerate(parts):
        if p["fold"] is None:
            scored = told.where(F.col("group") == g).select(
                "idx", "ts", F.lit(p["spec"].name).alias(KEY), F.col("size").alias("spread"), F.signum("size").cast("int").alias("y"),
                up.alias("pred"), F.col("up").alias("p_up"), F.col("value").alias("pred_mag"), F.col("size").alias("y_mag"))
            fits.append(FittedTransition(p["spec"], names[p["spec"].name], columns, by[g, "up"], by.get((g, "size")), scored,
                                         {k: v for k, v in loss[g].asDict().items() if k != "group"}))
    name = F.coalesce(*[F.when(F.col("group") == g, F.struct(F.lit(p["spec"].name).alias(KEY), F.lit(p["fold"]).cast("int").alias("fold"))) for g, p in enumerate(parts)])
    hit = (up == F.signum("size").cast("int")).cast("double")
    table = told.groupBy("group").agg(F.count(F.lit(1)).alias("n_test"), F.avg(hit).alias("accuracy")).select(name.alias("p"), "n_test", "accuracy")
    return Study(fits, materialize(table.where("p.fold IS NOT NULL").select(f"p.{KEY}", "p.fold", "n_test", "accuracy")) if folds else None)


def usable_transitions(wide: DataFrame, names: Sequence[str] | None = None, min_rows: int = 500):
    """F8 decided on the driver from one aggregate (<= 7 counts)."""
    g = {r[KEY]: r["usable"] for r in DS.transition_guard(wide, min_rows=min_rows).collect()}
    return [t for t in TRANSITIONS if g.get(t.name) and (names is None or t.name in names)]


def run_models(wide: DataFrame, cfg: ModelConfig = ModelConfig(), names: Sequence[str] | None = None,
               strict_gate: bool = False, regressor: bool = True) -> list[FittedTransition]:
    """M7: every usable transition fitted and scored, without folds."""
    return fit_all(wide, usable_transitions(wide, names, cfg.min_rows), cfg, strict_gate, regressor=regressor).fits


def scored_union(fits: Sequence[FittedTransition]) -> DataFrame:
    out = None
    for f in fits:
        out = f.scored if out is None else out.unionByName(f.scored)
    return out


def walk_forward_all(wide: DataFrame, specs: Sequence[TransitionSpec], cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """M8: expanding folds over all usable rows of every transition, medians
    and cuts of each fold's own training rows; one row per transition and fold."""
    return fit_all(wide, specs, cfg, split=False, folds=True).folds


def importances(spark: SparkSession, fits: Sequence[FittedTransition], top: int = 15) -> DataFrame:
    """How often the classifier splits on a feature, as a share of its
    splits; the ``top`` most frequent per transition."""
    rows = []
    for f in fits:
        used = f.clf.split_counts(len(f.columns))
        order = sorted((k for k, c in enumerate(f.columns) if c in f.features), key=lambda k: (-used[k], k))[:top]
        rows += [(f.spec.name, f.columns[k], float(used[k] / max(used.sum(), 1)), rank) for rank, k in enumerate(order, start=1)]
    return spark.createDataFrame(rows, f"{KEY} string, feature string, importance double, rank int")


def model_performance(fits: Sequence[FittedTransition], scored: DataFrame, cv: DataFrame) -> DataFrame:
    """Transition, spread, test metrics, CV metrics, test size, feature count."""
    meta = scored.sparkSession.createDataFrame([(f.spec.name, f.spec.spread, len(f.features)) for f in fits],
                                               f"{KEY} string, spread string, features int")
    m = MT.accuracy(scored).join(MT.roc_auc(scored), KEY).join(MT.regression_metrics(scored), KEY)
    m = m.select(KEY, F.col("accuracy").alias("test_accuracy"), "roc_auc", "reg_mae", "reg_r2",
                 F.col("n").alias("test_size"))
    out = m.join(F.broadcast(meta), KEY).join(cv, KEY, "left")       # one row per transition of the fixed list
    return out.select(KEY, "spread", "test_accuracy", "roc_auc", "cv_accuracy", "cv_std", "reg_mae", "reg_r2",
                      "test_size", "features")
