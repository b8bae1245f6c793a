"""The end-to-end batch job (load -> clean -> spreads -> features ->
models -> backtest -> result tables), as one function for ``spark-submit``.

The engineered feature table and the scored rows are written as tables into
the cluster's shared ``spark.checkpoint.dir`` (set only when missing, e.g. in
tests) and read back, which cuts the lineage of the windowed feature stage: a
lost executor re-reads the table instead of recomputing it."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spreadforge.config import JobConfig
from spreadforge.operators import backtest as BT
from spreadforge.operators import metrics as MT
from spreadforge.operators import models as M
from spreadforge.operators.clean import clean_market_data
from spreadforge.operators.features import engineer_features
from spreadforge.operators.spreads import add_spreads_and_fundamentals
from spreadforge.session import ensure_checkpoint_dir, materialize
from spreadforge.sources.market import load_market_data, write_table


def build_features(raw: DataFrame) -> DataFrame:
    return engineer_features(add_spreads_and_fundamentals(clean_market_data(raw)))


def run(spark: SparkSession, raw: DataFrame | str, out_dir: str | None = None,
        cfg: JobConfig = JobConfig()) -> dict[str, DataFrame]:
    """Run the study; returns (and, with ``out_dir``, writes) the result tables
    ``trading_results_all_thresholds``, ``leaderboard``, ``model_performance``."""
    ensure_checkpoint_dir(spark)
    if isinstance(raw, str):
        raw = load_market_data(spark, raw)
    wide = materialize(build_features(raw))
    specs = M.usable_transitions(wide, cfg.transitions, cfg.model.min_rows)
    study = M.fit_all(wide, specs, cfg.model, cfg.strict_gate, folds=True)
    fits, scored = study.fits, M.scored_union(study.fits)
    cv = MT.cv_summary(study.folds)
    perf = materialize(M.model_performance(fits, scored, cv))
    metrics = perf.select("transition", BT.F.bround("test_accuracy", 4).alias("test_accuracy"),
                          BT.F.bround("roc_auc", 4).alias("roc_auc"), BT.F.bround("cv_accuracy", 4).alias("cv_accuracy"),
                          BT.F.bround("cv_std", 4).alias("cv_std"), BT.F.bround("reg_r2", 4).alias("reg_r2"),
                          BT.F.bround("reg_mae", 4).alias("reg_mae"))
    trading = materialize(BT.trading_table(scored, cfg.backtest))
    board = BT.leaderboard(trading, metrics)
    out = {"trading_results_all_thresholds": trading.drop("test_size", "pct_traded"),
           "leaderboard": board, "model_performance": perf}
    if out_dir:
        for name, df in out.items():
            write_table(df, f"{out_dir.rstrip('/')}/{name}", "csv", single_file=True)
    return out
