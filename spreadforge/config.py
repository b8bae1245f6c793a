"""Fixed values of the study (must equal the published method) and job settings."""
from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (published method constants; keep exactly as stated).
# ---------------------------------------------------------------------------
RANDOM_STATE = 42
LAG_BURNIN = 48 * 14            # 672 half-hours of lag warm-up
BEST_THRESH = 0.20
CONF_THRESHOLDS = (0.0, 0.05, 0.10, 0.15, 0.20)
MAX_VOLUME = 10.0
MIN_VOLUME = 0.1
SIZE_FLOOR = 0.5                # floor of the 25th-percentile sizing base
TEST_FRACTION = 0.20
CV_SPLITS = 5
MIN_SPREAD_ROWS = 500
IDA2_WINDOW = (11.0, 23.0)
IDA3_WINDOW = (17.0, 23.0)
ALWAYS_EXCLUDE = ("ts", "TradeDate", "StartDateTime", "Time", "PriceImbalance")
TARGET_PREFIXES = ("spr_", "dir_", "NetD_q_")
TIME_FEATURES = ("hod", "hour", "dow", "month", "is_weekend", "is_winter", "is_peak",
                 "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos")
MUST_HAVE = ("ts", "TradeDate", "Time", "hour", "minute", "hod", "EirgridActualDemand",
             "EirgridActualWind", "NIV_Actual", "TotalPN", "Aggregated Forecast",
             "EirGridDemandFc_DAM", "EirGridDemandFc_IDA1")
MUST_HAVE_PRICES = ("PriceDAM", "PriceIDA1", "PriceImbalance")
HORIZONS = ("DAM", "IDA1", "IDA2", "IDA3")
# spreads: (name, later market price, earlier market price); BM = PriceImbalance
SPREADS = (
    ("spr_IDA1_DAM", "PriceIDA1", "PriceDAM"),
    ("spr_BM_IDA1", "PriceImbalance", "PriceIDA1"),
    ("spr_BM_DAM", "PriceImbalance", "PriceDAM"),
    ("spr_IDA2_IDA1", "PriceIDA2", "PriceIDA1"),
    ("spr_IDA3_IDA2", "PriceIDA3", "PriceIDA2"),
    ("spr_BM_IDA2", "PriceImbalance", "PriceIDA2"),
    ("spr_BM_IDA3", "PriceImbalance", "PriceIDA3"),
)
# forecast revisions: (output, minuend, subtrahend) -- signs as published
REVISIONS = (
    ("wind_revision_IDA1_DAM", "EirGridWindFc_DAM", "EirGridWindFc_IDA1"),
    ("wind_revision_IDA2_IDA1", "EirGridWindFc_IDA1", "EirGridWindFc_IDA2"),
    ("wind_revision_IDA3_IDA2", "EirGridWindFc_IDA2", "EirGridWindFc_IDA3"),
    ("demand_revision_IDA1_DAM", "EirGridDemandFc_IDA1", "EirGridDemandFc_DAM"),
    ("demand_revision_IDA2_IDA1", "EirGridDemandFc_IDA1", "EirGridDemandFc_IDA2"),
    ("demand_revision_IDA3_IDA2", "EirGridDemandFc_IDA2", "EirGridDemandFc_IDA3"),
)
WIND_PROVIDERS = ("Meteo_ISEMWIND_{s}", "EmSys_C_ISEMWIND_{s}", "EmSys_U_ISEMWIND_{s}",
                  "EirGridWindFc_{s}")
GB_PRICES = ("GB DAM Epex", "GB DAM N2EX", "GB DAM HH Epex")
LAG_BASES = ("PriceDAM", "PriceIDA1", "PriceIDA2", "PriceIDA3", "NetDemand_DAM",
             "NetDemand_IDA1", "NetDemand_IDA2", "NetDemand_IDA3", "TotalPN")
# (suffix, shift, kind, window rows, min periods)
LAG_FEATURES = (
    ("_lag1d", 48, "lag", None, None),
    ("_lag2d", 96, "lag", None, None),
    ("_lag7d", 336, "lag", None, None),
    ("_ma7d", 48, "mean", 336, 24),
    ("_std7d", 48, "std", 336, 24),
    ("_ma14d", 48, "mean", 672, 48),
)
VALIDITY_INCLUDE = ("WIND", "SOLAR", "DEMAND", "LOAD", "FORECAST", "METER")
VALIDITY_EXCLUDE = ("FLOW", "NIV", "PRICE", "SPREAD", "IMBAL")
MODEL_PARAMS = dict(n_estimators=800, learning_rate=0.03, max_depth=6, num_leaves=63,
                    min_child_samples=30, subsample=0.8, colsample_bytree=0.7,
                    reg_alpha=0.1, reg_lambda=1.0, random_state=42)


@dataclass(frozen=True)
class TransitionSpec:
    name: str
    spread: str
    tokens: tuple[str, ...]
    always: tuple[str, ...]
    window: str | None = None


_DAM_TOKENS = ("_DAM", "PRICEDAM", "GB_DAM", "GB DAM", "AGGREGATED", "LOADFORECAST", "_MW",
               "PUMPSTORAGE", "TOTALPN", "NetDemand_DAM", "GB_VS_IRL")
_IDA1_TOKENS = ("_DAM", "_IDA1", "PRICEDAM", "PRICEIDA1", "LOADFORECAST", "_MW", "PUMPSTORAGE",
                "TOTALPN", "NetDemand_IDA1", "NetDemand_DAM")
_IDA2_TOKENS = ("_DAM", "_IDA1", "_IDA2", "PRICEDAM", "PRICEIDA1", "PRICEIDA2", "LOADFORECAST",
                "_MW", "PUMPSTORAGE", "TOTALPN", "NetDemand_IDA2", "NetDemand_IDA1",
                "NetDemand_DAM")
_IDA3_TOKENS = ("_DAM", "_IDA1", "_IDA2", "_IDA3", "PRICEDAM", "PRICEIDA1", "PRICEIDA2",
                "PRICEIDA3", "LOADFORECAST", "_MW", "PUMPSTORAGE", "TOTALPN", "NetDemand_IDA3",
                "NetDemand_IDA2", "NetDemand_IDA1", "NetDemand_DAM")

TRANSITIONS = (
    TransitionSpec("DAM→IDA1", "spr_IDA1_DAM", _DAM_TOKENS,
                   ("PriceDAM", "AggregatedForecast", "demand_revision_IDA1_DAM",
                    "wind_revision_IDA1_DAM")),
    TransitionSpec("IDA1→BM", "spr_BM_IDA1", _IDA1_TOKENS,
                   ("PriceDAM", "AggregatedForecast", "PredictedICFlow", "PriceIDA1")),
    TransitionSpec("IDA1→IDA2", "spr_IDA2_IDA1", _IDA1_TOKENS,
                   ("PriceDAM", "AggregatedForecast", "PredictedICFlow", "PriceIDA1"),
                   "hod >= 11"),
    TransitionSpec("IDA2→IDA3", "spr_IDA3_IDA2", _IDA2_TOKENS,
                   ("PriceDAM", "PriceIDA1", "PriceIDA2", "PostIDA1Flow", "AggregatedForecast"),
                   "hod >= 17"),
    TransitionSpec("DAM→BM", "spr_BM_DAM", _DAM_TOKENS,
                   ("PriceDAM", "AggregatedForecast", "demand_revision_IDA1_DAM",
                    "wind_revision_IDA1_DAM")),
    TransitionSpec("IDA2→BM", "spr_BM_IDA2", _IDA2_TOKENS,
                   ("PriceDAM", "PriceIDA1", "PriceIDA2", "PostIDA1Flow", "AggregatedForecast"),
                   "hod >= 11"),
    TransitionSpec("IDA3→BM", "spr_BM_IDA3", _IDA3_TOKENS,
                   ("PriceDAM", "PriceIDA1", "PriceIDA2", "PriceIDA3", "PostIDA1Flow",
                    "PostIDA2Flow", "AggregatedForecast"),
                   "hod >= 17"),
)
TRANSITION_BY_NAME = {t.name: t for t in TRANSITIONS}


@dataclass(frozen=True)
class BacktestConfig:
    thresholds: tuple[float, ...] = CONF_THRESHOLDS
    best_threshold: float = BEST_THRESH
    max_volume: float = MAX_VOLUME
    min_volume: float = MIN_VOLUME
    size_floor: float = SIZE_FLOOR
    size_quantile: float = 0.25


@dataclass(frozen=True)
class ModelConfig:
    """Boosting as published, all rounds of it, for the job and the driver queries
    alike.  Published row sampling takes no effect without a sampling frequency,
    so there is none.  A model of up to ``alone_rows`` training rows is grown by one
    task, larger ones level by level over all tasks."""
    max_iter: int = MODEL_PARAMS["n_estimators"]
    step_size: float = MODEL_PARAMS["learning_rate"]
    max_depth: int = MODEL_PARAMS["max_depth"]
    leaves: int = MODEL_PARAMS["num_leaves"]
    min_instances_per_node: int = MODEL_PARAMS["min_child_samples"]
    column_share: float = MODEL_PARAMS["colsample_bytree"]
    l1: float = MODEL_PARAMS["reg_alpha"]
    l2: float = MODEL_PARAMS["reg_lambda"]
    bins: int = 64
    seed: int = RANDOM_STATE
    test_fraction: float = TEST_FRACTION
    cv_splits: int = CV_SPLITS
    burn_in: int = LAG_BURNIN
    min_rows: int = MIN_SPREAD_ROWS
    alone_rows: int = 1 << 17


@dataclass(frozen=True)
class JobConfig:
    backtest: BacktestConfig = field(default_factory=BacktestConfig)
    model: ModelConfig = field(default_factory=ModelConfig)
    transitions: tuple[str, ...] = tuple(t.name for t in TRANSITIONS)
    strict_gate: bool = False
