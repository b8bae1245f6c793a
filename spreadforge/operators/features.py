"""Feature stage: P4-P5 calendar, P14-P21 ensemble / revision / cross-border
features, W1-W3 lags and shifted rolling statistics (chunk-and-halo)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadforge.config import GB_PRICES, HORIZONS, LAG_BASES, LAG_FEATURES, REVISIONS, WIND_PROVIDERS
from spreadforge.functions.calendar import add_calendar, add_cyclical
from spreadforge.functions.scalar import col, row_mean, row_range, row_std, safe_div
from spreadforge.operators.ordered import DEFAULT_CHUNK, halo_rolling, row_index

LAG_REACH = max(shift + (rows or 0) - 1 if rows else shift for _, shift, _, rows, _ in LAG_FEATURES)


def ensemble_features(df: DataFrame) -> DataFrame:
    """Wind consensus (mean), uncertainty (sample std), range and the
    EirGrid deviation, per horizon with at least two providers present."""
    cols = set(df.columns)
    out = {}
    for s in HORIZONS:
        cands = [p.format(s=s) for p in WIND_PROVIDERS if p.format(s=s) in cols]
        if len(cands) < 2:
            continue
        cc = [col(c) for c in cands]
        out[f"wind_consensus_{s}"] = row_mean(cc)
        out[f"wind_uncertainty_{s}"] = row_std(cc)
        out[f"wind_range_{s}"] = row_range(cc)
        if f"EirGridWindFc_{s}" in cols:
            out[f"wind_eirg_dev_{s}"] = col(f"EirGridWindFc_{s}") - row_mean(cc)
    return df.withColumns(out) if out else df


def disagreement_and_revisions(df: DataFrame) -> DataFrame:
    """P18 demand disagreement (Meteo - EirGrid) and P19 forecast revisions."""
    cols = set(df.columns)
    out = {}
    for s in HORIZONS:
        m, e = f"Meteo_ISEMDEMAND_{s}", f"EirGridDemandFc_{s}"
        if m in cols and e in cols:
            out[f"demand_disagreement_{s}"] = col(m) - col(e)
    for name, a, b in REVISIONS:
        if a in cols and b in cols:
            out[name] = col(a) - col(b)
    return df.withColumns(out) if out else df


def renewables_cross_border(df: DataFrame) -> DataFrame:
    """P20 renewable penetration (wind + solar) / (demand + 1); P21 GB - PriceDAM."""
    cols = set(df.columns)
    out = {}
    for s in HORIZONS:
        d, w, so = f"EirGridDemandFc_{s}", f"EirGridWindFc_{s}", f"ISEMSOLAR_{s}"
        if all(c in cols for c in (d, w, so)):
            out[f"ren_pct_{s}"] = safe_div(col(w) + col(so), col(d) + F.lit(1.0))
    for gb in GB_PRICES:
        if gb in cols:
            out[f"GB_vs_IRL_{gb.replace(' ', '_')}"] = col(gb) - col("PriceDAM")
    return df.withColumns(out) if out else df


def add_lag_features(df: DataFrame, idx: str = "idx", by=None, bases: list[str] | None = None,
                     spread_lags: bool = False, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """W1-W3 by row position: lags 48/96/336, shifted 336-row mean and sample std
    (min 24), shifted 672-row mean (min 48).  Spread lags are dead features in
    the reference (always excluded by the ``spr_`` prefix) and are only built
    on request."""
    if bases is None:
        bases = [c for c in LAG_BASES if c in df.columns]
        if spread_lags:
            bases = [c for c in df.columns if c.startswith("spr_")] + bases
    lags, rolls = {}, {}
    for base in bases:
        for sfx, shift, kind, rows, minp in LAG_FEATURES:
            if kind == "lag":
                lags[f"{base}{sfx}"] = (base, shift)
            else:
                rolls[f"{base}{sfx}"] = (base, shift, rows, minp, kind)
    return halo_rolling(df, idx, lags, rolls, by=by, chunk=chunk)


def engineer_features(df: DataFrame, by=None, ts: str = "ts", idx: str = "idx",
                      spread_lags: bool = False, chunk: int = DEFAULT_CHUNK, regularise: bool = False) -> DataFrame:
    """Whole feature stage.  Adds ``idx`` (row position per series) when absent.
    Lags are by row position (as published); ``regularise=True`` first fills
    the half-hour calendar so that 48 rows are always 24 hours."""
    if regularise:
        from spreadforge.operators.ordered import regular_calendar
        df = regular_calendar(df, ts, by=by)
        if "hod" in df.columns:
            df = df.withColumn("hod", F.hour(col(ts)) + F.minute(col(ts)) / F.lit(60.0))
    df = add_cyclical(add_calendar(df, ts=ts))
    df = ensemble_features(df)
    df = disagreement_and_revisions(df)
    if idx not in df.columns:
        df = row_index(df, ts, by=by, name=idx)
    df = add_lag_features(df, idx=idx, by=by, spread_lags=spread_lags, chunk=chunk)
    return renewables_cross_border(df)
