"""Cleaning stage: F1, P1-P3, A1/J1, P6-P10, F2."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadforge.config import IDA2_WINDOW, IDA3_WINDOW, MUST_HAVE, MUST_HAVE_PRICES
from spreadforge.functions.calendar import add_clock_parts, parse_market_time
from spreadforge.functions.scalar import col, normalise_missing

FLOW = "PredictedICFlow"


def dedup_rows(df: DataFrame) -> DataFrame:
    """full-row de-duplication (missing equals missing).  Exact copies are
    combined map-side, so a heavily copied row never lands whole in one task."""
    return df.dropDuplicates()


def _order_key(df: DataFrame, order_col: str | None) -> Column:
    if order_col:
        return col(order_col)
    # reproducible but arbitrary order among colliding rows
    return F.xxhash64(*[col(c) for c in df.columns])


def collapse_duplicate_ts(df: DataFrame, ts: str = "ts", flow: str = FLOW,
                          order_col: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """A1: one row per ``ts`` (and series key ``by``): the first non-missing value of every column (order
    given by ``order_col``), and the mean of ``flow``.  Rows without a
    timestamp are dropped.  One aggregate replaces the reference's two
    group-bys plus self-join (J1); every aggregate merges map-side."""
    if flow not in df.columns:
        return df
    ordk = _order_key(df, order_col)
    d = df.where(col(ts).isNotNull()).withColumn("__ord", ordk)
    base_cols = [c for c in df.columns if c not in (ts, flow, order_col, *by)]
    aggs = [F.min_by(col(c), F.when(col(c).isNotNull(), F.col("__ord"))).alias(c)
            for c in base_cols]
    aggs.append(F.avg(col(flow)).alias(flow))
    out = d.groupBy(*[col(b).alias(b) for b in by], col(ts).alias(ts)).agg(*aggs)
    return out.select(*by, ts, *base_cols, flow)


def collapse_via_join(df: DataFrame, ts: str = "ts", flow: str = FLOW,
                      order_col: str | None = None) -> DataFrame:
    """J1 as written in the reference: first-per-ts base left-joined to the
    per-ts mean flow (kept to test equivalence with A1)."""
    ordk = _order_key(df, order_col)
    d = df.where(col(ts).isNotNull()).withColumn("__ord", ordk)
    base_cols = [c for c in df.columns if c not in (ts, flow, order_col)]
    base = d.groupBy(ts).agg(*[F.min_by(col(c), F.when(col(c).isNotNull(), F.col("__ord"))).alias(c)
                               for c in base_cols])
    ic = d.groupBy(ts).agg(F.avg(col(flow)).alias(flow))
    return base.join(ic, ts, "left").select(ts, *base_cols, flow)


def clip_negative(df: DataFrame, column: str = "EirgridActualWind") -> DataFrame:
    """Negative values of ``column`` become 0."""
    if column not in df.columns:
        return df
    return df.withColumn(column, F.when(col(column) < 0, F.lit(0.0)).otherwise(col(column)))


def must_have_columns(columns: list[str]) -> list[str]:
    cols = list(MUST_HAVE) + [c for c in MUST_HAVE_PRICES if c in columns]
    return [c for c in cols if c in columns]


def fill_and_cascade(df: DataFrame) -> DataFrame:
    """P8 solar DAM/IDA1 -> 0; P9 wind DAM/IDA1 EirGrid -> EmSys_U -> Meteo -> 0
    (only when all three providers exist)."""
    cols = set(df.columns)
    repl = {}
    for s in ("DAM", "IDA1"):
        if f"ISEMSOLAR_{s}" in cols:
            repl[f"ISEMSOLAR_{s}"] = F.coalesce(col(f"ISEMSOLAR_{s}"), F.lit(0.0))
        trio = [f"EirGridWindFc_{s}", f"EmSys_U_ISEMWIND_{s}", f"Meteo_ISEMWIND_{s}"]
        if all(c in cols for c in trio):
            repl[trio[0]] = F.coalesce(*[col(c) for c in trio], F.lit(0.0))
    return df.withColumns(repl) if repl else df


def window_repair(df: DataFrame, hod: str = "hod") -> DataFrame:
    """P10: IDA2 solar NULL outside [11, 23) and 0 where missing inside; IDA3 solar
    0 where missing inside [17, 23) (outside left as is); IDA3 wind inside its
    window EirGrid -> EmSys_U -> Meteo -> 0.  IDA2 wind untouched."""
    cols = set(df.columns)
    h = col(hod)
    ida2 = (h >= IDA2_WINDOW[0]) & (h < IDA2_WINDOW[1])
    ida3 = (h >= IDA3_WINDOW[0]) & (h < IDA3_WINDOW[1])
    repl = {}
    if "ISEMSOLAR_IDA2" in cols:
        repl["ISEMSOLAR_IDA2"] = F.when(ida2, F.coalesce(col("ISEMSOLAR_IDA2"), F.lit(0.0)))
    if "ISEMSOLAR_IDA3" in cols:
        repl["ISEMSOLAR_IDA3"] = F.when(ida3, F.coalesce(col("ISEMSOLAR_IDA3"), F.lit(0.0))) \
            .otherwise(col("ISEMSOLAR_IDA3"))
    trio = ["EirGridWindFc_IDA3", "EmSys_U_ISEMWIND_IDA3", "Meteo_ISEMWIND_IDA3"]
    if all(c in cols for c in trio):
        repl[trio[0]] = F.when(ida3, F.coalesce(*[col(c) for c in trio], F.lit(0.0))) \
            .otherwise(col(trio[0]))
    return df.withColumns(repl) if repl else df


def must_have_filter(df: DataFrame) -> DataFrame:
    """drop rows missing any must-have column present in the table."""
    return df.dropna("any", subset=must_have_columns(df.columns))


def clean_market_data(df: DataFrame, order_col: str | None = None, stop: str | None = None,
                      by: Sequence[str] = ()) -> DataFrame:
    """Whole cleaning stage, in the published order; returns one row per ``ts``
    and series key ``by`` (order is carried by ``ts``, no global sort).  ``stop`` ('parsed',
    'collapse', 'must_have') returns an intermediate stage."""
    df = dedup_rows(df)
    df = parse_market_time(df)
    df = add_clock_parts(df)
    if stop == "parsed":
        return df
    df = collapse_duplicate_ts(df, order_col=order_col, by=by)
    if order_col and order_col in df.columns:
        df = df.drop(order_col)
    if stop == "collapse":
        return df
    df = clip_negative(df)
    df = normalise_missing(df)
    df = fill_and_cascade(df)
    df = must_have_filter(df)
    if stop == "must_have":
        return df
    df = window_repair(df)
    return df.drop("Time") if "Time" in df.columns else df
