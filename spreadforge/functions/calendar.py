"""Time axis: coercing parse of the market clock, clock parts, calendar flags,
cyclical encodings."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadforge.functions.scalar import col

_TS_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")


def _parse_timestamp(c: Column, dtype: T.DataType) -> Column:
    """Coercing parse to TIMESTAMP_NTZ: bad text gives NULL, typed input is cast."""
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    txt = F.trim(c.cast("string"))
    parsed = F.coalesce(*[F.try_to_timestamp(txt, F.lit(fmt)) for fmt in _TS_FORMATS])
    return parsed.cast("timestamp_ntz")


def _parse_clock(c: Column, dtype: T.DataType) -> Column:
    """Time of day as canonical 'HH:mm:ss' text, NULL when it does not parse."""
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        return F.date_format(c, "HH:mm:ss")
    t = F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), F.trim(c.cast("string"))),
                           F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.date_format(t, "HH:mm:ss")


def parse_market_time(df: DataFrame, date_col: str = "TradeDate", time_col: str = "Time",
                      start_col: str = "StartDateTime", out: str = "ts") -> DataFrame:
    """Coerce the date, time-of-day and start columns, then build ``ts`` from the
    date text + ' ' + time text (NULL if either part is missing)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    repl = {
        date_col: _parse_timestamp(col(date_col), types[date_col]),
        time_col: _parse_clock(col(time_col), types[time_col]),
        start_col: _parse_timestamp(col(start_col), types[start_col]),
    }
    df = df.withColumns(repl)
    ts_text = F.concat(F.date_format(col(date_col), "yyyy-MM-dd"), F.lit(" "), col(time_col))
    ts = F.try_to_timestamp(ts_text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return df.withColumn(out, ts)


def add_clock_parts(df: DataFrame, ts: str = "ts") -> DataFrame:
    """hour, minute and fractional hour of day ``hod``."""
    return df.withColumns({
        "hour": F.hour(col(ts)),
        "minute": F.minute(col(ts)),
        "hod": F.hour(col(ts)) + F.minute(col(ts)) / F.lit(60.0),
    })


def add_calendar(df: DataFrame, ts: str = "ts", hod: str = "hod") -> DataFrame:
    """dow (Monday = 0), month, is_weekend, is_winter, is_peak (7 <= hod <= 21)."""
    dow = F.weekday(col(ts))
    month = F.month(col(ts))
    return df.withColumns({
        "dow": dow,
        "month": month,
        "is_weekend": (dow >= 5).cast("int"),
        "is_winter": month.isin(11, 12, 1, 2, 3).cast("int"),
        "is_peak": col(hod).between(7, 21).cast("int"),
    })


def cyclical(c: Column, period: float) -> tuple[Column, Column]:
    ang = F.lit(2 * math.pi) * c / F.lit(float(period))
    return F.sin(ang), F.cos(ang)


def add_cyclical(df: DataFrame) -> DataFrame:
    """sin/cos of hod/24, dow/7, month/12."""
    out = {}
    for name, src, period in (("hour", "hod", 24), ("dow", "dow", 7), ("month", "month", 12)):
        s, c = cyclical(col(src), period)
        out[f"{name}_sin"] = s
        out[f"{name}_cos"] = c
    return df.withColumns(out)
