"""Scalar helpers: missing-value normalisation, row-wise ensemble statistics,
safe division, sign and clip."""
from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """Column by exact name (names may contain spaces or dots)."""
    return F.col(f"`{name}`")


def normalise_missing(df: DataFrame, blank: str = " ") -> DataFrame:
    """Map every 'missing' spelling to SQL NULL in one projection: NaN in
    floating columns and a single blank cell in text columns."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        elif isinstance(f.dataType, T.StringType):
            c = F.nullif(c, F.lit(blank))
        out.append(c.alias(f.name))
    return df.select(*out)


def safe_div(num: Column, den: Column) -> Column:
    """x / y with NULL for y = 0 (ANSI mode would raise)."""
    return F.try_divide(num, den)


def _nn(cols: Iterable[Column]) -> list[Column]:
    return [F.when(c.isNotNull(), F.lit(1)).otherwise(F.lit(0)) for c in cols]


def row_mean(cols: list[Column]) -> Column:
    """Mean over the non-missing values of a row (NULL if none)."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    n = reduce(lambda a, b: a + b, _nn(cols))
    return F.when(n > 0, total / n)


def row_std(cols: list[Column]) -> Column:
    """Sample standard deviation (n-1) over the non-missing values of a row,
    two-pass; NULL with fewer than two values."""
    n = reduce(lambda a, b: a + b, _nn(cols))
    m = row_mean(cols)
    ss = reduce(lambda a, b: a + b,
                [F.when(c.isNotNull(), (c - m) * (c - m)).otherwise(F.lit(0.0)) for c in cols])
    return F.when(n >= 2, F.sqrt(ss / (n - 1)))


def row_range(cols: list[Column]) -> Column:
    """max - min over the non-missing values of a row."""
    return F.greatest(*cols) - F.least(*cols)


def sign_int(c: Column) -> Column:
    return F.signum(c).cast("int")


def clip(c: Column, lo: float | Column, hi: float | Column) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.least(F.greatest(c, lo), hi)
