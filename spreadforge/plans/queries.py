"""Driver query registry: each entry is (spark_fn(spark, sf_dir) -> DataFrame,
oracle SQL or None).  Every query reads the given tables (or tables Spark
derives from them) in full."""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadforge.plans import oracle as O

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def finalize(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, small integers widened to BIGINT (mirrors ``oracle.final``)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # floor(x * 10^d + 0.5) / 10^d: the same IEEE operations in both
            # engines, so the rounded doubles are bit-identical
            m = float(10 ** digits)
            # (a double of 2**52 or more has no fraction to round)
            c = F.when(F.abs(c * m) < float(1 << 52), F.floor(c * m + 0.5) / m).otherwise(c.cast("double"))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)
