"""Load a market table (parquet / CSV by suffix), drop a written-out
index column, transcode, write result tables, profile."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadforge.functions.scalar import col, normalise_missing

TEXT_COLUMNS = ("TradeDate", "Time", "StartDateTime")


def drop_index_column(df: DataFrame) -> DataFrame:
    """Drop a written-out pandas index ('Unnamed: 0'), or Spark's name for an
    empty first CSV header ('_c0') when it is the first column."""
    drop = [c for c in df.columns if c == "Unnamed: 0"]
    if df.columns and df.columns[0] == "_c0":
        drop.append("_c0")
    return df.drop(*drop) if drop else df


def _type_csv(df: DataFrame, text_columns=TEXT_COLUMNS) -> DataFrame:
    """CSV columns arrive as text: keep the time text columns, coerce every other
    column to double in one projection (bad cells -> NULL), no inference pass."""
    return df.select(*[
        col(c) if c in text_columns else F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c)
        for c in df.columns
    ])


def load_market_data(spark: SparkSession, path: str, schema: T.StructType | None = None,
                     normalise: bool = True) -> DataFrame:
    """Read parquet or CSV (decided by the case-insensitive suffix); any other
    suffix raises ``ValueError``.  Missing spellings are normalised to NULL."""
    p = path.rstrip("/")
    suffix = p.rsplit(".", 1)[-1].lower() if "." in p.rsplit("/", 1)[-1] else ""
    if suffix == "parquet":
        df = spark.read.parquet(path)
    elif suffix == "csv":
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
        if schema is not None:
            df = reader.schema(schema).csv(path)
        else:
            df = _type_csv(drop_index_column(reader.csv(path)))
    else:
        raise ValueError("Input data must be a .parquet or .csv file")
    df = drop_index_column(df)
    return normalise_missing(df) if normalise else df


def write_table(df: DataFrame, path: str, fmt: str = "csv", single_file: bool = False) -> None:
    """Write a result table; ``single_file`` only for small result tables."""
    out = df.coalesce(1) if single_file else df
    w = out.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def csv_roundtrip(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Transcode a table to header CSV (a distributed write) and read it back
    through the CSV loader."""
    write_table(df, path, "csv")
    return load_market_data(spark, path.rstrip("/") + "/*.csv" if not path.endswith(".csv") else path)


def table_profile(df: DataFrame, ts: str = "ts") -> DataFrame:
    """rows, columns, dtype counts and the time range, as one row."""
    kinds = {"double": 0, "string": 0, "timestamp": 0, "integer": 0, "other": 0}
    for f in df.schema.fields:
        dt = f.dataType
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            kinds["double"] += 1
        elif isinstance(dt, T.StringType):
            kinds["string"] += 1
        elif isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            kinds["timestamp"] += 1
        elif isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            kinds["integer"] += 1
        else:
            kinds["other"] += 1
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if ts in df.columns:
        aggs += [F.min(col(ts)).alias("ts_min"), F.max(col(ts)).alias("ts_max")]
    prof = df.agg(*aggs)
    return prof.select(
        "*",
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        *[F.lit(v).cast("bigint").alias(f"n_{k}") for k, v in kinds.items()],
    )
