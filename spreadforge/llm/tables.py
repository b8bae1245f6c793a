"""Small Spark helpers shared by the operators of this subpackage."""
from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadforge.session import materialize

__all__ = ["fresh", "materialize", "release", "row_id", "shuffles_dropped", "table", "shuffled"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def shuffled(df: DataFrame) -> DataFrame:
    """This side of a join grows with the data, so it is never broadcast: the
    join is planned alike at every size, and a skewed key is split at run
    time."""
    return df.hint("merge")


def row_id(*columns: str | Column) -> Column:
    """128 bits that stand for a row's values, null told apart from any value.
    Rows equal in all the columns share it: they are repeated rows."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    parts = [x for c in cols for x in (c, c.isNull())]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(7), *parts).alias("b"))


def release(*tables: DataFrame) -> None:
    """Delete materialised tables; whatever was made from them must have been
    written by now."""
    for df in tables:
        spark = df.sparkSession
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path.getParent(), True)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files go when the table that they were for is written, and not
    when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
