"""Session helpers: a local session for tests/bench and the checkpoint folder rule."""
from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "spreadforge") -> SparkSession:
    """Session used by tests and bench (UI off, UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPREADFORGE_DRIVER_MEM", "16g"))
        .config("spark.sql.codegen.maxFields", "400")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # generated methods above the JIT's 8 kB limit would run interpreted
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.  Where it is unset, a local master
    (tests, bench) gets a fresh scratch folder, removed at exit; on a cluster
    executors would each write to their own disk, so that raises."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="spreadforge-ckpt-", dir="/tmp")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    return path


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, inside the shared checkpoint
    folder; every call has its own."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{uuid.uuid4().hex}/{name}"


#: folders written by ``materialize`` and not yet released
_WRITTEN: list[str] = []


def materialize(df):
    """Cut lineage by writing ``df`` as a parquet table into the shared
    checkpoint folder (``spark.checkpoint.dir``) and reading it back.

    Unlike ``Dataset.checkpoint`` (which keeps one file and one partition per
    shuffle partition, 200 by default, even for a 2 500-row table), the write
    goes through adaptive execution and the read-back is split by
    ``spark.sql.files.maxPartitionBytes``, so partitioning follows the data
    size.  A lost executor re-reads the table instead of recomputing upstream
    stages.  ``release`` deletes the tables once nothing reads them."""
    spark = df.sparkSession
    path = scratch_dir(spark, "table")
    df.write.mode("overwrite").parquet(path)
    _WRITTEN.append(path)
    return spark.read.parquet(path)


def mark() -> int:
    """A point that ``release`` can go back to."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables materialised after ``since``; results that read them
    must have been written or collected."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while len(_WRITTEN) > since:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop()).getParent()
        path.getFileSystem(conf).delete(path, True)
