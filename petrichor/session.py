"""Session defaults for local runs. On a cluster the submitted configuration wins; nothing here overrides it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int | None = None, **extra: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("petrichor")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # call-site capture costs several gateway round trips per column function
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def reused(df: DataFrame) -> DataFrame:
    """Keep a table that a plan reads several times, in memory with spill to disk; a lost block is recomputed
    from its lineage. Nothing runs yet. ``spark.catalog.clearCache()`` after the job frees all of them."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def spread(df: DataFrame, rows: int = 64) -> DataFrame:
    """Rows with large arrays on their way to Python: dealt out evenly, and few in one Arrow batch."""
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
    return df.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def scratch_root(spark: SparkSession) -> str:
    """The folder below which this application's intermediate tables lie: one per run, below the folder that driver
    and executors share (``spark.checkpoint.dir``).

    Only a local session without that setting gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/petrichor-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the run's root."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> bool:
    """Drop all intermediate tables of this application; for the caller, once its results are written elsewhere."""
    root = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """The table as Parquet in the shared folder, read again: lineage ends here, and its files outlive any executor."""
    path = shared_folder(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
