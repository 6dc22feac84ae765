"""The event-anchored 5-day bins as a stream: state per (cube, pixel, bin), a watermark, late rows.

The bins are those of ``timegrid.resample_median`` and ``climate.resample_stats``. A micro-batch updates the bins that its
rows fall into, whatever their order; a bin's state is dropped once the watermark has passed its end, and rows later
than that are ignored. The sink is a log of updates: the newest update of a bin is its value.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from petrichor.functions.scalar import BIN_DAYS

EPOCH = datetime.date(1970, 1, 1)


def _window(time: str, origin: datetime.date, days: int) -> Column:
    offset = (origin - EPOCH).days % days
    return F.window(F.col(time), f"{days} days", startTime=f"{offset} days")


def _binned(df: DataFrame, *, keys: list[str], time: str, origin: datetime.date, days: int, watermark: str, aggs: list[Column]) -> DataFrame:
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")  # bins begin at midnight of the session's clock
    rows = df.withColumn(time, F.to_utc_timestamp(F.col(time).cast("timestamp"), zone)).withWatermark(time, watermark)
    out = rows.groupBy(*keys, _window(time, origin, days).alias("_w")).agg(*aggs)
    return out.select(*keys, F.date_from_unix_date(F.floor(F.unix_seconds("_w.end") / F.lit(86_400)).cast("int")).alias("bin"), *[c for c in out.columns if c not in (*keys, "_w")])


def streamed_median(df: DataFrame, *, cube: list[str], pixel: list[str], time: str, values: list[str], origin: datetime.date, mask: str | None = None, days: int = BIN_DAYS, watermark: str = "30 days") -> DataFrame:
    """``timegrid.resample_median`` of a stream: a pixel's bin holds a handful of acquisitions, whose values are the state."""
    cols = {v: F.when(F.col(mask) == 1, F.col(v)) if mask else F.col(v) for v in values}
    aggs = [F.percentile(c.cast("double"), F.lit(0.5)).alias(v) for v, c in cols.items()]
    return _binned(df, keys=[*cube, *pixel], time=time, origin=origin, days=days, watermark=watermark, aggs=[*aggs, F.count(F.lit(1)).alias("n")])


def streamed_stats(df: DataFrame, *, cube: list[str], time: str, values: list[str], origin: datetime.date, days: int = BIN_DAYS, watermark: str = "30 days") -> DataFrame:
    """``climate.resample_stats`` of a stream: sums, counts and extremes are the state."""
    aggs = [f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return _binned(df, keys=cube, time=time, origin=origin, days=days, watermark=watermark, aggs=aggs)


def start_log(binned: DataFrame, path: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Append every micro-batch's updated bins with the batch's number. A batch that is run again after a failure
    replaces its own files."""

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = binned.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(append)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def newest(spark: SparkSession, path: str, binned: DataFrame, keys: list[str]) -> DataFrame:
    """The bins' values: the last update of each."""
    rest = [c for c in binned.columns if c not in keys]
    log = spark.read.schema(StructType([*binned.schema.fields, StructField("batch", LongType())])).parquet(path)
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_v")).select(*keys, "_v.*")
