from pyspark.sql import functions as F

from petrichor.functions import indices
from petrichor.operators import masks


def test_row_wise_operators_run_on_a_stream(spark, tmp_path):
    src = spark.range(20).select(F.col("id").cast("int").alias("SCL"), F.lit(0).alias("cloud_mask"), (F.col("id") * 700.0).alias("B08"), (F.col("id") * 100.0).alias("B04"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))

    def apply(df):
        clean = masks.clean_bands(masks.quality_masks(df))
        return indices.add_indices(clean, ["NDVI", "kNDVI"]).select("mask_strict", "NDVI", "kNDVI")

    q = apply(stream).writeStream.format("memory").queryName("stream_out").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(str, spark.table("stream_out").collect())) == sorted(map(str, apply(spark.read.parquet(str(tmp_path / "in"))).collect()))


def test_streamed_bins_late_rows_and_restart(spark, tmp_path):
    """Rows out of order and late ones update their bin, rows behind the watermark don't, and a stopped stream goes on."""
    import datetime as dt

    from petrichor.operators import timegrid
    from petrichor.streaming import bins

    day = lambda d, h=0: dt.datetime(2024, 1, 1, h) + dt.timedelta(days=d)
    schema = "c string, px int, t timestamp, v double, m int"
    files = [
        [("a", 1, day(0), 1.0, 1), ("a", 1, day(12), 5.0, 1), ("b", 2, day(3), 7.0, 0)],
        [("a", 1, day(2), 3.0, 1), ("a", 1, day(1), 9.0, 0), ("b", 2, day(4, 23), None, 1)],  # late, within the watermark
        [("a", 1, day(60), 2.0, 1)],
        [("a", 1, day(1), 100.0, 1), ("a", 1, day(61), 4.0, 1)],  # 60 days late: ignored
    ]
    src, log, origin = str(tmp_path / "in"), str(tmp_path / "log"), dt.date(2024, 1, 3)
    rows = [r for f in files for r in f]

    def push(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)

    def stream():
        return bins.streamed_median(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), cube=["c"], pixel=["px"], time="t", values=["v"], origin=origin, mask="m", watermark="20 days")

    for part in files:  # every start is a restart from the checkpoint
        push(part)
        binned = stream()
        bins.start_log(binned, log, str(tmp_path / "state")).awaitTermination()
    keys = ["c", "px", "bin"]
    got = {tuple(r) for r in bins.newest(spark, log, binned, keys).collect()}
    kept = spark.createDataFrame([r for r in rows if r[3] != 100.0], schema)
    want = timegrid.resample_median(kept, cube=["c"], pixel=["px"], time="t", values=["v"], origin=F.lit(origin), mask="m")
    assert got == {tuple(r) for r in want.select(*keys, "v", "n").collect()}
