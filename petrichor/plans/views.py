"""The driver tables seen as cubes: which column plays cube, pixel, time and value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from petrichor.operators.masks import quality_masks
from petrichor.operators.timegrid import bin_span, densify, resample_median

ORIGIN = "2024-01-16"


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def origin():
    return F.lit(ORIGIN).cast("date")


# ---- events: cube = event type, pixel = user -------------------------------------------------------
def event_obs(spark: SparkSession, sf: str) -> DataFrame:
    """cube, px, t, v and two quality codes read from the JSON property (some codes are missing)."""
    k = F.get_json_object("props", "$.k").cast("int")
    df = table(spark, sf, "events")
    return df.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("cube"), F.col("user_id").alias("px"), F.col("ts").alias("t"), F.col("value").alias("v"), k.alias("k"),
        F.when(k < 90, k % 12).alias("SCL"), (k % 15).alias("cloud_mask"),
    )


def event_masked(spark: SparkSession, sf: str) -> DataFrame:
    return quality_masks(event_obs(spark, sf), drop=False)


def event_bins(spark: SparkSession, sf: str, mask: str | None = "mask_strict") -> DataFrame:
    return resample_median(event_masked(spark, sf), cube=["cube"], pixel=["px"], time="t", values=["v"], origin=origin(), mask=mask)


def event_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Dense bins: every pixel has every bin of its cube."""
    span = bin_span(event_obs(spark, sf), cube=["cube"], time="t", origin=origin())
    return densify(event_bins(spark, sf), cube=["cube"], pixel=["px"], span=span)


# ---- embeddings: one vector is an 8 x 8 image ------------------------------------------------------
BAND_SHIFT = {"B03": 0, "B04": 5, "B05": 11, "B06": 17, "B07": 23, "B08": 29, "B11": 37, "B12": 47}


def image_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """cube (label), t (vector), y, x, v; values under -0.2 are gaps."""
    df = table(spark, sf, "embeddings")
    px = df.select(F.col("label").alias("cube"), F.col("vec_id").alias("t"), F.posexplode("embedding").alias("pos", "v"))
    v = F.col("v").cast("double")
    return px.select("cube", "t", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).alias("x"), F.when(v >= -0.2, v).alias("v"))


def image_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Eight raw reflectance bands per pixel (some below 0 and above 10000)."""
    df = table(spark, sf, "embeddings")
    px = df.select(F.col("label").alias("cube"), F.col("vec_id").alias("t"), "embedding", F.posexplode("embedding").alias("pos", "_v"))
    raw = {b: (14000.0 * (0.3 + F.element_at("embedding", ((F.col("pos") + s) % 64 + 1).cast("int")).cast("double"))).alias(b) for b, s in BAND_SHIFT.items()}
    return px.select("cube", "t", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).alias("x"), *raw.values())


# ---- predictions: vectors of one label inside a block of ids are the steps of a cube ----------------
LANDCOVER = [10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100, 0]


def prediction_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """cube_id, step, y, x, pred, true, mask, base, is_veg, esa_lc.

    A block has at most 60 vectors, so the window never sorts a whole label. The last step of a cube has
    no next vector: its prediction is missing.
    """
    df = table(spark, sf, "embeddings").withColumn("blk", F.floor(F.col("vec_id") / 60))
    w = Window.partitionBy("label", "blk").orderBy("vec_id")
    steps = df.select(
        F.concat_ws("-", F.col("label").cast("string"), F.col("blk").cast("string")).alias("cube_id"), F.row_number().over(w).alias("step"),
        F.col("embedding").alias("tv"), F.lead("embedding").over(w).alias("pv"), F.first("embedding").over(w).alias("bv"),
    )
    px = steps.select("cube_id", "step", "pv", "bv", F.posexplode("tv").alias("pos", "tr"))
    at = lambda c: F.try_element_at(F.col(c), F.col("pos") + 1).cast("double")
    px = px.select("cube_id", "step", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).alias("x"), at("pv").alias("pred"), F.col("tr").cast("double").alias("true"), at("bv").alias("base"))
    code = F.element_at(F.array(*[F.lit(c) for c in LANDCOVER]), (F.greatest(F.lit(0), F.least(F.lit(11), F.floor((F.col("base") + 0.6) * 10))) + 1).cast("int"))
    return px.withColumns({"mask": (F.col("true") > -0.15).cast("int"), "is_veg": (F.col("base") > -0.2).cast("int"), "esa_lc": code})


# ---- orders as result tables -----------------------------------------------------------------------
def result_cubes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (configuration = priority, cube = customer) with made-to-measure metrics."""
    o = table(spark, sf, "orders", "o_custkey", "o_orderpriority", "o_totalprice")
    p = F.col("o_totalprice") / 123457.0
    df = o.groupBy(F.col("o_custkey").alias("ck"), F.col("o_orderpriority").alias("configuration")).agg(
        F.avg(p).alias("mae"), F.max(p).alias("mae_base"), F.avg(p * p).alias("mse"), (F.max(p) * F.min(p) + 0.01).alias("mse_base"), (F.avg(p) - F.min(p)).alias("bias"), F.sum(p).alias("total"),
    )
    arch = F.when(F.col("configuration").isin("1-URGENT", "2-HIGH"), "alpha").when(F.col("configuration").isin("4-NOT SPECIFIED", "5-LOW"), "beta")
    inp = F.when(F.col("configuration").isin("1-URGENT", "4-NOT SPECIFIED"), "bands").when(F.col("configuration").isin("2-HIGH", "5-LOW"), "indices")
    return df.select(
        F.col("ck").cast("string").alias("cube_id"), "configuration", (F.col("ck") % 3).cast("int").alias("fold"), arch.alias("architecture"), inp.alias("optical_input"),
        "mae", "mae_base", "mse", "mse_base", "bias", (F.col("mae_base") - F.col("mae")).alias("mae_gain"), (1.0 - F.col("mse") / F.col("mse_base")).alias("mse_skill"),
        F.when(F.col("mae") < 3.2, 1.0 / (1.0 + F.col("mae"))).alias("nnse"), F.when(F.col("mae") < 3.2, 1.0 / (2.0 + F.col("mae"))).alias("nnse_base"),
        (F.col("mae") < 3.2).cast("int").alias("nnse_eligible"), (F.col("mse") < F.col("mse_base")).cast("double").alias("persistence_beaten"),
        (F.col("bias") > 0.5).cast("double").alias("r30_direction_match"), (F.col("total") - 5.0).alias("observed_r30"),
        (F.col("mse") - F.col("mae") * F.col("mae")).alias("target_variance"), (1.0 / (1.0 + F.col("total"))).alias("spatial_valid_fraction"),
    )


# ---- customers as cube metadata --------------------------------------------------------------------
def cube_meta(spark: SparkSession, sf: str) -> DataFrame:
    """cube, location (nation), season (segment), climate (region), c_acctbal."""
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("c_custkey").alias("cube"), F.col("n_name").alias("location"), F.col("c_mktsegment").alias("season"), F.col("r_name").alias("climate"), "c_acctbal")
