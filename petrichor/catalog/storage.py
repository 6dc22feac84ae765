"""Sinks and sources: a given table is written, read back and compared with the table itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from petrichor import schema as S
from petrichor.catalog import query, rnd, rounded
from petrichor.catalog.sql import IMG, PRED
from petrichor.operators import climate
from petrichor.plans import views as V
from petrichor.session import shared_folder
from petrichor.sources import readers, statistics, writers


@query("cube_round_trip", f"WITH {IMG} SELECT CASE WHEN cube % 2 = 0 THEN 'train' ELSE 'val' END AS split, CAST(cube AS VARCHAR) AS cube_id, t, y, x, {rnd('v')} FROM img")
def _(spark, sf):
    px = V.image_pixels(spark, sf).withColumn("split", F.when(F.col("cube") % 2 == 0, "train").otherwise("val")).withColumn("cube_id", F.col("cube").cast("string")).drop("cube")
    root = shared_folder(spark, "cubes")
    writers.write_cubes(px, root, chunk=4)
    return rounded(readers.read_table(spark, root, "t bigint, y int, x int, v double, split string, cube_id string"), "v").select("split", "cube_id", "t", "y", "x", "v")


@query("some_cubes_round_trip", f"WITH {IMG} SELECT CAST(cube AS VARCHAR) AS cube_id, count(*) AS n, {rnd('sum(v)', 'total', 3)} FROM img WHERE cube % 2 = 0 GROUP BY 1 UNION ALL SELECT 'none', 0, NULL")
def _(spark, sf):
    """Every second cube by its id, and one cube that isn't there."""
    px = V.image_pixels(spark, sf).withColumns({"split": F.lit("train"), "cube_id": F.col("cube").cast("string")})
    root = shared_folder(spark, "cubes")
    writers.write_cubes(px.drop("cube"), root)
    ids = px.select("cube_id", "cube").distinct().filter("cube % 2 = 0").select("cube_id").unionByName(spark.range(1).select(F.lit("none").alias("cube_id")))
    df, gone = readers.read_listed_cubes(spark, root, "t bigint, y int, x int, v double, split string, cube_id string", ids)
    found = df.groupBy("cube_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    return rounded(found.unionByName(gone.select("cube_id", F.lit(0).alias("n"), F.lit(None).cast("double").alias("total"))), "total", digits=3)


@query(
    "climate_round_trip",
    f"SELECT CAST(l_partkey % 90 AS DOUBLE) AS lat, CAST(l_suppkey % 180 AS DOUBLE) AS lon, CAST(l_shipdate AS DATE) AS day, 'v' || l_linenumber AS var, {rnd('l_extendedprice', 'value')} FROM lineitem",
)
def _(spark, sf):
    li = V.table(spark, sf, "lineitem")
    grid = li.select((F.col("l_partkey") % 90).cast("double").alias("lat"), (F.col("l_suppkey") % 180).cast("double").alias("lon"), F.to_date("l_shipdate").alias("day"), F.concat(F.lit("v"), "l_linenumber").alias("var"), F.col("l_extendedprice").cast("double").alias("value"))
    parts = {"odd": grid.filter("var in ('v1', 'v3', 'v5', 'v7')"), "even": grid.filter("var not in ('v1', 'v3', 'v5', 'v7')")}
    root = shared_folder(spark, "climate")
    for name, df in parts.items():
        df.write.parquet(f"{root}/{name}")
    return rounded(readers.read_climate(spark, [f"{root}/{n}" for n in parts]), "value")


@query("csv_round_trip", f"SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(NULL AS DOUBLE) AS c_name, c_mktsegment, {rnd('c_acctbal')} FROM customer")
def _(spark, sf):
    """A name is no number: it becomes NULL."""
    path = shared_folder(spark, "csv")
    writers.write_result(V.table(spark, sf, "customer", "c_custkey", "c_name", "c_mktsegment", "c_acctbal"), path)
    return rounded(readers.read_csv(spark, path, numeric=["c_acctbal", "c_name"]), "c_acctbal")


@query("splits_round_trip", "SELECT CAST(c_nationkey % 3 AS INTEGER) AS fold, CASE WHEN c_custkey % 4 = 0 THEN 'val' ELSE 'train' END AS subset, CAST(c_custkey AS VARCHAR) AS file FROM customer")
def _(spark, sf):
    """Stored as JSON lines of blocks of files."""
    side = F.when(F.col("c_custkey") % 4 == 0, "val").otherwise("train")
    c = V.table(spark, sf, "customer").select((F.col("c_nationkey") % 3).cast("int").alias("fold"), side.alias("subset"), F.col("c_custkey").cast("string").alias("file"))
    path = shared_folder(spark, "splits")
    writers.write_splits(c, path, block=100)
    return readers.read_split_lines(spark, path)


@query("prediction_round_trip", f"WITH {PRED} SELECT 'k' AS configuration, 'oof' AS stage, cube_id, CAST(0 AS INTEGER) AS fold, step, y, x, {rnd('pred')}, {rnd('tru', 'true')}, {rnd('base')} FROM px")
def _(spark, sf):
    px = V.prediction_pixels(spark, sf).select("cube_id", "step", "y", "x", "pred", "true", "base").withColumns({"configuration": F.lit("k"), "stage": F.lit("oof"), "fold": F.lit(0)})
    root = shared_folder(spark, "predictions")
    writers.write_predictions(px, root)
    ddl = "step int, y int, x int, pred double, true double, base double, configuration string, stage string, fold int, cube_id string"
    return rounded(readers.read_table(spark, root, ddl), "pred", "true", "base")


@query("stored_limits", f"SELECT 'v' || l_linenumber AS var, {rnd('quantile_cont(l_extendedprice, 0.0001)', 'p_low')}, {rnd('quantile_cont(l_extendedprice, 0.9999)', 'p_high')} FROM lineitem GROUP BY 1")
def _(spark, sf):
    """Computed once, stored, and read from the store the second time."""
    li = V.table(spark, sf, "lineitem").select(F.concat(F.lit("v"), "l_linenumber").alias("var"), F.col("l_extendedprice").cast("double").alias("value"))
    path = shared_folder(spark, "limits")
    for _ in range(2):
        limits = writers.cached_stats(spark, path, lambda: climate.global_percentiles(li))
    return rounded(limits, "p_low", "p_high")


BINNED = "(floor(CAST(l_extendedprice AS DOUBLE) / 25) + 0.5) * 25"


@query(
    "refreshed_limits",
    f"SELECT 'v' || l_linenumber AS var, count(*) AS n, {rnd(f'quantile_cont({BINNED}, 0.0001)', 'p_low')}, {rnd(f'quantile_cont({BINNED}, 0.9999)', 'p_high')}, "
    f"abs(quantile_cont({BINNED}, 0.0001) - quantile_cont(l_extendedprice, 0.0001)) <= 12.5 AND abs(quantile_cont({BINNED}, 0.9999) - quantile_cont(l_extendedprice, 0.9999)) <= 12.5 AS within_bound FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    """Stored counts of every second cube, refreshed by the others; the limits against the exact ones."""
    li = V.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cube_id"), F.concat(F.lit("v"), "l_linenumber").alias("var"), F.col("l_extendedprice").cast("double").alias("value"))
    path = shared_folder(spark, "bins")
    for part in (li.filter("cube_id % 2 = 0"), li):
        statistics.refresh(part, path, cube="cube_id", keys=["var"], value="value", width=25)
    limits = statistics.percentiles(statistics.stored_counts(spark, path, width=25), keys=["var"], width=25, probs=[0.0001, 0.9999])
    exact = climate.global_percentiles(li).withColumnsRenamed({"p_low": "low", "p_high": "high"})
    near = (F.abs(F.col("p0") - F.col("low")) <= 12.5) & (F.abs(F.col("p1") - F.col("high")) <= 12.5)
    return rounded(limits.join(exact, "var").select("var", "n", F.col("p0").alias("p_low"), F.col("p1").alias("p_high"), near.alias("within_bound")), "p_low", "p_high")


@query("limits_document", f"SELECT 'v' || l_linenumber AS var, {rnd('min(l_extendedprice)', 'p_low')}, {rnd('max(l_extendedprice)', 'p_high')} FROM lineitem GROUP BY 1")
def _(spark, sf):
    """Limits as a stored JSON document."""
    li = V.table(spark, sf, "lineitem").select(F.concat(F.lit("v"), "l_linenumber").alias("var"), F.col("l_extendedprice").cast("double").alias("v"))
    limits = li.groupBy("var").agg(F.struct(F.min("v").alias("p0_01"), F.max("v").alias("p99_99")).alias("doc"))
    path = shared_folder(spark, "document")
    limits.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("var", "doc")))).alias("value")).write.text(path)
    return rounded(readers.read_global_stats(spark, path), "p_low", "p_high")


@query("export_document", "SELECT count(*) AS n_expected, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS n_existing, CASE WHEN n_existing = 0 THEN 'empty' WHEN n_existing = n_expected THEN 'complete' ELSE 'partial' END AS state, 'oof' AS stage FROM customer")
def _(spark, sf):
    work = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("cube_id"))
    path = shared_folder(spark, "export")
    writers.write_export_document(work, V.table(spark, sf, "orders").select(F.col("o_custkey").alias("cube_id")), path, stage="oof")
    return spark.read.schema("n_expected bigint, n_existing bigint, state string, stage string").json(path)


@query(
    "export_commits",
    f"WITH {PRED}, e AS (SELECT cube_id, count(*) AS n_rows, count(*) FILTER (cube_id NOT LIKE '7-%' OR step <= 3) AS n FROM px GROUP BY 1) SELECT cube_id, CASE WHEN cube_id LIKE '5-%' THEN NULL ELSE n_rows END AS n_rows, CASE WHEN cube_id LIKE '3-%' THEN NULL ELSE n END AS n_stored, CASE WHEN cube_id LIKE '5-%' THEN 'uncommitted' WHEN cube_id LIKE '3-%' THEN 'missing' WHEN n_rows = n THEN 'complete' ELSE 'truncated' END AS state FROM e",
)
def _(spark, sf):
    """Cubes of label 3 are vouched for but never arrive, those of 5 have no marker, and a later job dies while it
    replaces those of 7."""
    px = V.prediction_pixels(spark, sf).select("cube_id", "step", "y", "x", "pred", "true", "base").withColumns({"configuration": F.lit("k"), "stage": F.lit("oof")})
    root = shared_folder(spark, "predictions")
    writers.write_predictions(px.filter("cube_id NOT LIKE '3-%'"), root)
    writers.commit(px.filter("cube_id NOT LIKE '5-%'"), root)
    writers.write_predictions(px.filter("cube_id LIKE '7-%' AND step <= 3"), root)
    return writers.commit_state(spark, root).select("cube_id", "n_rows", "n_stored", "state")


@query(
    "resumed_export",
    f"WITH {PRED}, e AS (SELECT cube_id, cube_id NOT LIKE '7-%' AND cube_id NOT LIKE '3-%' AS ok FROM px GROUP BY 1), s AS (SELECT count(*) AS n_expected, count(*) FILTER (ok) AS n_existing FROM e) SELECT cube_id, n_expected, n_existing, CASE WHEN n_existing = 0 THEN 'empty' WHEN n_existing = n_expected THEN 'complete' ELSE 'partial' END AS state FROM e, s WHERE NOT ok",
)
def _(spark, sf):
    """What a resumed export still has to write: truncated and missing cubes, though the former have rows."""
    px = V.prediction_pixels(spark, sf).select("cube_id", "step", "y", "x", "pred", "true", "base").withColumns({"configuration": F.lit("k"), "stage": F.lit("oof")})
    root = shared_folder(spark, "predictions")
    writers.write_predictions(px.filter("cube_id NOT LIKE '3-%' AND (cube_id NOT LIKE '7-%' OR step <= 3)"), root)
    writers.commit(px, root)
    work, done = px.select("cube_id").distinct(), writers.complete_cubes(spark, root)
    state = writers.export_state(work, done)
    return writers.remaining(work, done).select("cube_id", *[state.select(c).scalar().alias(c) for c in ("n_expected", "n_existing", "state")])
