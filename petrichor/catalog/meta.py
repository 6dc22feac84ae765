"""Metadata queries: customers with nation and region as cubes, orders as their events, documents and pages as
path-like texts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from petrichor.catalog import query, rnd, rounded
from petrichor.catalog.sql import META, order_hash
from petrichor.operators import climate, folds, meta, quality
from petrichor.plans import views as V
from petrichor.sources import readers


# ---- events of cubes -------------------------------------------------------------------------------
def _events(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("eid"), "o_orderkey", F.col("o_orderdate").alias("start"), F.col("o_orderdate").alias("end"))


_FIRST = "fe AS (SELECT o_custkey AS eid, min(o_orderkey) AS k, arg_min(CAST(o_orderdate AS DATE), o_orderkey) AS d FROM orders GROUP BY 1)"


@query("first_event_per_cube", f"WITH {_FIRST} SELECT eid, k AS o_orderkey, d AS start FROM fe")
def _(spark, sf):
    return meta.first_event(_events(spark, sf), event_id="eid", order=["o_orderkey"]).select("eid", "o_orderkey", F.to_date("start").alias("start"))


@query(
    "event_windows",
    f"WITH {_FIRST} SELECT c_custkey AS cube, CASE WHEN eid IS NOT NULL THEN 1 ELSE 0 END AS has_event, CAST(d AS VARCHAR) AS precip_start, CAST(d AS VARCHAR) AS precip_end, CAST(d - 40 AS VARCHAR) AS drought_start, CAST(d - 10 AS VARCHAR) AS drought_end FROM customer LEFT JOIN fe ON eid = c_custkey",
)
def _(spark, sf):
    cubes = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("cube"))
    return meta.add_event_metadata(cubes, _events(spark, sf), cube="cube", event_id="eid", start="start", end="end", order=["o_orderkey"])


@query(
    "merge_metadata",
    f"WITH {META}, md AS (SELECT s_suppkey AS mid, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_acctbal + 1 FROM supplier WHERE s_acctbal < 0), d AS (SELECT *, count(*) OVER (PARTITION BY mid) AS dup FROM md) SELECT cube, location, season, climate, {rnd('s_acctbal')}, CASE WHEN mid IS NULL THEN 'metadata missing' WHEN dup > 1 THEN 'duplicate metadata id' END AS problem FROM meta LEFT JOIN d ON cube = mid",
)
def _(spark, sf):
    s = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("mid"), "s_acctbal")
    md = s.unionByName(s.filter("s_acctbal < 0").withColumn("s_acctbal", F.col("s_acctbal") + 1))
    return rounded(meta.merge_metadata(V.cube_meta(spark, sf).drop("c_acctbal"), md, cube="cube", metadata_id="mid", strict=False), "s_acctbal")


@query("keep_cubes_with_files", "SELECT c_custkey AS cube FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def _(spark, sf):
    files = V.table(spark, sf, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("cube"))
    return meta.keep_listed(V.table(spark, sf, "customer").select(F.col("c_custkey").alias("cube")), files, "cube")


@query("drop_excluded_cubes", "SELECT c_custkey AS cube FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def _(spark, sf):
    excluded = V.table(spark, sf, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("cube"))
    return meta.drop_listed(V.table(spark, sf, "customer").select(F.col("c_custkey").alias("cube")), excluded, "cube")


@query(
    "enrich_dimensions",
    "SELECT c_custkey AS cube, coalesce(n_name, 'Unknown') AS country, coalesce(r_name, 'Unknown') AS continent, c_mktsegment AS zone, substr(c_mktsegment, 1, 1) AS climate_class FROM customer LEFT JOIN (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 7) ON c_nationkey = n_nationkey",
)
def _(spark, sf):
    """Nation 7 is missing from the country table."""
    n, r = V.table(spark, sf, "nation"), V.table(spark, sf, "region")
    countries = n.filter("n_nationkey <> 7").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("iso"), F.col("n_name").alias("country"), F.col("r_name").alias("continent"))
    c = V.table(spark, sf, "customer")
    zones = c.select(F.col("c_custkey").alias("cube"), F.col("c_mktsegment").alias("zone"))
    cubes = c.select(F.col("c_custkey").alias("cube"), F.col("c_nationkey").alias("iso"))
    return meta.enrich(cubes, countries, zones, iso="iso", zone_key=["cube"]).drop("iso")


# ---- nearest point and boxes -----------------------------------------------------------------------
@query(
    "nearest_grid_point",
    "WITH q AS (SELECT c_custkey AS qid, c_acctbal / 100.0::DOUBLE AS qx, c_nationkey AS qy FROM customer), p AS (SELECT s_suppkey AS pid, s_acctbal / 100.0::DOUBLE AS x, s_nationkey AS y FROM supplier), m AS (SELECT qid, pid, pow(x-qx,2)+pow(y-qy,2) AS d2, row_number() OVER (PARTITION BY qid ORDER BY pow(x-qx,2)+pow(y-qy,2), pid) AS o FROM q, p) "
    f"SELECT qid, pid, {rnd('sqrt(d2)', 'distance', 5)} FROM m WHERE o = 1",
)
def _(spark, sf):
    q = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("qid"), (F.col("c_acctbal") / 100.0).alias("qx"), F.col("c_nationkey").cast("double").alias("qy"))
    p = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pid"), (F.col("s_acctbal") / 100.0).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    out = meta.nearest_point(q, p, query_id=["qid"], x="qx", y="qy", px="x", py="y", payload=["pid"])
    return rounded(out, "distance", digits=5)


_SEASONS = "WHEN 1 THEN 'Winter' WHEN 2 THEN 'Spring' WHEN 3 THEN 'Summer' WHEN 4 THEN 'Autumn' WHEN 5 THEN 'Hotter' WHEN 6 THEN 'Cooler' WHEN 7 THEN 'Dry' WHEN 8 THEN 'Wet'"


@query("season_of_event_month", f"SELECT o_orderkey, CASE (o_custkey + month(o_orderdate)) % 10 {_SEASONS} END AS season FROM orders")
def _(spark, sf):
    """The monthly labels of an order's customer: id + month modulo 10 (0 and 9 have no name)."""
    o = V.table(spark, sf, "orders")
    monthly = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: ((F.col("o_custkey") + m) % 10).cast("int"))
    return o.select("o_orderkey", meta.season_of_month(monthly, F.col("o_orderdate")).alias("season"))


# The projection series as numbers, so that the SQL doesn't rest on the operator's own.
_UTM = {
    "radius": 6367449.145823415,
    "beta": [0.0008377321640600574, 5.905869567933988e-08, 1.6734888803548483e-10, 2.1677377630220365e-13],
    "delta": [0.003356551469125213, 6.5718730839601334e-06, 1.7646564004758498e-08, 5.4004820816935436e-11],
}


def _utm_sql() -> str:
    """The series as text, for points (e, x, y)."""
    s = _UTM
    r = 0.9996 * s["radius"]
    lit = lambda v: f"({v!r})::DOUBLE"
    xi, eta = f"(y / {lit(r)})", f"((x - 500000) / {lit(r)})"
    xi1 = xi + "".join(f" - {lit(b)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(s["beta"], 1))
    eta1 = eta + "".join(f" - {lit(b)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(s["beta"], 1))
    lat = "chi" + "".join(f" + {lit(d)} * sin({2 * j} * chi)" for j, d in enumerate(s["delta"], 1))
    deg = lit(180 / math.pi)
    return f"""u0 AS (SELECT *, {xi} AS xi, {eta} AS eta FROM pts), u1 AS (SELECT *, {xi1} AS xi1, {eta1} AS eta1 FROM u0), u2 AS (SELECT *, asin(sin(xi1)/cosh(eta1)) AS chi FROM u1),
 ll AS (SELECT cube, corner, atan2(sinh(eta1), cos(xi1)) * {deg} + (e % 100) * 6 - 183 AS lon, ({lat}) * {deg} AS lat FROM u2)"""


@query(
    "utm_bounding_boxes",
    f"""WITH src AS (SELECT s_nationkey AS cube, 32601 + s_nationkey AS e, 500000.0::DOUBLE + s_acctbal * 10 AS x, 4000000.0::DOUBLE + s_suppkey * 100 AS y FROM supplier),
 ext AS (SELECT cube, min(e) AS e, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM src GROUP BY 1), pts AS (SELECT cube, 0 AS corner, e, x0 AS x, y0 AS y FROM ext UNION ALL SELECT cube, 1, e, x1, y1 FROM ext), {_utm_sql()}
 SELECT cube, {rnd('min(lon)', 'lon_min')}, {rnd('max(lon)', 'lon_max')}, {rnd('min(lat)', 'lat_min')}, {rnd('max(lat)', 'lat_max')} FROM ll GROUP BY 1""",
)
def _(spark, sf):
    s = V.table(spark, sf, "supplier")
    obs = s.select(F.col("s_nationkey").alias("cube"), (F.col("s_nationkey") + 32601).alias("e"), (500000.0 + F.col("s_acctbal") * 10).alias("x"), (4000000.0 + F.col("s_suppkey") * 100).alias("y"))
    return rounded(climate.bounding_boxes(obs, cube=["cube"], epsg="e", x="x", y="y"), "lon_min", "lon_max", "lat_min", "lat_max")


def _boxes(spark, sf):
    lat, lon = F.col("s_acctbal") / 200.0, F.col("s_nationkey").cast("double")
    s = V.table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("cube"), (lat - 0.3).alias("lat_min"), (lat + 0.3).alias("lat_max"), (lon - 0.5).alias("lon_min"), (lon + 0.5).alias("lon_max"))


def _grid(spark, sf):
    c = V.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("cell"), (F.col("c_acctbal") / 200.0).alias("lat"), F.col("c_nationkey").cast("double").alias("lon"))


_BOX = "m AS (SELECT s_suppkey AS cube, c_custkey AS cell, c_acctbal/200.0::DOUBLE AS lat, c_nationkey AS lon FROM supplier JOIN customer ON c_acctbal/200.0::DOUBLE BETWEEN s_acctbal/200.0::DOUBLE - 0.3::DOUBLE AND s_acctbal/200.0::DOUBLE + 0.3::DOUBLE AND c_nationkey BETWEEN s_nationkey - 0.5 AND s_nationkey + 0.5)"


@query("cells_in_boxes", f"WITH {_BOX} SELECT cube, cell FROM m")
def _(spark, sf):
    return climate.cells_in_boxes(_boxes(spark, sf), _grid(spark, sf)).select("cube", "cell")


@query("single_cell_check", f"WITH {_BOX}, n AS (SELECT cube, count(DISTINCT (lat, lon)) AS n_cells FROM m GROUP BY 1) SELECT s_suppkey AS cube, coalesce(n_cells, 0) AS n_cells, CASE WHEN n_cells = 1 THEN 1 ELSE 0 END AS ok FROM supplier LEFT JOIN n ON cube = s_suppkey")
def _(spark, sf):
    boxes = _boxes(spark, sf)
    points = _grid(spark, sf).select("lat", "lon").distinct()
    return climate.single_cell_check(climate.cells_in_boxes(boxes, points), boxes, cube=["cube"], distinct=True)


# ---- texts as paths and configurations -------------------------------------------------------------
_PATTERN = r"[a-z]{2}/[0-9]+"


@query(
    "filter_cube_paths",
    f"WITH p AS (SELECT page_id, url, nullif(regexp_extract(url, '({_PATTERN})', 1), '') AS cube_id FROM pages), x AS (SELECT DISTINCT cube_id AS c FROM p WHERE url LIKE '%ref=%' AND cube_id IS NOT NULL) SELECT cube_id, page_id, url FROM p WHERE cube_id IS NOT NULL AND cube_id NOT IN (SELECT c FROM x)",
)
def _(spark, sf):
    pages = V.table(spark, sf, "pages", "page_id", "url")
    ids = pages.withColumn("x", meta.cube_id_from_path(F.col("url"), _PATTERN)).filter(F.col("url").contains("ref=") & F.col("x").isNotNull())
    return meta.filter_paths(pages, ids, path="url", excluded_id="x", pattern=_PATTERN)


@query("parse_path_list", "SELECT page_id, 'z/' || trim(url) || '.zarr' AS path FROM pages WHERE trim(url) <> ''")
def _(spark, sf):
    """Page addresses as lines of a path list."""
    pages = V.table(spark, sf, "pages", "page_id", "url").filter(F.trim("url") != "")
    lines = pages.select("page_id", F.concat(F.lit("  z/"), F.trim("url"), F.lit(".zarr ")).alias("value"))
    return readers.parse_path_list(lines).join(lines.select("page_id", F.trim("value").alias("path")), "path").select("page_id", "path").distinct()


_VARS = "vars AS (SELECT doc_id, list_concat(CASE WHEN lang = 'en' THEN ['B02','B03','B04','B8A'] WHEN lang = 'de' THEN ['IRECI','NDMI','NIRv'] WHEN lang = 'fr' THEN ['B02'] ELSE ['zz','aa'] END, ['kNDVI']) AS v, lang FROM documents)"


def _variables(spark, sf):
    d = V.table(spark, sf, "documents", "doc_id", "lang")
    arr = lambda *n: F.array(*[F.lit(x) for x in n])
    base = F.when(F.col("lang") == "en", arr("B02", "B03", "B04", "B8A")).when(F.col("lang") == "de", arr("IRECI", "NDMI", "NIRv")).when(F.col("lang") == "fr", arr("B02")).otherwise(arr("zz", "aa"))
    return d.select("doc_id", F.concat(base, arr("kNDVI")).alias("v"))


@query("optical_input_label", f"WITH {_VARS} SELECT doc_id, CASE WHEN lang IN ('en','fr') THEN 'rgb_nir' WHEN lang = 'de' THEN 'indices' ELSE 'custom_aa_kNDVI_zz' END AS label FROM vars")
def _(spark, sf):
    return _variables(spark, sf).select("doc_id", meta.optical_input_label(F.col("v")).alias("label"))


@query("predictor_set", f"WITH {_VARS} SELECT doc_id, CASE lang WHEN 'de' THEN 'Indices' WHEN 'en' THEN 'RGBI_kNDVI' ELSE 'Unknown' END AS label FROM vars")
def _(spark, sf):
    return _variables(spark, sf).select("doc_id", meta.predictor_set(F.col("v")).alias("label"))


# ---- folds -----------------------------------------------------------------------------------------
@query(
    "train_test_split",
    f"WITH {META}, o AS (SELECT cube, row_number() OVER (ORDER BY {order_hash(42, 'cube')}, cube) - 1 AS p, count(*) OVER () AS n FROM meta) SELECT cube, CASE WHEN p < ceil(n * 0.15) THEN 'test' ELSE 'train' END AS split FROM o",
)
def _(spark, sf):
    return folds.train_test(V.cube_meta(spark, sf), unique="cube").select("cube", "split")


def _unit_sql(unit: str, name: str, k: int) -> str:
    """Shuffled units cut into k blocks."""
    block = f"CASE WHEN p < (n % kk) * (n // kk + 1) THEN p // (n // kk + 1) ELSE n % kk + (p - (n % kk) * (n // kk + 1)) // (n // kk) END"
    return f"""{name}0 AS (SELECT {unit}, row_number() OVER (ORDER BY {order_hash(42, unit)}, {unit}) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT {unit} FROM meta)),
 {name} AS (SELECT {unit}, {block} AS f FROM (SELECT *, (SELECT kk FROM kq) AS kk FROM {name}0))"""


_KQ = "kq AS (SELECT least(4, count(DISTINCT location), count(DISTINCT season)) AS kk FROM meta)"
_ST = f"{META}, {_KQ}, {_unit_sql('location', 'sf', 4)}, {_unit_sql('season', 'tf', 4)}, folds AS (SELECT CAST(unnest(range(4)) AS INTEGER) AS fold)"


@query(
    "space_time_folds",
    f"WITH {_ST} SELECT m.cube, fold, CASE WHEN s.f = fold AND t.f = fold THEN 'val' WHEN s.f <> fold AND t.f <> fold THEN 'train' ELSE 'excluded' END AS subset FROM meta m JOIN sf s USING (location) JOIN tf t USING (season), folds",
)
def _(spark, sf):
    return folds.spacetime_folds(V.cube_meta(spark, sf), space="location", time="season", k=4).select("cube", "fold", "subset")


@query("space_folds", f"WITH {_ST} SELECT m.cube, fold, CASE WHEN s.f = fold THEN 'val' ELSE 'train' END AS subset FROM meta m JOIN sf s USING (location), folds")
def _(spark, sf):
    return folds.spacetime_folds(V.cube_meta(spark, sf), space="location", k=4).select("cube", "fold", "subset")


@query("time_folds", f"WITH {_ST} SELECT m.cube, fold, CASE WHEN t.f = fold THEN 'val' ELSE 'train' END AS subset FROM meta m JOIN tf t USING (season), folds")
def _(spark, sf):
    return folds.spacetime_folds(V.cube_meta(spark, sf), time="season", k=4).select("cube", "fold", "subset")


_STRAT = f"""u AS (SELECT DISTINCT location, climate FROM meta), o AS (SELECT location, climate, row_number() OVER (PARTITION BY climate ORDER BY {order_hash(42, 'location')}, location) - 1 AS p FROM u),
 c AS (SELECT climate, coalesce(sum(count(*)) OVER (ORDER BY climate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM u GROUP BY 1), a AS (SELECT location, climate, CAST((s + p) % 3 AS INTEGER) AS f FROM o JOIN c USING (climate))"""


@query("stratified_space_folds", f"WITH {META}, {_STRAT} SELECT m.cube, fold, CASE WHEN f = fold THEN 'val' ELSE 'train' END AS subset FROM meta m JOIN a USING (location, climate), (SELECT CAST(unnest(range(3)) AS INTEGER) AS fold)")
def _(spark, sf):
    return folds.spacetime_folds(V.cube_meta(spark, sf), space="location", k=3, strata="climate").select("cube", "fold", "subset")


def _membership(spark, sf):
    return folds.spacetime_folds(V.cube_meta(spark, sf), space="location", time="season", k=4)


_MEM = f"{_ST}, mem AS (SELECT m.*, fold, CASE WHEN s.f = fold AND t.f = fold THEN 'val' WHEN s.f <> fold AND t.f <> fold THEN 'train' ELSE 'excluded' END AS subset FROM meta m JOIN sf s USING (location) JOIN tf t USING (season), folds)"


@query("fold_summary", f"WITH {_MEM} SELECT fold, count(*) FILTER (subset = 'train') AS n_train, count(*) FILTER (subset = 'val') AS n_val, count(DISTINCT climate) FILTER (subset = 'train') AS n_train_classes, count(DISTINCT climate) FILTER (subset = 'val') AS n_val_classes, string_agg(DISTINCT climate, ',' ORDER BY climate) FILTER (subset = 'val') AS withheld_classes FROM mem GROUP BY 1")
def _(spark, sf):
    return folds.summarise_folds(_membership(spark, sf), climate="climate")


_SHARES = ", ".join(rnd(f"count(*) FILTER (subset = '{s}') * 100.0 / count(*)", f"pct_{s}") for s in ("train", "val", "excluded"))


@query("fold_shares_per_group", f"WITH {_MEM} SELECT fold, climate, count(*) AS n_total, count(*) FILTER (subset = 'train') AS n_train, count(*) FILTER (subset = 'val') AS n_val, count(*) FILTER (subset = 'excluded') AS n_excluded, {_SHARES} FROM mem GROUP BY 1, 2")
def _(spark, sf):
    return rounded(folds.subset_shares(_membership(spark, sf), group=["climate"]), "pct_train", "pct_val", "pct_excluded")


@query("shared_groups_check", f"WITH {_MEM} SELECT fold, climate, count(DISTINCT subset) AS n_sides FROM mem WHERE subset <> 'excluded' GROUP BY 1, 2 HAVING count(DISTINCT subset) > 1")
def _(spark, sf):
    return folds.shared_groups(_membership(spark, sf), group="climate")


@query("validation_overlap_check", f"WITH {_MEM} SELECT location, count(DISTINCT fold) AS n_folds FROM (SELECT location, fold FROM mem WHERE subset = 'val' UNION ALL SELECT location, (fold + 1) % 4 FROM mem WHERE subset = 'val' AND location LIKE '%I%') GROUP BY 1 HAVING count(DISTINCT fold) > 1")
def _(spark, sf):
    """Locations with an I validate in a second fold."""
    mem = _membership(spark, sf)
    again = mem.filter("subset = 'val' AND location LIKE '%I%'").withColumn("fold", ((F.col("fold") + 1) % 4).cast("int"))
    return folds.validation_overlaps(mem.unionByName(again), cube="location")


@query(
    "split_membership_check",
    f"WITH {_MEM}, d AS (SELECT DISTINCT cube, climate, fold, subset FROM mem WHERE subset <> 'excluded' UNION SELECT cube, climate, fold, 'train' FROM mem WHERE subset = 'val' AND fold = 1 AND cube % 10 = 3), md AS (SELECT cube, climate FROM meta WHERE c_acctbal > -900), j AS (SELECT d.fold, d.subset, d.cube, md.climate, md.cube AS k FROM d LEFT JOIN md USING (cube)), c AS (SELECT fold, count(*) FILTER (missing) AS n_missing, count(*) FILTER (sides > 1) AS n_overlap FROM (SELECT fold, cube, count(DISTINCT subset) AS sides, bool_and(k IS NULL) AS missing FROM j GROUP BY 1, 2) GROUP BY 1), s AS (SELECT fold, count(*) FILTER (n > 1) AS n_shared_classes FROM (SELECT fold, climate, count(DISTINCT subset) AS n FROM j GROUP BY 1, 2) GROUP BY 1) SELECT fold, n_overlap, n_missing, n_shared_classes, concat_ws(';', CASE WHEN n_missing > 0 THEN 'missing_metadata' END, CASE WHEN n_overlap > 0 THEN 'train_val_overlap' END, CASE WHEN n_shared_classes > 0 THEN 'climate_class_on_both_sides' END) AS problem FROM c JOIN s USING (fold)",
)
def _(spark, sf):
    mem = _membership(spark, sf)
    twice = mem.filter("subset = 'val' AND fold = 1 AND cube % 10 = 3").withColumn("subset", F.lit("train"))  # on both sides
    files = mem.filter("subset <> 'excluded'").unionByName(twice).select("fold", "subset", "cube")
    known = V.cube_meta(spark, sf).filter("c_acctbal > -900").select("cube", "climate")
    return folds.split_membership(files, known, cube="cube", climate="climate")[1]


@query(
    "balanced_group_folds",
    f"""WITH RECURSIVE {META}, g AS (SELECT concat_ws('_', location, season) AS grp, count(*) AS n FROM meta GROUP BY 1), o AS (SELECT grp, n, row_number() OVER (ORDER BY n DESC, grp) AS i FROM g),
 r AS (SELECT CAST(0 AS BIGINT) AS i, CAST('' AS VARCHAR) AS grp, CAST(-1 AS INTEGER) AS fold, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c
 UNION ALL SELECT o.i, o.grp, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END, a + CASE WHEN a <= b AND a <= c THEN n ELSE 0 END, b + CASE WHEN NOT (a <= b AND a <= c) AND b <= c THEN n ELSE 0 END, c + CASE WHEN NOT (a <= b AND a <= c) AND NOT b <= c THEN n ELSE 0 END FROM r JOIN o ON o.i = r.i + 1)
 SELECT cube, grp AS cv_group, fold FROM r JOIN meta ON grp = concat_ws('_', location, season) WHERE r.i > 0""",
)
def _(spark, sf):
    return folds.balanced_group_folds(V.cube_meta(spark, sf), group=["location", "season"], k=3).select("cube", "cv_group", "fold")


def _drawn_sql(unit: str, name: str, divisor: int, k: int, tries: int, seed: int) -> str:
    return f"""{name} AS (SELECT fold, draw, {unit} FROM (SELECT u.{unit}, fold, draw, row_number() OVER (PARTITION BY fold, draw ORDER BY {order_hash(seed, "concat_ws('|', fold, draw, u." + unit + ")")}, concat_ws('|', fold, draw, u.{unit})) AS o,
 greatest(1, (SELECT count(DISTINCT {unit}) FROM meta) // {divisor}) AS take FROM (SELECT DISTINCT {unit} FROM meta) u, (SELECT CAST(unnest(range({k})) AS INTEGER) AS fold), (SELECT CAST(unnest(range({tries})) AS INTEGER) AS draw)) WHERE o <= take)"""


@query(
    "random_strict_folds",
    f"""WITH {META}, {_drawn_sql('location', 'dl', 4, 3, 60, 0)}, {_drawn_sql('season', 'ds', 3, 3, 60, 0)}, fd AS (SELECT DISTINCT fold, draw FROM dl),
 z AS (SELECT fd.fold, fd.draw, count(*) FILTER (dl.location IS NOT NULL AND ds.season IS NOT NULL) AS nv, count(*) FILTER (dl.location IS NULL AND ds.season IS NULL) AS nt, count(*) AS n FROM fd CROSS JOIN meta m LEFT JOIN dl ON dl.fold = fd.fold AND dl.draw = fd.draw AND dl.location = m.location LEFT JOIN ds ON ds.fold = fd.fold AND ds.draw = fd.draw AND ds.season = m.season GROUP BY 1, 2),
 f AS (SELECT fold, min(draw) AS draw FROM z WHERE nv >= floor(n * 0.05) AND nt > n * 0.1 GROUP BY 1)
 SELECT m.cube, f.fold, CASE WHEN dl.location IS NOT NULL AND ds.season IS NOT NULL THEN 'val' WHEN dl.location IS NULL AND ds.season IS NULL THEN 'train' ELSE 'excluded' END AS subset FROM f CROSS JOIN meta m LEFT JOIN dl ON dl.fold = f.fold AND dl.draw = f.draw AND dl.location = m.location LEFT JOIN ds ON ds.fold = f.fold AND ds.draw = f.draw AND ds.season = m.season""",
)
def _(spark, sf):
    """As in the SQL, a fold without a draw that is large enough has no rows."""
    out = folds.random_strict_folds(V.cube_meta(spark, sf), space="location", time="season", k=3, min_val_share=0.05, tries=60, all_folds=False)
    return out.select("cube", "fold", "subset")


_CHUNK = f"""{META}, lc AS (SELECT location, CAST(least(p // greatest(1, n // 3), 2) AS INTEGER) AS fold FROM (SELECT location, row_number() OVER (ORDER BY {order_hash(42, 'location')}, location) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT location FROM meta))), {_drawn_sql('season', 'ds', 3, 3, 1, 42)},
 mem AS (SELECT m.*, f.fold, CASE WHEN lc.location IS NOT NULL AND ds.season IS NOT NULL THEN 'val' WHEN lc.location IS NULL AND ds.season IS NULL THEN 'train' ELSE 'excluded' END AS subset FROM meta m CROSS JOIN (SELECT CAST(unnest(range(3)) AS INTEGER) AS fold) f LEFT JOIN lc ON lc.fold = f.fold AND lc.location = m.location LEFT JOIN ds ON ds.fold = f.fold AND ds.season = m.season)"""


def _chunked(spark, sf):
    return folds.chunked_strict_folds(V.cube_meta(spark, sf), space="location", time="season", k=3)


@query("chunked_strict_folds", f"WITH {_CHUNK} SELECT cube, fold, subset FROM mem")
def _(spark, sf):
    return _chunked(spark, sf).select("cube", "fold", "subset")


@query("strict_fold_check", f"WITH {_CHUNK}, w AS (SELECT * REPLACE (CASE WHEN fold = 1 AND subset = 'excluded' AND cube % 7 = 0 THEN 'train' ELSE subset END AS subset) FROM mem), sl AS (SELECT fold, count(*) AS n FROM (SELECT fold, location FROM w WHERE subset <> 'excluded' GROUP BY 1, 2 HAVING count(DISTINCT subset) > 1) GROUP BY 1), ss AS (SELECT fold, count(*) AS n FROM (SELECT fold, season FROM w WHERE subset <> 'excluded' GROUP BY 1, 2 HAVING count(DISTINCT subset) > 1) GROUP BY 1) SELECT fold, count(*) FILTER (subset = 'train') AS n_train, count(*) FILTER (subset = 'val') AS n_val, count(*) FILTER (subset = 'excluded') AS n_excluded, coalesce((SELECT n FROM sl WHERE sl.fold = w.fold), 0) AS shared_location, coalesce((SELECT n FROM ss WHERE ss.fold = w.fold), 0) AS shared_season, CASE WHEN count(*) FILTER (subset = 'val') > 0 THEN 1 ELSE 0 END AS found FROM w GROUP BY 1")
def _(spark, sf):
    """In fold 1 some excluded cubes train all the same."""
    leak = (F.col("fold") == 1) & (F.col("subset") == "excluded") & (F.col("cube") % 7 == 0)
    return folds.strict_fold_check(_chunked(spark, sf).withColumn("subset", F.when(leak, "train").otherwise(F.col("subset"))), k=3, space="location", time="season")


@query(
    "cube_set_difference",
    "WITH a AS (SELECT DISTINCT o_custkey AS cube FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS cube FROM orders WHERE o_orderpriority = '5-LOW') SELECT cube, 'left' AS only_in FROM a WHERE cube NOT IN (SELECT cube FROM b) UNION ALL SELECT cube, 'right' FROM b WHERE cube NOT IN (SELECT cube FROM a)",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("cube"), "o_orderpriority")
    return folds.set_difference(o.filter("o_orderpriority = '1-URGENT'"), o.filter("o_orderpriority = '5-LOW'"), "cube")


@query("dataset_counts", "SELECT count(*) AS n_total, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)) AS n_excluded, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)) AS n_used FROM customer")
def _(spark, sf):
    cubes = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("cube"))
    excluded = V.table(spark, sf, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("cube"))
    return quality.dataset_counts(cubes, excluded, cube=["cube"])


@query("category_distribution", f"WITH {META} SELECT season, climate, count(*) AS n, {rnd('count(*) / sum(count(*)) OVER (PARTITION BY season)', 'share')} FROM meta GROUP BY 1, 2")
def _(spark, sf):
    return rounded(quality.category_distribution(V.cube_meta(spark, sf), split="season", category="climate"), "share")
