"""Queries on ``embeddings`` as 8 x 8 images: cube = label, time = vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from petrichor.catalog import query, rnd, rounded
from petrichor.catalog.sql import BANDS, CLEAN, IMG, INDEX, hash32, order_hash
from petrichor.functions import indices
from petrichor.operators import masks, metrics, quality, radar, scoring, tiles
from petrichor.plans import views as V

PIX = ["cube", "y", "x"]
KEY = "cube, t, y, x"
NAMES = list(V.BAND_SHIFT)


def _clean(spark, sf):
    return masks.clean_bands(V.image_bands(spark, sf), NAMES, cast="double")


@query("clean_bands", f"WITH {CLEAN} SELECT {KEY}, {', '.join(rnd(b) for b in NAMES)} FROM clean")
def _(spark, sf):
    return rounded(_clean(spark, sf), *NAMES)


@query(
    "band_clip_report",
    f"WITH {BANDS} " + " UNION ALL ".join(f"SELECT cube, '{b}' AS band, count(*) FILTER ({b} < 0) AS clipped_low, count(*) FILTER ({b} > 10000) AS clipped_high FROM bands GROUP BY 1" for b in NAMES),
)
def _(spark, sf):
    return masks.band_clip_report(V.image_bands(spark, sf), NAMES, ["cube"])


@query("spectral_indices", f"WITH {CLEAN} SELECT {KEY}, {', '.join(rnd(e, n, 5) for n, e in INDEX.items())} FROM clean")
def _(spark, sf):
    return rounded(indices.add_indices(_clean(spark, sf)).select("cube", "t", "y", "x", *indices.INDEX_NAMES), *indices.INDEX_NAMES, digits=5)


#: Written out again, so that a changed constant of the library fails the comparison.
_RANGES = {"NDVI": (-1.0, 1.0), "kNDVI": (0.0, 1.0), "NDMI": (-1.0, 1.0), "NDWI": (-1.0, 1.0), "NIRv": (-1.0, 1.0), "IRECI": (-1.0, 2.0), "CIRE": (-1.0, 25.0)}


def _range_sql(name: str) -> str:
    lo, hi = _RANGES[name]
    out = f"max(i) > {hi} OR min(i) < {lo}"
    crit = f"WHEN ({out}) AND (max(i) > 1 OR min(i) < -1) THEN 'critical'" if name in ("NDVI", "kNDVI", "NDWI", "NDMI") else ""
    return f"SELECT cube, '{name}' AS index_name, {rnd('min(i)', 'v_min', 5)}, {rnd('max(i)', 'v_max', 5)}, CASE WHEN max(i) IS NULL THEN 'empty' {crit} WHEN {out} THEN 'report' ELSE 'ok' END AS status FROM (SELECT cube, {INDEX[name]} AS i FROM clean) GROUP BY 1"


@query("index_range_check", f"WITH {CLEAN} " + " UNION ALL ".join(_range_sql(n) for n in indices.INDEX_NAMES))
def _(spark, sf):
    return rounded(masks.index_range_check(indices.add_indices(_clean(spark, sf)), indices.INDEX_NAMES, ["cube"]), "v_min", "v_max", digits=5)


@query(
    "band_summary",
    f"WITH {CLEAN} " + " UNION ALL ".join(f"SELECT '{b}' AS variable, {rnd(f'min({b})', 'v_min')}, {rnd(f'max({b})', 'v_max')}, {rnd(f'avg({b})', 'v_mean')} FROM clean" for b in NAMES),
)
def _(spark, sf):
    return rounded(masks.value_summary(_clean(spark, sf), NAMES), "v_min", "v_max", "v_mean")


@query("safety_clip", f"WITH {IMG} SELECT {KEY}, {rnd('CASE WHEN v IS NOT NULL THEN greatest(-5, least(5, v * 30)) END', 'v', 5)} FROM img")
def _(spark, sf):
    df = V.image_pixels(spark, sf).withColumn("v", F.col("v") * 30)
    return rounded(masks.safety_clip(df, keep=["cube", "t", "y", "x"]), "v", digits=5)


# ---- vegetation ------------------------------------------------------------------------------------
_LC = "lc AS (SELECT cube, t, y, x, [10,20,30,40,50,60,70,80,90,95,100,0][CAST(floor(B12*11.99::DOUBLE) AS INTEGER) + 1] AS esa_lc, B12 AS q, B08, B04, B03 FROM clean)"
_VEG = "10, 20, 30, 40, 60, 90, 95, 100"
_ST0 = f"""{CLEAN}, {_LC}, l0 AS (SELECT cube, y, x, arg_min(esa_lc, t) AS esa_lc FROM lc GROUP BY 1, 2, 3),
 v0 AS (SELECT cube, t, l.y, l.x, CASE WHEN l0.esa_lc IN ({_VEG}) THEN 1 ELSE 0 END AS is_veg, l0.esa_lc, CASE WHEN q > 0.15 THEN 1 ELSE 0 END AS strict,
 {INDEX['NDVI']} AS ndvi, {INDEX['NDWI']} AS ndwi FROM lc l JOIN l0 USING (cube, y, x)),
 so AS (SELECT cube, y, x, max(esa_lc) AS esa_lc, max(is_veg) AS is_veg, count(*) FILTER (strict = 1) AS n_clear, count(*) FILTER (strict = 1 AND is_veg = 1 AND (coalesce(ndvi < 0.05, false) OR coalesce(ndwi > 0.3, false))) AS n_error FROM v0 GROUP BY 1, 2, 3),
 so2 AS (SELECT *, CASE WHEN n_clear > 5 THEN n_error / n_clear::DOUBLE ELSE 0 END AS error_freq, CASE WHEN error_freq <= 0.5 THEN 1 ELSE 0 END AS static_valid FROM so)"""


def _landcover(spark, sf):
    """Land-cover code per pixel and time from one band; the first time is the layer."""
    code = F.element_at(F.array(*[F.lit(c) for c in V.LANDCOVER]), (F.floor(F.col("B12") * 11.99) + 1).cast("int"))
    return _clean(spark, sf).withColumn("esa_lc", code)


def _first_layer(spark, sf):
    return _landcover(spark, sf).groupBy(*PIX).agg(F.min_by("esa_lc", "t").alias("esa_lc"))


def _outliers(spark, sf):
    df = indices.add_indices(_clean(spark, sf), ["NDVI", "NDWI"]).withColumn("mask_strict", (F.col("B12") > 0.15).cast("int"))
    df = df.join(masks.vegetation_mask(_first_layer(spark, sf)).drop("esa_lc"), PIX)
    return quality.static_outliers(df, pixel=PIX, threshold=0.5)


@query("vegetation_mask", f"WITH {CLEAN}, {_LC} SELECT cube, t, y, x, CASE WHEN esa_lc IN ({_VEG}) THEN 1 ELSE 0 END AS is_veg FROM lc")
def _(spark, sf):
    return masks.vegetation_mask(_landcover(spark, sf)).select("cube", "t", "y", "x", "is_veg")


@query("static_vegetation_outliers", f"WITH {_ST0} SELECT cube, y, x, is_veg, n_clear, n_error, {rnd('error_freq')}, static_valid FROM so2")
def _(spark, sf):
    return rounded(_outliers(spark, sf), "error_freq")


@query(
    "outlier_removal_check",
    f"WITH {_ST0}, w AS (SELECT cube, is_veg, CASE WHEN cube % 2 = 1 OR y > 0 THEN static_valid END AS ok FROM so2), c AS (SELECT cube, count(*) FILTER (is_veg = 1) AS n_before, count(*) FILTER (is_veg = 1 AND ok = 1) AS n_after, count(*) FILTER (is_veg = 1 AND ok = 0) AS n_removed FROM w GROUP BY 1) SELECT *, CASE WHEN n_before - n_after <> n_removed THEN 0 ELSE 1 END AS ok FROM c",
)
def _(spark, sf):
    """Every second cube has pixels without a decision in its first row."""
    out = _outliers(spark, sf).withColumn("static_valid", F.when((F.col("cube") % 2 == 1) | (F.col("y") > 0), F.col("static_valid")))
    return quality.removal_check(out, cube=["cube"])


@query("refine_vegetation", f"WITH {_ST0} SELECT cube, y, x, CAST(CASE WHEN is_veg = 1 AND static_valid = 0 THEN 0 ELSE esa_lc END AS INTEGER) AS esa_lc, CASE WHEN is_veg = 1 AND static_valid = 1 THEN 1 ELSE 0 END AS is_veg FROM so2")
def _(spark, sf):
    df = _outliers(spark, sf).select(*PIX, "is_veg", "static_valid").join(_first_layer(spark, sf), PIX)
    return masks.refine_vegetation(df)


_NAMES = (
    "WHEN 10 THEN 'LC_Tree' WHEN 20 THEN 'LC_Shrub' WHEN 30 THEN 'LC_Grass' WHEN 40 THEN 'LC_Crop' WHEN 50 THEN 'LC_Settlement' "
    "WHEN 60 THEN 'LC_Sparse_Veg' WHEN 70 THEN 'LC_Snow' WHEN 80 THEN 'LC_Water' WHEN 90 THEN 'LC_Wetland' WHEN 100 THEN 'LC_Moss_Lichen'"
)


@query(
    "landcover_distribution",
    f"WITH {CLEAN}, {_LC}, c AS (SELECT cube, esa_lc, count(*) AS n FROM lc GROUP BY 1, 2) SELECT cube, esa_lc, CASE esa_lc {_NAMES} ELSE 'Unmapped Code (' || esa_lc || ')' END AS class_name, {rnd('n * 100.0 / sum(n) OVER (PARTITION BY cube)', 'pct', 2)} FROM c",
)
def _(spark, sf):
    return rounded(quality.landcover_distribution(_landcover(spark, sf), cube=["cube"], code="esa_lc"), "pct", digits=2)


@query("normalise_elevation", f"WITH {IMG} SELECT cube, y, x, {rnd('avg((v + 0.1) * 20000.0) / 8849.0', 'dem_scaled')}, CASE WHEN avg((v + 0.1) * 20000.0) / 8849.0 BETWEEN -0.05 AND 1 THEN 1 ELSE 0 END AS in_range FROM img GROUP BY 1, 2, 3")
def _(spark, sf):
    df = V.image_pixels(spark, sf).withColumn("dem", (F.col("v") + 0.1) * 20000.0)
    return rounded(masks.normalise_elevation(df, PIX), "dem_scaled")


# ---- radar filter ----------------------------------------------------------------------------------
_LEE = f"""b AS (SELECT a.cube, a.t, a.y, a.x, a.v, sum(n.v) / count(n.v) AS m, greatest(0, sum(n.v*n.v) / count(n.v) - pow(sum(n.v) / count(n.v), 2)) AS var
 FROM img a JOIN img n ON a.cube = n.cube AND a.t = n.t AND abs(a.y - n.y) <= 3 AND abs(a.x - n.x) <= 3 GROUP BY ALL),
 w AS (SELECT *, CASE WHEN var < pow(0.25*m, 2) THEN 0 ELSE greatest(0, least(1, var / (var + pow(0.25*m, 2) + 1e-9))) END AS wt FROM b)"""


@query("lee_speckle_filter", f"WITH {IMG}, {_LEE} SELECT {KEY}, {rnd('CASE WHEN v IS NOT NULL THEN m + wt*(v-m) END', 'v_lee', 5)} FROM w")
def _(spark, sf):
    out = radar.lee_filter(V.image_pixels(spark, sf), image=["cube", "t"], y="y", x="x", value="v")
    return rounded(out.drop("v"), "v_lee", digits=5)


@query("dense_grid_check", f"WITH {IMG} SELECT cube, t, count(*) AS n_rows, CAST((max(y)-min(y)+1)*(max(x)-min(x)+1) AS BIGINT) AS n_cells, CASE WHEN count(*) = (max(y)-min(y)+1)*(max(x)-min(x)+1) THEN 1 ELSE 0 END AS dense FROM img GROUP BY 1, 2")
def _(spark, sf):
    return radar.grid_check(V.image_pixels(spark, sf), image=["cube", "t"], y="y", x="x")


# ---- maps ------------------------------------------------------------------------------------------
@query("temporal_mean_map", f"WITH {IMG} SELECT cube, y, x, {rnd('avg(v)', 'v_mean')} FROM img GROUP BY 1, 2, 3")
def _(spark, sf):
    return rounded(quality.mean_map(V.image_pixels(spark, sf), pixel=PIX, value="v"), "v_mean")


@query(
    "robust_map_limits",
    f"WITH {IMG}, m AS (SELECT cube, avg(v) AS v FROM img GROUP BY cube, y, x) SELECT cube, {rnd('CASE WHEN min(v) >= 0 AND max(v) <= 1 THEN 0 ELSE quantile_cont(v, 0.05) END', 'v_low')}, {rnd('CASE WHEN min(v) >= 0 AND max(v) <= 1 THEN 1 ELSE quantile_cont(v, 0.95) END', 'v_high')} FROM m GROUP BY 1",
)
def _(spark, sf):
    maps = quality.mean_map(V.image_pixels(spark, sf), pixel=PIX, value="v")
    return rounded(quality.robust_limits(maps, cube=["cube"], value="v_mean"), "v_low", "v_high")


_RGB = ["B04", "B03", "B08"]


@query(
    "rgb_percentile_stretch",
    f"WITH {CLEAN}, q AS (SELECT cube, " + ", ".join(f"quantile_cont({b}, 0.02) AS l_{b}, quantile_cont({b}, 0.98) AS h_{b}" for b in _RGB) + f" FROM clean GROUP BY 1) SELECT cube, t, y, x, " + ", ".join(rnd(f"greatest(0, least(1, ({b} - l_{b}) / nullif(h_{b} - l_{b}, 0)))", b) for b in _RGB) + " FROM clean JOIN q USING (cube)",
)
def _(spark, sf):
    df = _clean(spark, sf).select("cube", "t", "y", "x", *_RGB)
    return rounded(quality.percentile_stretch(df, cube=["cube"], bands=_RGB), *_RGB)


# ---- tiles -----------------------------------------------------------------------------------------
# 8 px images, 3 px tiles: offsets 0, 2, 5 (the last one is forced to the border)
_TILES = "ofs AS (SELECT i, o FROM (VALUES (0, 0), (1, 2), (2, 5)) v(i, o))"
_CUT = f"""{_TILES}, cut AS (SELECT g.*, a.i*3 + b.i AS tile_seq, a.o AS top, b.o AS lft, g.y - a.o AS r, g.x - b.o AS c FROM img g
 JOIN ofs a ON g.y >= a.o AND g.y < a.o + 3 JOIN ofs b ON g.x >= b.o AND g.x < b.o + 3)"""


def _cut(df):
    return tiles.cut_tiles(df, dim=8, patch=3)


@query("tile_grid", f'WITH {IMG}, {_TILES} SELECT t.cube, a.i*3 + b.i AS tile_seq, a.o AS top, b.o AS "left" FROM (SELECT DISTINCT cube FROM img) t, ofs a, ofs b')
def _(spark, sf):
    cubes = V.image_pixels(spark, sf).select("cube").distinct()
    return tiles.tile_grid(cubes, dim=8, patch=3).select("cube", "tile_seq", "top", "left")


@query("tile_sample_count", "SELECT count(*) * 9 AS n_samples FROM embeddings")
def _(spark, sf):
    return tiles.sample_count(V.table(spark, sf, "embeddings", "vec_id"), dim=8, patch=3)


@query("cut_tiles", f'WITH {IMG}, {_CUT} SELECT cube, t, tile_seq, top, lft AS "left", r AS "row", c AS col, {rnd("v")} FROM cut')
def _(spark, sf):
    return rounded(_cut(V.image_pixels(spark, sf)).drop("y", "x"), "v")


@query("rotate_tiles", f'WITH {IMG}, {_CUT} SELECT cube, t, tile_seq, CASE t % 4 WHEN 1 THEN 2 - c WHEN 2 THEN 2 - r WHEN 3 THEN c ELSE r END AS "row", CASE t % 4 WHEN 1 THEN r WHEN 2 THEN 2 - c WHEN 3 THEN 2 - r ELSE c END AS col, {rnd("v")} FROM cut')
def _(spark, sf):
    out = tiles.rotate(_cut(V.image_pixels(spark, sf)), patch=3, turns=F.col("t"))
    return rounded(out.select("cube", "t", "tile_seq", "row", "col", "v"), "v")


def _box_mean(tile):
    """Mean of the known values in the 3 x 3 box around every pixel of the tile's first channel."""
    import numpy as np

    padded = np.pad(tile[:, :, 0], 1, constant_values=np.nan)
    stack = np.stack([padded[i : i + tile.shape[0], j : j + tile.shape[1]] for i in range(3) for j in range(3)])
    known = (~np.isnan(stack)).sum(axis=0)
    return np.where(known > 0, np.nansum(stack, axis=0) / np.maximum(known, 1), np.nan)


@query(
    "score_whole_tiles",
    f'WITH {IMG}, {_CUT}, s AS (SELECT a.cube, a.t, a.tile_seq, a.y, a.x, avg(b.v) AS p FROM cut a JOIN cut b ON a.cube = b.cube AND a.t = b.t AND a.tile_seq = b.tile_seq AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL) SELECT cube, t, y, x, {rnd("avg(p)", "pred")}, count(*) AS coverage FROM s GROUP BY ALL',
)
def _(spark, sf):
    """A 3 x 3 mean as the model of a tile; overlapping tiles are averaged."""
    cut = _cut(V.image_pixels(spark, sf)).drop("y", "x")
    scored = scoring.score_whole_tiles(cut, _box_mean, tile=["cube", "t", "tile_seq", "top", "left"], channels=["v"], patch=3)
    placed = scored.withColumns({"y": (F.col("top") + F.col("row")).cast("int"), "x": (F.col("left") + F.col("col")).cast("int")})
    return rounded(placed.groupBy("cube", "t", "y", "x").agg(F.avg("pred").alias("pred"), F.count(F.lit(1)).alias("coverage")), "pred")


_TP = """tp AS (SELECT cube, t, y, x, tile_seq, coalesce(v, 0) + tile_seq * 0.01::DOUBLE AS pred, coalesce(v, 0) AS tru, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS mask, coalesce(v, 0) / 2 AS base FROM cut)"""


def _tile_predictions(spark, sf):
    v = F.coalesce("v", F.lit(0.0))
    return _cut(V.image_pixels(spark, sf)).select(
        "cube", "t", "y", "x", "tile_seq", (v + F.col("tile_seq") * 0.01).alias("pred"), v.alias("true"), F.col("v").isNotNull().cast("int").alias("mask"), (v / 2).alias("base")
    )


@query("stitch_tiles", f"WITH {IMG}, {_CUT}, {_TP} SELECT cube, t, y, x, {rnd('avg(pred)', 'pred')}, {rnd('arg_max(tru, tile_seq)', 'true')}, arg_max(mask, tile_seq) AS mask, {rnd('arg_max(base, tile_seq)', 'base')}, count(*) AS coverage FROM tp GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    return rounded(tiles.stitch(_tile_predictions(spark, sf), cube=["cube"], step="t"), "pred", "true", "base")


@query("stitch_tile_means", f"WITH {IMG}, {_CUT}, {_TP} SELECT cube, t, y, x, {rnd('avg(pred)', 'pred')}, {rnd('avg(tru)', 'true')}, CASE WHEN max(mask) > 0 THEN 1 ELSE 0 END AS mask, {rnd('avg(base)', 'base')} FROM tp GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    return rounded(tiles.stitch_means(_tile_predictions(spark, sf), cube=["cube"], step="t"), "pred", "true", "base")


@query(
    "stitch_completeness",
    f"WITH {IMG}, {_CUT}, p AS (SELECT DISTINCT cube, t, y, x FROM cut), a AS (SELECT cube, count(*) AS cov FROM p GROUP BY 1), b AS (SELECT cube, count(DISTINCT tile_seq) AS n_tiles, count(DISTINCT t) AS n_steps FROM cut GROUP BY 1) SELECT cube, n_tiles, n_steps, n_steps*64 - cov AS uncovered, CASE WHEN n_tiles = 9 AND n_steps*64 = cov THEN 1 ELSE 0 END AS complete FROM a JOIN b USING (cube)",
)
def _(spark, sf):
    return tiles.completeness(_tile_predictions(spark, sf), cube=["cube"], step="t", expected_tiles=9, height=8, width=8)


# ---- patches ---------------------------------------------------------------------------------------
_CAND = f"""cand AS (SELECT cube, k AS attempt, CAST({hash32("'5'", "'top'", 'cube', 'k')} % 5 AS INTEGER) AS top, CAST({hash32("'5'", "'left'", 'cube', 'k')} % 5 AS INTEGER) AS lft
 FROM (SELECT DISTINCT cube FROM img), (SELECT unnest(range(6))::INTEGER AS k))"""
_SCORE = f"""{_CAND}, hit AS (SELECT c.cube, attempt, top, lft, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS m, t % 5 = 0 AS tgt, t FROM cand c JOIN img i ON c.cube = i.cube AND y >= top AND y < top + 4 AND x >= lft AND x < lft + 4),
 st AS (SELECT cube, attempt, top, lft, tgt, t, avg(m) AS s, sum(m) AS n FROM hit GROUP BY ALL),
 sc AS (SELECT cube, attempt, top, lft, count(*) FILTER (NOT tgt AND s >= 0.95) AS n_good_context, count(*) FILTER (tgt AND s >= 0.95) AS n_good_target, CAST(coalesce(sum(n) FILTER (tgt), 0) AS BIGINT) AS target_valid FROM st GROUP BY ALL),
 scored AS (SELECT *, n_good_context + 5.0::DOUBLE*n_good_target AS score, CASE WHEN target_valid > 0 AND n_good_context >= 22 AND n_good_target >= 6 THEN 1 ELSE 0 END AS accepted FROM sc)"""


def _candidates(spark, sf):
    return tiles.patch_candidates(V.image_pixels(spark, sf), cube=["cube"], height=8, width=8, patch=4, tries=6, seed=5)


def _scored(spark, sf):
    px = V.image_pixels(spark, sf).select(
        "cube", "y", "x", F.col("t").alias("step"), F.when(F.col("t") % 5 == 0, "target").otherwise("context").alias("part"), F.col("v").isNotNull().cast("int").alias("mask")
    )
    return tiles.score_patches(px, _candidates(spark, sf), cube=["cube"], patch=4, context_ratio=0.95, target_ratio=0.95, min_context=22, min_target=6)


@query("patch_candidates", f'WITH {IMG}, {_CAND} SELECT cube, attempt, top, lft AS "left" FROM cand')
def _(spark, sf):
    return _candidates(spark, sf)


@query("score_patches", f'WITH {IMG}, {_SCORE} SELECT cube, attempt, top, lft AS "left", n_good_context, n_good_target, target_valid, score, accepted FROM scored')
def _(spark, sf):
    return _scored(spark, sf)


@query(
    "choose_patch",
    f"""WITH {IMG}, {_SCORE}, r AS (SELECT *, row_number() OVER (PARTITION BY cube ORDER BY accepted DESC, CASE WHEN accepted = 1 THEN attempt END, score DESC, target_valid DESC, attempt) AS o FROM scored WHERE target_valid > 0)
 SELECT cube, attempt, top, lft AS "left", CASE WHEN accepted = 1 THEN 'accepted' ELSE 'fallback' END AS how FROM r WHERE o = 1""",
)
def _(spark, sf):
    return tiles.choose_patch(_scored(spark, sf), cube=["cube"])


_CHOSEN = """r AS (SELECT *, row_number() OVER (PARTITION BY cube ORDER BY accepted DESC, CASE WHEN accepted = 1 THEN attempt END, score DESC, target_valid DESC, attempt) AS o FROM scored WHERE target_valid > 0 AND cube % 3 <> 1),
 ch AS (SELECT c.cube, attempt, top, lft, CASE WHEN r.cube IS NULL THEN 'resample' WHEN accepted = 1 THEN 'accepted' ELSE 'fallback' END AS how FROM (SELECT DISTINCT cube FROM scored) c LEFT JOIN (SELECT * FROM r WHERE o = 1) r USING (cube))"""


@query(
    "patch_retry",
    f"""WITH {IMG}, {_SCORE}, {_CHOSEN}, ring AS (SELECT *, row_number() OVER (ORDER BY {order_hash(5, 'cube')}, cube) - 1 AS i, count(*) OVER () AS n FROM ch),
 good AS (SELECT *, row_number() OVER (ORDER BY {order_hash(5, 'cube')}, cube) - 1 AS i, count(*) OVER () AS n FROM ch WHERE how <> 'resample'),
 dr AS (SELECT cube, k, {hash32("'5'", "'cube'", 'cube', 'k')} % n AS i FROM ring, (SELECT unnest(range(1, 3)) AS k) WHERE how = 'resample'),
 srv AS (SELECT d.cube, k, r.cube AS src, r.attempt, r.top, r.lft, r.how FROM dr d JOIN ring r ON r.i = d.i AND r.how <> 'resample'
  UNION ALL SELECT q.cube, 3, g.cube, g.attempt, g.top, g.lft, g.how FROM ring q JOIN good g ON q.how = 'resample' AND g.i = {hash32("'5'", "'cube'", 'q.cube', "3")} % g.n),
 ft AS (SELECT * FROM srv QUALIFY row_number() OVER (PARTITION BY cube ORDER BY k) = 1)
 SELECT cube, cube AS from_cube, attempt, top, lft AS "left", how, 0 AS cube_attempt FROM good UNION ALL
 SELECT q.cube, src, ft.attempt, ft.top, ft.lft, coalesce(ft.how, 'resample'), CAST(k AS INTEGER) FROM ring q LEFT JOIN ft USING (cube) WHERE q.how = 'resample'""",
)
def _(spark, sf):
    """A third of the cubes has no valid target at all."""
    scored = _scored(spark, sf)
    empty = F.col("cube") % 3 == 1
    scored = scored.withColumns({"target_valid": F.when(empty, 0).otherwise(F.col("target_valid")), "accepted": F.when(empty, 0).otherwise(F.col("accepted"))})
    return tiles.retry_on_other_cubes(tiles.choose_patch(scored, cube=["cube"]), cube=["cube"], attempts=3, seed=5)


@query(
    "random_vegetation_patches",
    f"""WITH {IMG}, {_CAND}, m AS (SELECT cube, y, x, CASE WHEN avg(v) > 0.005 THEN 1 ELSE 0 END AS is_veg FROM img GROUP BY 1, 2, 3), s AS (SELECT c.cube, attempt, top, lft, avg(is_veg) AS veg_share FROM cand c JOIN m ON c.cube = m.cube AND y >= top AND y < top + 4 AND x >= lft AND x < lft + 4 GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY cube ORDER BY attempt) AS o FROM s WHERE veg_share >= 0.5) SELECT cube, attempt, top, lft AS "left", {rnd('veg_share')} FROM r WHERE o <= 2""",
)
def _(spark, sf):
    veg = quality.mean_map(V.image_pixels(spark, sf), pixel=PIX, value="v").withColumn("is_veg", (F.col("v_mean") > 0.005).cast("int"))
    return rounded(tiles.random_vegetation_patches(_candidates(spark, sf), veg, cube=["cube"], patch=4, min_share=0.5, n=2), "veg_share")


@query(
    "patch_allocation",
    f"WITH {CLEAN}, {_LC}, l0 AS (SELECT cube, y, x, arg_min(esa_lc, t) AS esa_lc FROM lc GROUP BY 1, 2, 3), c AS (SELECT cube, esa_lc, count(*) AS n_pixels, count(*) OVER (PARTITION BY cube) AS k, sum(count(*)) OVER (PARTITION BY cube) AS tot FROM l0 WHERE esa_lc IN ({_VEG}) GROUP BY 1, 2) SELECT cube, esa_lc, n_pixels, CAST(1 + CASE WHEN 20 - k > 0 THEN round_even(n_pixels / tot::DOUBLE * (20 - k), 0) ELSE 0 END AS BIGINT) AS n_patches FROM c",
)
def _(spark, sf):
    return tiles.patch_allocation(_first_layer(spark, sf), cube=["cube"], code="esa_lc", n_patches=20)


@query(
    "stratified_patches",
    f"""WITH RECURSIVE {CLEAN}, {_LC}, l0 AS (SELECT cube, y, x, arg_min(esa_lc, t) AS esa_lc FROM lc GROUP BY 1, 2, 3),
 c AS (SELECT cube, esa_lc, count(*) AS n_pixels, count(*) OVER (PARTITION BY cube) AS k, sum(count(*)) OVER (PARTITION BY cube) AS tot FROM l0 WHERE esa_lc IN ({_VEG}) GROUP BY 1, 2),
 qu AS (SELECT cube, esa_lc, CAST(1 + CASE WHEN 20 - k > 0 THEN round_even(n_pixels / tot::DOUBLE * (20 - k), 0) ELSE 0 END AS BIGINT) AS quota FROM c),
 co AS (SELECT cube, esa_lc, greatest(0, least(6, y - 1)) AS top, greatest(0, least(6, x - 1)) AS lft, min(md5(concat_ws('|', '0', y, x))) AS h FROM l0 WHERE esa_lc IN ({_VEG}) GROUP BY ALL),
 od AS (SELECT co.*, quota, row_number() OVER (PARTITION BY cube ORDER BY esa_lc, h) AS i FROM co JOIN qu USING (cube, esa_lc)),
 walk AS (SELECT cube, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(code INTEGER, top INTEGER, lft INTEGER)[]) AS got FROM (SELECT DISTINCT cube FROM od)
 UNION ALL SELECT w.cube, od.i, CASE WHEN len(got) < 20 AND len(list_filter(got, lambda g: g.code = od.esa_lc)) < quota
 AND len(list_filter(got, lambda g: greatest(0, 2 - abs(g.top - od.top)) * greatest(0, 2 - abs(g.lft - od.lft)) > 1)) = 0
 THEN list_append(got, {{'code': CAST(od.esa_lc AS INTEGER), 'top': CAST(od.top AS INTEGER), 'lft': CAST(od.lft AS INTEGER)}}) ELSE got END FROM walk w JOIN od ON od.cube = w.cube AND od.i = w.i + 1),
 fin AS (SELECT cube, arg_max(got, i) AS got FROM walk GROUP BY 1)
 SELECT cube, got[n].code AS code, got[n].top AS top, got[n].lft AS "left", CAST(n AS INTEGER) AS patch_no FROM (SELECT cube, got, unnest(range(1, len(got) + 1)) AS n FROM fin)""",
)
def _(spark, sf):
    return tiles.stratified_patches(_first_layer(spark, sf), cube=["cube"], y="y", x="x", code="esa_lc", n_patches=20, patch=2, height=8, width=8, max_overlap=0.25)


# ---- channels --------------------------------------------------------------------------------------
_CODES = [0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100]
_HOT = ", ".join(f"CASE WHEN esa_lc = {v} THEN 1 ELSE 0 END AS lc_{v}" for v in _CODES)


@query("one_hot_landcover", f"WITH {CLEAN}, {_LC} SELECT cube, t, y, x, {_HOT} FROM lc")
def _(spark, sf):
    df = _landcover(spark, sf)
    return df.select("cube", "t", "y", "x", *tiles.one_hot_landcover(F.col("esa_lc")))


_OPT, _RAD, _CLI, _STA = ["kNDVI", "B04", "B08"], ["B11"], ["B05", "B06"], ["B07"]


@query(
    "sensor_masks_and_fill",
    f"WITH {IMG} SELECT cube, t, y, x, CASE WHEN v > 0 THEN 1 ELSE 0 END AS m_s2, CASE WHEN v IS NOT NULL AND v > 0 THEN 1 ELSE 0 END AS m_target, CASE WHEN v IS NOT NULL AND v > 0 THEN 1 ELSE 0 END AS m_s1, {rnd('coalesce(v, 0)', 'v')}, {rnd('coalesce(v * 2, 0)', 'b')}, {rnd('coalesce(v * 3, 0)', 'r')} FROM img",
)
def _(spark, sf):
    ok = F.col("v").isNotNull().cast("int")
    df = V.image_pixels(spark, sf).withColumns({"b": F.col("v") * 2, "r": F.col("v") * 3, "target_mask": ok, "mask_s1": ok, "is_veg": F.coalesce(F.col("v") > 0, F.lit(False)).cast("int")})
    out = masks.sensor_masks_and_fill(df, ["v", "b"], ["r"], target="v")
    return rounded(out.drop("target_mask", "mask_s1", "is_veg"), "v", "b", "r")


def _float_sum(*cols: str) -> str:
    return " + ".join(f"coalesce(CAST(CAST({c} AS FLOAT) AS DOUBLE), 0)" for c in cols)


_KNOWN = f"CASE WHEN esa_lc IN ({', '.join(map(str, _CODES))}) THEN 1 ELSE 0 END"


def _vectors(spark, sf, part):
    df = indices.add_indices(_landcover(spark, sf), ["kNDVI"]).withColumns({m: F.lit(1) for m in ("mask_target", "mask_s2", "mask_s1")})
    df = df.select("*", *tiles.one_hot_landcover(F.col("esa_lc")))
    layout = tiles.channel_layout(_OPT, _RAD, _CLI, _STA)
    out = tiles.channel_vectors(df, layout, part=part, expected=len(layout[part]))
    total = F.aggregate(F.transform("channels", lambda c: F.coalesce(c.cast("double"), F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    return rounded(out.select("cube", "t", "y", "x", F.size("channels").alias("n_channels"), F.col("channels")[0].alias("first_channel"), total.alias("channel_sum")), "first_channel", "channel_sum", digits=4)


@query(
    "channel_vectors",
    f"WITH {CLEAN}, {_LC}, l AS (SELECT cube AS c, t AS tt, y AS yy, x AS xx, {_KNOWN} AS hot FROM lc), k AS (SELECT *, {INDEX['kNDVI']} AS kndvi FROM clean) SELECT cube, t, y, x, CAST(22 AS INTEGER) AS n_channels, {rnd('CAST(kndvi AS FLOAT)', 'first_channel', 4)}, {rnd(_float_sum('kndvi', 'B05', 'B06', 'hot', 'B07', 'B04', 'B08', 'B11') + ' + 3', 'channel_sum', 4)} FROM k JOIN l ON c = cube AND tt = t AND yy = y AND xx = x",
)
def _(spark, sf):
    """Context vectors summarised to their length, first channel and sum."""
    return _vectors(spark, sf, "context")


@query(
    "future_channel_vectors",
    f"WITH {CLEAN}, {_LC}, l AS (SELECT cube AS c, t AS tt, y AS yy, x AS xx, {_KNOWN} AS hot FROM lc) SELECT cube, t, y, x, CAST(16 AS INTEGER) AS n_channels, 0.0::DOUBLE AS first_channel, {rnd(_float_sum('B05', 'B06', 'hot', 'B07'), 'channel_sum', 4)} FROM clean JOIN l ON c = cube AND tt = t AND yy = y AND xx = x",
)
def _(spark, sf):
    """Future vectors: a placeholder for the target, then the channels that are known ahead."""
    return _vectors(spark, sf, "future")


_SIGNED = "md5(concat_ws('|', t, y, x, coalesce(CAST(CAST(round(v * 1000000) AS BIGINT) AS VARCHAR), '<null>'), CASE WHEN v IS NULL THEN 0 ELSE 1 END, 0))"


@query(
    "data_signature",
    f"WITH {IMG}, h AS (SELECT cube, {_SIGNED} AS h FROM img) SELECT cube, sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) || ':' || sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) || ':' || count(*) AS signature, count(*) AS n_rows FROM h GROUP BY 1",
)
def _(spark, sf):
    """Values as whole millionths: both engines write integers alike."""
    df = V.image_pixels(spark, sf).withColumnsRenamed({"v": "true"}).withColumns({"mask": F.col("true").isNotNull().cast("int"), "base": F.lit(0)})
    return metrics.data_signature(df.withColumn("true", F.round(F.col("true") * 1_000_000).cast("bigint")), cube=["cube"], keys=["t", "y", "x"])
