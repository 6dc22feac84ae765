"""Event and cube metadata: lookups, enrichment, configuration labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from petrichor.functions import labels as L
from petrichor.functions.scalar import flag


def first_event(events: DataFrame, *, event_id: str, order: list[str]) -> DataFrame:
    """One row per event id, the first by ``order``."""
    rest = [c for c in events.columns if c != event_id]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return events.groupBy(event_id).agg(first.alias("_e")).select(event_id, "_e.*")


def add_event_metadata(cubes: DataFrame, events: DataFrame, *, cube: str, event_id: str, start: str, end: str, order: list[str]) -> DataFrame:
    """Precipitation window of the event and the drought window 40 to 10 days before its start.

    A cube without an event keeps its row with NULL dates (``has_event`` 0).
    """
    one = first_event(events, event_id=event_id, order=order).select(
        F.col(event_id).alias("_id"), F.to_date(start).alias("precip_start"), F.to_date(end).alias("precip_end")
    )
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    out = cubes.join(one, F.col(cube) == F.col("_id"), "left")
    return out.withColumns(
        {
            "has_event": flag(F.col("_id").isNotNull()),
            "drought_start": iso(F.date_sub("precip_start", 40)),
            "drought_end": iso(F.date_sub("precip_start", 10)),
            "precip_start": iso(F.col("precip_start")),
            "precip_end": iso(F.col("precip_end")),
        }
    ).drop("_id")


def cube_id_from_path(path: Column, pattern: str = L.CUBE_ID_PATTERN) -> Column:
    """Cube id inside a path, NULL when there is none."""
    return F.nullif(F.regexp_extract(path, f"({pattern})", 1), F.lit(""))


def filter_paths(paths: DataFrame, excluded: DataFrame, *, path: str, excluded_id: str, pattern: str = L.CUBE_ID_PATTERN) -> DataFrame:
    """Paths with a recognised id that is not excluded (exact match on the extracted id)."""
    ids = paths.withColumn("cube_id", cube_id_from_path(F.col(path), pattern)).filter(F.col("cube_id").isNotNull())
    return ids.join(excluded.select(F.col(excluded_id).alias("cube_id")).distinct(), "cube_id", "left_anti")


def optical_input_label(variables: Column) -> Column:
    """Any raw band wins, then any index, else custom_<sorted names>."""
    has = lambda names: F.arrays_overlap(variables, F.array(*[F.lit(n) for n in names]))
    custom = F.concat(F.lit("custom_"), F.concat_ws("_", F.array_sort(variables)))
    return F.when(has(L.RAW_OPTICAL_BANDS), "rgb_nir").when(has(L.OPTICAL_INDICES), "indices").otherwise(custom)


def predictor_set(variables: Column) -> Column:
    """All indices win, then all raw bands, else Unknown."""
    covers = lambda names: F.size(F.array_except(F.array(*[F.lit(n) for n in names]), variables)) == 0
    return F.when(covers(L.OPTICAL_INDICES), "Indices").when(covers(L.RAW_OPTICAL_BANDS), "RGBI_kNDVI").otherwise("Unknown")


def merge_metadata(cubes: DataFrame, metadata: DataFrame, *, cube: str, metadata_id: str, strict: bool = True) -> DataFrame:
    """One-to-one join; duplicate or missing metadata ids raise (or are flagged with ``strict=False``)."""
    counts = metadata.groupBy(metadata_id).agg(F.count(F.lit(1)).alias("_dup"))
    rows = metadata.join(counts, metadata_id).withColumnRenamed(metadata_id, "_mid")
    out = cubes.join(rows, F.col(cube) == F.col("_mid"), "left")
    problem = F.when(F.col("_mid").isNull(), "metadata missing").when(F.col("_dup") > 1, "duplicate metadata id")
    if not strict:
        return out.withColumn("problem", problem).drop("_mid", "_dup")
    checked = F.when(problem.isNull(), F.col(cube)).otherwise(F.raise_error(F.concat(problem, F.lit(": "), F.col(cube).cast("string"))))
    return out.withColumn(cube, checked).drop("_mid", "_dup")


def keep_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return df.join(listed.select(key).distinct(), key, "left_semi")


def drop_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return df.join(listed.select(key).distinct(), key, "left_anti")


def nearest_point(queries: DataFrame, points: DataFrame, *, query_id: list[str], x: str, y: str, px: str, py: str, payload: list[str], factor: int = 4) -> DataFrame:
    """Exact nearest grid point per query (ties: smallest payload) without comparing all pairs.

    Points are bucketed at several cell sizes. The finest follows from the points' extent and number, the
    coarsest spans queries and points together, so every query finds an occupied 3 x 3 neighbourhood at some
    size. At the finest such size a point is no farther than the diagonal of that block, and the 7 x 7
    neighbourhood contains the nearest one. A query without coordinates, or without any point, keeps its row
    with NULLs.
    """
    box = lambda df, a, b: df.agg(F.struct(F.min(a).alias("x0"), F.max(a).alias("x1"), F.min(b).alias("y0"), F.max(b).alias("y1"), F.count(a).alias("n")).alias("e")).select("e").scalar()
    p, q = box(points, px, py), box(queries, x, y)
    own = F.greatest(p["x1"] - p["x0"], p["y1"] - p["y0"])
    whole = F.greatest(*[F.greatest(p[f"{c}1"], q[f"{c}1"]) - F.least(p[f"{c}0"], q[f"{c}0"]) for c in "xy"])
    cell = F.when(own > 0, own / F.sqrt(p["n"].cast("double")) / factor).when(whole > 0, whole).otherwise(1.0)
    levels = F.ceil(F.log(F.greatest(whole / cell, F.lit(1.0))) / F.log(F.lit(float(factor)))).cast("int") + 1

    def at(df: DataFrame, cx: str, cy: str) -> DataFrame:
        sized = df.withColumns({"_cell": cell, "_levels": levels}).withColumn("_l", F.explode(F.expr("sequence(0, _levels)")))
        side = F.col("_cell") * F.pow(F.lit(float(factor)), F.col("_l"))
        return sized.withColumns({"_cx": F.floor(F.col(cx) / side), "_cy": F.floor(F.col(cy) / side)}).drop("_cell", "_levels")

    ring = lambda r: F.sequence(F.lit(-r), F.lit(r))
    grid = at(points.select(px, py, *payload).dropna(subset=[px, py]).distinct(), px, py)
    occupied = grid.select("_l", "_cx", "_cy").distinct()
    located = at(queries.select(*query_id, F.col(x).alias("_x"), F.col(y).alias("_y")).dropna(subset=["_x", "_y"]), "_x", "_y")
    # which neighbour cells are occupied, found from the small side: an occupied cell serves its 3 x 3 block
    served = occupied.withColumn("_dx", F.explode(ring(1))).withColumn("_dy", F.explode(ring(1))).select(
        "_l", (F.col("_cx") + F.col("_dx")).alias("_cx"), (F.col("_cy") + F.col("_dy")).alias("_cy")
    ).distinct()
    level = located.join(served, ["_l", "_cx", "_cy"], "left_semi").groupBy(*query_id, "_x", "_y").agg(
        F.min(F.struct("_l", "_cx", "_cy")).alias("_m")
    )
    around = level.select(*query_id, "_x", "_y", "_m.*").withColumn("_dx", F.explode(ring(3))).withColumn("_dy", F.explode(ring(3)))
    around = around.withColumns({"_cx": F.col("_cx") + F.col("_dx"), "_cy": F.col("_cy") + F.col("_dy")}).drop("_dx", "_dy")
    pairs = around.join(grid, ["_l", "_cx", "_cy"])
    d2 = (F.col(px) - F.col("_x")) * (F.col(px) - F.col("_x")) + (F.col(py) - F.col("_y")) * (F.col(py) - F.col("_y"))
    best = pairs.groupBy(*query_id).agg(F.min(F.struct(d2.alias("d2"), *payload)).alias("_b"))
    return queries.select(*query_id).join(best, query_id, "left").select(*query_id, F.sqrt("_b.d2").alias("distance"), *[F.col("_b")[c].alias(c) for c in payload])


def season_of_month(monthly: Column, when: Column) -> Column:
    """Season name from an array of 12 monthly label ids (position = month), NULL for an unknown id."""
    names = F.create_map(*[F.lit(v) for pair in L.SEASON_NAMES.items() for v in pair])
    return F.try_element_at(names, F.element_at(monthly, F.month(when)).cast("int"))


def enrich(cubes: DataFrame, countries: DataFrame, zones: DataFrame, *, iso: str, zone_key: list[str]) -> DataFrame:
    """Country and continent ('Unknown' if absent), climate zone, and its first letter as class.

    ``countries``: iso + country, continent; ``zones``: zone_key + zone. Both are small dimension tables, and
    the engine broadcasts them when their measured size allows it.
    """
    out = cubes.join(countries, iso, "left").join(zones, zone_key, "left")
    return out.withColumns(
        {
            "country": F.coalesce("country", F.lit("Unknown")),
            "continent": F.coalesce("continent", F.lit("Unknown")),
            "climate_class": F.substring("zone", 1, 1),
        }
    )


def join_group_medians(summary: DataFrame, rows: DataFrame, *, group: str, value: str) -> DataFrame:
    """Median of ``value`` per group next to the summary rows."""
    from petrichor.operators.order_stats import group_percentiles

    medians = group_percentiles(rows.filter(F.col(group).isNotNull()), [group], [value], [0.5])
    return summary.join(medians.withColumnRenamed(f"{value}_p0", f"{value}_median"), group, "left")
