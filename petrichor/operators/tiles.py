"""Tiles: grid, cutting, stitching, rotation, patch draws and scoring, channel vectors."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from petrichor.functions import labels as L
from petrichor.functions.scalar import draw, flag, fold_all, hash_text
from petrichor.operators.order_stats import numbered
from petrichor.session import stored


# ---- grid ------------------------------------------------------------------------------------------
def axis_offsets(dim: int, patch: int) -> list[int]:
    """Offsets of the overlapping tiles along one axis; the last one is forced to the border."""
    n = math.ceil(dim / patch)
    if n == 1:
        return [0]
    stride = (dim - patch) // (n - 1)
    return [i * stride for i in range(n - 1)] + [dim - patch]


def tile_grid(cubes: DataFrame, *, dim: int, patch: int) -> DataFrame:
    """cube x (tile_seq, top, left)."""
    offsets = F.array(*[F.lit(o) for o in axis_offsets(dim, patch)])
    n = len(axis_offsets(dim, patch))
    out = cubes.select("*", F.posexplode(offsets).alias("_i", "top"))
    out = out.select("*", F.posexplode(offsets).alias("_j", "left"))
    return out.withColumn("tile_seq", F.col("_i") * n + F.col("_j")).drop("_i", "_j")


def sample_count(cubes: DataFrame, *, dim: int, patch: int) -> DataFrame:
    """Nominal number of samples: cubes x tiles per cube."""
    n = len(axis_offsets(dim, patch)) ** 2
    return cubes.agg((F.count(F.lit(1)) * n).alias("n_samples"))


def cut_tiles(df: DataFrame, *, y: str = "y", x: str = "x", dim: int, patch: int) -> DataFrame:
    """Copy every pixel to the tiles that contain it (at most two per axis): no join is needed.

    Adds tile_seq, top, left and the position inside the tile (row, col).
    """
    offsets = axis_offsets(dim, patch)
    lit = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(o).alias("o")) for i, o in enumerate(offsets)])
    holding = lambda c: F.explode(F.filter(lit, lambda s: (s["o"] <= F.col(c)) & (F.col(c) < s["o"] + patch)))
    out = df.withColumn("_t", holding(y)).withColumn("_l", holding(x))
    out = out.withColumns({"tile_seq": F.col("_t.i") * len(offsets) + F.col("_l.i"), "top": F.col("_t.o"), "left": F.col("_l.o")})
    return out.withColumns({"row": F.col(y) - F.col("top"), "col": F.col(x) - F.col("left")}).drop("_t", "_l")


def rotate(df: DataFrame, *, patch: int, turns: int | Column, row: str = "row", col: str = "col") -> DataFrame:
    """``turns`` x 90 degrees; one turn maps (r, c) to (P-1-c, r)."""
    k = (turns if isinstance(turns, Column) else F.lit(turns)) % 4
    r, c, m = F.col(row), F.col(col), patch - 1
    new_row = F.when(k == 1, m - c).when(k == 2, m - r).when(k == 3, c).otherwise(r)
    new_col = F.when(k == 1, r).when(k == 2, m - c).when(k == 3, m - r).otherwise(c)
    return df.withColumns({row: new_row, col: new_col})


def with_halo(df: DataFrame, *, y: str, x: str, block: int, before: int, after: int) -> DataFrame:
    """Pixels laid out by blocks of ``block`` x ``block``: one row per block that needs the pixel, its own (``_own``) and
    those it lies up to ``before`` pixels in front of or ``after`` pixels behind. Adds _by, _bx, _own."""
    needed = lambda c: F.explode(F.sequence(F.floor((F.col(c) - after) / F.lit(block)), F.floor((F.col(c) + before) / F.lit(block))))
    out = df.withColumn("_by", needed(y)).withColumn("_bx", needed(x))
    return out.withColumn("_own", (F.col("_by") == F.floor(F.col(y) / F.lit(block))) & (F.col("_bx") == F.floor(F.col(x) / F.lit(block))))


# ---- stitching -------------------------------------------------------------------------------------
def stitch(tiles: DataFrame, *, cube: list[str], step: str = "step", y: str = "y", x: str = "x", extra: list[str] = ()) -> DataFrame:
    """Mean of overlapping predictions; the last tile wins for everything else. ``coverage`` counts tiles."""
    last = lambda c: F.max_by(F.struct(F.col(c).alias("v")), F.col("tile_seq"))["v"].alias(c)
    return tiles.groupBy(*cube, step, y, x).agg(
        F.avg(F.col("pred").cast("double")).alias("pred"), *[last(c) for c in ("true", "mask", "base", *extra)], F.count(F.lit(1)).alias("coverage")
    )


def stitch_means(tiles: DataFrame, *, cube: list[str], step: str = "step", y: str = "y", x: str = "x") -> DataFrame:
    """Evaluator variant: mean of prediction, truth and base, mask = any."""
    mean = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return tiles.groupBy(*cube, step, y, x).agg(
        mean("pred"), mean("true"), flag(F.max("mask") > 0).alias("mask"), mean("base")
    )


def completeness(tiles: DataFrame, *, cube: list[str], expected_tiles: int, step: str = "step", y: str = "y", x: str = "x", height: int, width: int) -> DataFrame:
    """complete = all tiles arrived and no pixel of any step is uncovered."""
    pixel = tiles.groupBy(*cube, step, y, x).agg(F.bit_or(F.lit(1)).alias("_one"))
    covered = pixel.groupBy(*cube).agg(F.count(F.lit(1)).alias("_covered"))
    steps = tiles.groupBy(*cube).agg(F.count_distinct("tile_seq").alias("n_tiles"), F.count_distinct(step).alias("n_steps"))
    out = steps.join(covered, cube).withColumn("uncovered", F.col("n_steps") * height * width - F.col("_covered"))
    return out.withColumn("complete", flag((F.col("n_tiles") == expected_tiles) & (F.col("uncovered") == 0))).drop("_covered")


# ---- patch draws -----------------------------------------------------------------------------------
def patch_candidates(cubes: DataFrame, *, cube: list[str], height: int, width: int, patch: int, tries: int, seed: int = 0) -> DataFrame:
    """``tries`` hash-derived corners per cube, numbered by attempt."""
    if patch > min(height, width):
        raise ValueError(f"patch {patch} exceeds the cube ({height}x{width})")
    ids = [F.col(c) for c in cube]
    out = cubes.select(*cube).distinct().withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    return out.withColumns(
        {
            "top": draw(F.lit(height - patch + 1), seed, "top", *ids, F.col("attempt")).cast("int"),
            "left": draw(F.lit(width - patch + 1), seed, "left", *ids, F.col("attempt")).cast("int"),
        }
    )


def _inside_candidates(pixels: DataFrame, candidates: DataFrame, *, cube: list[str], patch: int, y: str, x: str) -> DataFrame:
    """Pixels with attempt, top, left of every candidate patch they lie in.

    The candidates of a cube travel as one array, which is filtered before it is unfolded: a pixel outside all
    patches makes no row, and a large cube is split like any skewed side of a join.
    """
    arrays = candidates.groupBy(*cube).agg(F.collect_list(F.struct("attempt", "top", "left")).alias("_c"))
    covers = lambda c: (F.col(y) >= c["top"]) & (F.col(y) < c["top"] + patch) & (F.col(x) >= c["left"]) & (F.col(x) < c["left"] + patch)
    return pixels.join(arrays, cube).select(*[c for c in pixels.columns if c not in ("attempt", "top", "left")], F.inline(F.filter("_c", covers)))


def score_patches(
    pixels: DataFrame, candidates: DataFrame, *, cube: list[str], patch: int, context_ratio: float, target_ratio: float,
    min_context: int, min_target: int, y: str = "y", x: str = "x",
) -> DataFrame:
    """Score every candidate. ``pixels``: part ('context'/'target'), step, mask (sensor mask x vegetation).

    Counts are combined before the shuffle; a candidate without pixels has zero counts.
    """
    key = [*cube, "attempt", "top", "left"]
    hits = _inside_candidates(pixels, candidates, cube=cube, patch=patch, y=y, x=x)
    steps = hits.groupBy(*key, "part", "step").agg(F.avg("mask").alias("_share"), F.sum("mask").alias("_valid"))
    ctx, tgt = F.col("part") == "context", F.col("part") == "target"
    per = steps.groupBy(*key).agg(
        F.count_if(ctx & (F.col("_share") >= context_ratio)).alias("n_good_context"),
        F.count_if(tgt & (F.col("_share") >= target_ratio)).alias("n_good_target"),
        F.coalesce(F.sum(F.when(tgt, F.col("_valid"))), F.lit(0)).cast("bigint").alias("target_valid"),
    )
    counts = ["n_good_context", "n_good_target", "target_valid"]
    per = candidates.select(*key).distinct().join(per, key, "left").fillna(0, counts)
    return per.withColumns(
        {
            "score": F.col("n_good_context") * 1.0 + F.col("n_good_target") * 5.0,
            "accepted": flag((F.col("target_valid") > 0) & (F.col("n_good_context") >= min_context) & (F.col("n_good_target") >= min_target)),
        }
    )


def choose_patch(scored: DataFrame, *, cube: list[str]) -> DataFrame:
    """First accepted attempt, else the best (score, target_valid), earliest on a tie; 'resample' if none
    has a valid target."""
    accepted, usable = F.col("accepted") == 1, F.col("target_valid") > 0
    corner = F.struct("attempt", "top", "left")
    out = scored.groupBy(*cube).agg(
        F.min_by(corner, F.when(accepted, F.col("attempt"))).alias("_a"),
        F.max_by(corner, F.when(usable, F.struct("score", "target_valid", -F.col("attempt")))).alias("_b"),
    )
    pick = F.coalesce(F.col("_a"), F.col("_b"))
    how = F.when(F.col("_a").isNotNull(), "accepted").when(F.col("_b").isNotNull(), "fallback").otherwise("resample")
    return out.select(*cube, pick["attempt"].alias("attempt"), pick["top"].alias("top"), pick["left"].alias("left"), how.alias("how"))


def retry_on_other_cubes(chosen: DataFrame, *, cube: list[str], attempts: int = 8, seed: int = 0) -> DataFrame:
    """``choose_patch`` with the 'resample' cubes served from other cubes: adds from_<cube> and ``cube_attempt``, 0 for a
    patch of the cube itself.

    Such a cube draws ``attempts`` - 1 cubes by hash, itself possibly among them, and takes the patch of the first one
    that has any. If none of them has one, a last draw goes to the cubes that do, so 'resample' is left only
    where no cube at all has a usable patch. Everything is one plan: the draws are numbers of cubes in hash order,
    and they are spread evenly over the cubes.
    """
    ring = numbered(chosen, [], cube, seed, out="_i", size="_n")
    patch = F.struct(*[F.col(c).alias(f"from_{c}") for c in cube], "attempt", "top", "left", "how").alias("_p")
    usable = ring.filter(F.col("how") != "resample")
    ids = [F.col(c) for c in cube]
    wanting = ring.filter(F.col("how") == "resample").select(*cube, "_n")
    draws = wanting.withColumn("cube_attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts - 1)))) if attempts > 1 else wanting.withColumn("cube_attempt", F.lit(1)).limit(0)
    draws = draws.withColumn("_i", draw(F.col("_n"), seed, "cube", *ids, F.col("cube_attempt")))
    last = numbered(usable.drop("_i", "_n"), [], cube, seed, out="_i", size="_n")
    count = last.agg(F.max("_n").alias("n")).select("n").scalar()
    final = wanting.select(*cube, F.lit(attempts).alias("cube_attempt"), draw(count, seed, "cube", *ids, F.lit(attempts)).alias("_i"))
    named = lambda df: df.select("_i", patch)
    served = draws.drop("_n").join(named(usable), "_i").unionByName(final.join(named(last), "_i"))
    first = served.groupBy(*cube).agg(F.min_by(F.struct("_p", "cube_attempt"), "cube_attempt").alias("_s"))
    own = usable.select(*cube, patch, F.lit(0).alias("cube_attempt"))
    other = wanting.select(*cube).join(first, cube, "left").select(*cube, F.col("_s._p").alias("_p"), F.col("_s.cube_attempt").alias("cube_attempt"))
    out = own.unionByName(other).select(*cube, "_p.*", "cube_attempt")
    return out.withColumn("how", F.coalesce("how", F.lit("resample")))


def random_vegetation_patches(candidates: DataFrame, veg_pixels: DataFrame, *, cube: list[str], patch: int, min_share: float = 0.7, n: int = 20, y: str = "y", x: str = "x", veg: str = "is_veg") -> DataFrame:
    """First ``n`` attempts per cube whose vegetation share reaches ``min_share``."""
    hits = _inside_candidates(veg_pixels, candidates, cube=cube, patch=patch, y=y, x=x)
    share = hits.groupBy(*cube, "attempt", "top", "left").agg(F.avg(veg).alias("veg_share"))
    order = F.row_number().over(Window.partitionBy(*cube).orderBy("attempt"))
    return share.filter(F.col("veg_share") >= min_share).withColumn("_o", order).filter(F.col("_o") <= n).drop("_o")


def patch_allocation(df: DataFrame, *, cube: list[str], code: str, n_patches: int) -> DataFrame:
    """One patch per vegetation class present plus a rounded (half to even) share of the remaining slots."""
    counts = df.filter(F.col(code).isin(L.VEGETATION_CODES)).groupBy(*cube, code).agg(F.count(F.lit(1)).alias("n_pixels"))
    w = Window.partitionBy(*cube)
    left = n_patches - F.count(F.lit(1)).over(w)
    extra = F.when(left > 0, F.bround(F.col("n_pixels") / F.sum("n_pixels").over(w) * left, 0)).otherwise(0.0)
    return counts.withColumn("n_patches", (1 + extra).cast("bigint"))


def _shared_area(patch: int, a: str, b: str) -> Column:
    side = lambda c: F.greatest(F.lit(0), patch - F.abs(F.col(f"{a}_{c}") - F.col(f"{b}_{c}")))
    return side("top") * side("left")


def _around(df: DataFrame, size: int) -> DataFrame:
    """A row per neighbouring bucket, its own included."""
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    out = df.withColumn("_by", F.explode(F.transform(step, lambda i: F.floor(F.col("top") / F.lit(size)) + i)))
    return out.withColumn("_bx", F.explode(F.transform(step, lambda i: F.floor(F.col("left") / F.lit(size)) + i)))


def _free_of(pool: DataFrame, picks: DataFrame, *, cube: list[str], size: int, patch: int, allowed: float | None) -> DataFrame:
    """Corners that clash with none of the picks, as a pick does with itself. A clash reaches no further than the next
    bucket. If whole patches may overlap, only the same corner clashes."""
    own = pool.withColumns({"_by": F.floor(F.col("top") / F.lit(size)), "_bx": F.floor(F.col("left") / F.lit(size)), "_a_top": F.col("top"), "_a_left": F.col("left")})
    near = _around(picks.select(*cube, "top", "left"), size).withColumnsRenamed({"top": "_b_top", "left": "_b_left"})
    if allowed is None or allowed >= patch * patch:
        clash = (F.col("_a_top") == F.col("_b_top")) & (F.col("_a_left") == F.col("_b_left"))
    else:
        clash = _shared_area(patch, "_a", "_b") > allowed
    near = near.select(*[F.col(c).alias(f"_c_{c}") for c in cube], F.col("_by").alias("_c_by"), F.col("_bx").alias("_c_bx"), "_b_top", "_b_left")
    same = fold_all([F.col(c) == F.col(f"_c_{c}") for c in cube] + [F.col("_by") == F.col("_c_by"), F.col("_bx") == F.col("_c_bx")])
    return own.join(near, same & clash, "left_anti").select(*pool.columns)


def stratified_patches(
    df: DataFrame, *, cube: list[str], y: str, x: str, code: str, n_patches: int, patch: int, height: int, width: int,
    max_overlap: float | None = 0.05, seed: int = 0,
) -> DataFrame:
    """Centres drawn per class in hash order, clamped to the cube, greedily kept when they overlap earlier
    ones by at most ``max_overlap`` (``None``: merely distinct corners).

    The greedy walk is done in rounds of picks that can't clash. Corners lie in buckets as wide as a clash reaches; one
    that comes before all others in its own and the eight buckets around it is what the walk would take, whatever
    else it takes. Each round takes all of these in all cubes, then drops the corners they clash with and those
    that come after the class's quota of picks. So a class needs few rounds, a cube is spread over as many tasks
    as it has buckets, and the result is that of the walk. Classes follow one another. Rounds are stored, and
    the driver sees counts only.
    """
    quota = patch_allocation(df, cube=cube, code=code, n_patches=n_patches).select(*cube, F.col(code).alias("code"), F.col("n_patches").alias("quota"))
    clamp = lambda c, size: F.greatest(F.lit(0), F.least(F.lit(size - patch), F.col(c) - patch // 2)).cast("int")
    corners = df.filter(F.col(code).isin(L.VEGETATION_CODES)).select(
        *cube, F.col(code).alias("code"), clamp(y, height).alias("top"), clamp(x, width).alias("left"), hash_text(seed, F.col(y), F.col(x)).alias("h")
    ).groupBy(*cube, "code", "top", "left").agg(F.min("h").alias("h"))
    corners, quota = stored(corners, "corners"), stored(quota, "quotas")
    allowed = patch * patch * max_overlap if max_overlap is not None else None
    size = patch if max_overlap is not None else 1
    clashes = dict(cube=cube, size=size, patch=patch, allowed=allowed)
    order = Window.partitionBy(*cube).orderBy("h", "top", "left")
    done: list[DataFrame] = []
    for kind in (r.code for r in quota.select("code").distinct().orderBy("code").collect()):  # the vegetation classes met
        left = quota.filter(F.col("code") == kind)
        pool = corners.filter(F.col("code") == kind)
        if done:
            chosen = reduce(DataFrame.unionByName, done)
            pool = _free_of(pool, chosen, **clashes)
            left = left.join(chosen.groupBy(*cube).agg(F.count(F.lit(1)).alias("_t")), cube, "left")
            left = left.withColumn("quota", F.least("quota", n_patches - F.coalesce("_t", F.lit(0))))
        state = pool.join(left.filter("quota > 0").select(*cube, F.least("quota", F.lit(n_patches)).alias("_q")), cube).withColumn("_picked", F.lit(False))
        while True:
            state = stored(_round(state, order, cube=cube, clashes=clashes), "patch-round")
            if not state.filter("NOT _picked").limit(1).count():
                break
        done.append(state.filter("_picked").select(*cube, "code", "top", "left", "h"))
    if not done:
        return corners.limit(0).select(*cube, "code", "top", "left", F.lit(0).alias("patch_no"))
    number = F.row_number().over(Window.partitionBy(*cube).orderBy("code", "h")).cast("int")
    return reduce(DataFrame.unionByName, done).select(*cube, F.col("code").cast("int").alias("code"), "top", "left", number.alias("patch_no"))


def _round(state: DataFrame, order: WindowSpec, *, cube: list[str], clashes: dict) -> DataFrame:
    """The corners of one class after one more round: picked ones, and those that may still be picked."""
    size, pool = clashes["size"], state.filter("NOT _picked")
    first = _around(pool, size).groupBy(*cube, "_by", "_bx").agg(F.min(F.struct("h", "top", "left", "code", "_q")).alias("_m"))
    own = (F.floor(F.col("_m.top") / F.lit(size)) == F.col("_by")) & (F.floor(F.col("_m.left") / F.lit(size)) == F.col("_bx"))
    new = first.filter(own).select(*cube, "_m.*").withColumn("_picked", F.lit(True))
    picks = state.filter("_picked").unionByName(new).withColumn("_o", F.row_number().over(order)).filter("_o <= _q").drop("_o")
    full = picks.groupBy(*cube).agg(F.count(F.lit(1)).alias("_n"), F.max("h").alias("_h"), F.max("_q").alias("_all")).filter("_n = _all").select(*cube, "_h")
    rest = _free_of(pool, picks, **clashes).join(full, cube, "left").filter(F.col("_h").isNull() | (F.col("h") < F.col("_h"))).drop("_h")
    return picks.unionByName(rest.select(*picks.columns))


# ---- channels --------------------------------------------------------------------------------------
def one_hot_landcover(code: Column) -> list[Column]:
    """Twelve 0/1 columns ``lc_<label>``; an unknown label is an error."""
    known = F.coalesce(code.isin(L.LANDCOVER_LABELS), F.lit(False))
    error = F.raise_error(F.concat(F.lit("unknown land-cover label "), F.coalesce(code.cast("string"), F.lit("NULL")))).cast("int")
    return [F.when(known, (code == v).cast("int")).otherwise(error).alias(f"lc_{v}") for v in L.LANDCOVER_LABELS]


def channel_layout(optical: list[str], radar: list[str], climate: list[str], static: list[str], target: str = "kNDVI") -> dict[str, list[str]]:
    """Ordered channel names of the context and the future vector (shared channels first)."""
    shared = [*climate, *[f"lc_{v}" for v in L.LANDCOVER_LABELS], *static]
    masks = ["mask_target", "mask_s2"] + (["mask_s1"] if radar else [])
    context = [target, *shared, *[c for c in optical if c != target], *radar, *masks]
    return {"context": context, "future": ["placeholder", *shared]}


def channel_vectors(df: DataFrame, layout: dict[str, list[str]], *, part: str, expected: int | None = None) -> DataFrame:
    """Array column ``channels`` in layout order; ``expected`` checks the count."""
    names = layout[part]
    if expected is not None and expected != len(names):
        raise ValueError(f"{part}: {len(names)} channels, expected {expected}")
    cols = [F.lit(0.0) if n == "placeholder" else F.col(n).cast("float") for n in names]
    return df.withColumn("channels", F.array(*[c.cast("float") for c in cols]))
