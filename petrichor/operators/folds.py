"""Cross-validation folds over cube metadata, and the checks that make them leak-free."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from petrichor.functions.scalar import flag, n_rows, reasons
from petrichor.operators.order_stats import numbered, ranked_in_order


def train_test(df: DataFrame, *, unique: str, test_share: float = 0.15, seed: int = 42) -> DataFrame:
    """Hash-ordered split; the test side has ceil(n * share) rows."""
    out = numbered(df, [], [unique], seed, out="_pos", size="_n")
    return out.withColumn("split", F.when(F.col("_pos") < F.ceil(F.col("_n") * test_share), "test").otherwise("train")).drop("_pos", "_n")


def _block(pos: Column, n: Column, k: Column) -> Column:
    """K-fold block of a shuffled position: the first n mod k blocks have one unit more."""
    size, rest = F.floor(n / k), n % k
    edge = rest * (size + 1)
    return F.when(pos < edge, F.floor(pos / (size + 1))).otherwise(rest + F.floor((pos - edge) / F.nullif(size, F.lit(0)))).cast("int")


def unit_folds(df: DataFrame, *, unit: str, k: int | Column, seed: int = 42, strata: str | None = None, test_share: float = 0.15) -> DataFrame:
    """(unit, fold): distinct units in hash order cut into k blocks; k = 1 puts a share into fold 0.

    With ``strata`` (a text class) units are dealt round-robin in class order, so that every class and every
    fold is balanced.
    """
    keys = [strata] if strata else []
    if strata and dict(df.dtypes)[strata] not in ("string",) and not dict(df.dtypes)[strata].startswith(("char", "varchar")):
        raise ValueError("the stratification column must be categorical")
    units = numbered(df.select(unit, *keys).distinct(), keys, [unit], seed, out="_pos", size="_n")
    kk = k if isinstance(k, Column) else F.lit(k)
    single = F.when(F.col("_pos") < F.ceil(F.col("_n") * test_share), 0)
    if strata:  # one row per class
        sizes = units.groupBy(strata).agg(n_rows().alias("_c"))
        before = Window.orderBy(strata).rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select(strata, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
        units = units.join(starts, strata)
        many = ((F.col("_start") + F.col("_pos")) % kk).cast("int")
    else:
        many = _block(F.col("_pos"), F.col("_n"), kk)
    return units.select(unit, *keys, F.when(kk == 1, single).otherwise(many).alias("fold"))


def spacetime_folds(
    df: DataFrame, *, space: str | None = None, time: str | None = None, k: int = 3, strata: str | None = None, seed: int = 42
) -> DataFrame:
    """Leave-location-out, leave-time-out or both: one row per (fold, cube) with its role.

    Validation: location (and time) in the fold. Training: location not in (and time not in) it. Anything
    else is excluded. k shrinks to the number of units.
    """
    if not (space or time):
        raise ValueError("a space or a time column is needed")
    units = [c for c in (space, time) if c]
    counts = df.agg(*[F.count_distinct(c).alias(f"_n_{c}") for c in units])
    limit = [counts.select(f"_n_{c}").scalar() for c in units]
    kk = F.least(F.lit(k), *limit).cast("int")
    out = df
    for c in units:
        # the join side has one row per unit
        f = unit_folds(df, unit=c, k=kk, seed=seed, strata=strata if c == space else None).withColumnRenamed("fold", f"_f_{c}")
        on = [c, strata] if strata and c == space else [c]
        out = out.join(f, on, "left")
    out = out.withColumn("_k", kk).withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    hits = [F.coalesce(F.col(f"_f_{c}") == F.col("fold"), F.lit(False)) for c in units]
    inside = hits[0] if len(hits) == 1 else hits[0] & hits[1]
    outside = ~hits[0] if len(hits) == 1 else ~hits[0] & ~hits[1]
    role = F.when(inside, "val").when(outside, "train").otherwise("excluded")
    return out.withColumn("subset", role).drop("_k", *[f"_f_{c}" for c in units])


def _turns(loads: list[int], size: int) -> list[tuple[int, list[int]]]:
    """Who gets which of any number of groups of one size, each going to the lightest fold: (first group, folds that
    take turns from there on).

    Fold f's j-th group makes its load ``loads[f] + j * size`` before, so the groups take these numbers in ascending
    order, ties by fold. Counted in whole sizes, a fold takes part from the level ``loads[f] // size`` on, and inside
    a level the remainder and then the index decide: water filling with one step per fold that joins in.
    """
    level, rest = [n // size for n in loads], [n % size for n in loads]
    out = []
    for at in sorted(set(level)):
        joined = sorted((f for f in range(len(loads)) if level[f] <= at), key=lambda f: (rest[f], f))
        out.append((sum(at - level[f] for f in joined), joined))
    return out


def _filled(loads: list[int], size: int, groups: int, turns: list[tuple[int, list[int]]]) -> list[int]:
    loads = list(loads)
    for i, (first, joined) in enumerate(turns):
        upto = min(groups, turns[i + 1][0]) if i + 1 < len(turns) else groups
        whole, more = divmod(max(0, upto - first), len(joined))
        for place, f in enumerate(joined):
            loads[f] += size * (whole + (place < more))
    return loads


def balanced_group_folds(df: DataFrame, *, group: list[str], k: int) -> DataFrame:
    """Group k-fold: groups by descending size, each to the lightest fold (lowest index on a tie); groups of one size
    go by their label.

    Only the distinct sizes are sequential. There are at most sqrt(2 * rows) of them, as their sum can't exceed the
    rows; they come to the driver as (size, number of groups), and for each the folds' turns follow in closed form.
    A group finds its fold from its number among the groups of its size, which are spread over tasks.
    """
    label = F.concat_ws("_", *[F.col(c).cast("string") for c in group])
    tagged = df.withColumn("cv_group", label)
    sizes = ranked_in_order(tagged.groupBy("cv_group").agg(n_rows().alias("_n")), ["_n"], ["cv_group"], out="_i")
    loads, turns = [0] * k, []
    for n, groups in sorted(map(tuple, sizes.groupBy("_n").agg(n_rows()).collect()), reverse=True):
        own = _turns(loads, n)
        turns.append((n, own))
        loads = _filled(loads, n, groups, own)
    plan = df.sparkSession.createDataFrame(turns, "_n bigint, _turns array<struct<first: bigint, folds: array<int>>>")
    now = F.element_at(F.filter("_turns", lambda t: t["first"] <= F.col("_i")), -1)
    dealt = sizes.join(plan, "_n").withColumn("_now", now)
    place = F.pmod(F.col("_i") - F.col("_now.first"), F.size("_now.folds")).cast("int")
    return tagged.join(dealt.select("cv_group", F.get("_now.folds", place).alias("fold")), "cv_group")


def _roles(df: DataFrame, chosen_space: DataFrame, chosen_time: DataFrame, *, space: str, time: str, by: list[str]) -> DataFrame:
    s = chosen_space.select(*by, space).distinct().withColumn("_s", F.lit(True))
    t = chosen_time.select(*by, time).distinct().withColumn("_t", F.lit(True))
    out = df.join(s, [*by, space], "left").join(t, [*by, time], "left")
    in_s, in_t = F.coalesce("_s", F.lit(False)), F.coalesce("_t", F.lit(False))
    role = F.when(in_s & in_t, "val").when(~in_s & ~in_t, "train").otherwise("excluded")
    return out.withColumn("subset", role).drop("_s", "_t")


def _draw_units(df: DataFrame, *, unit: str, divisor: int, folds: int, tries: int, seed: int) -> DataFrame:
    """(fold, draw, unit): max(1, units // divisor) distinct units per draw, those with its smallest hashes."""
    units = df.select(unit).distinct()
    take = F.greatest(F.lit(1), F.floor(units.agg(n_rows().alias("n")).select("n").scalar() / divisor))
    copies = units.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn(
        "draw", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))
    )
    token = F.concat_ws("|", "fold", "draw", unit)
    ranked = numbered(copies.withColumn("_u", token), ["fold", "draw"], ["_u"], seed, out="_pos", digits=1)
    return ranked.filter(F.col("_pos") < take).select("fold", "draw", unit)


def random_strict_folds(
    df: DataFrame, *, space: str, time: str, k: int, min_val_share: float = 0.15, min_train_share: float = 0.1, tries: int = 500, seed: int = 0,
    all_folds: bool = True,
) -> DataFrame:
    """Strict space-time folds by search: per fold the first draw of a quarter of the locations and a third
    of the seasons whose validation side is large enough. Cubes enter the search only as a (location,
    season) count table. A fold for which none of the ``tries`` draws is large enough is an error, or has no rows if not
    ``all_folds`` are asked for.
    """
    locs = _draw_units(df, unit=space, divisor=4, folds=k, tries=tries, seed=seed)
    seas = _draw_units(df, unit=time, divisor=3, folds=k, tries=tries, seed=seed)
    grid = df.groupBy(space, time).agg(n_rows().alias("_c"))
    total = df.agg(n_rows().alias("n")).select("n").scalar()
    by_loc = grid.groupBy(space).agg(F.sum("_c").alias("_c"))
    by_sea = grid.groupBy(time).agg(F.sum("_c").alias("_c"))
    # train = total - chosen locations - chosen seasons + their intersection (= validation)
    n_loc = locs.join(by_loc, space).groupBy("fold", "draw").agg(F.sum("_c").alias("_loc"))
    n_sea = seas.join(by_sea, time).groupBy("fold", "draw").agg(F.sum("_c").alias("_sea"))
    n_val = locs.join(grid, space).join(seas, ["fold", "draw", time]).groupBy("fold", "draw").agg(F.sum("_c").alias("n_val"))
    sizes = n_loc.join(n_sea, ["fold", "draw"]).join(n_val, ["fold", "draw"], "left").withColumn("n_val", F.coalesce("n_val", F.lit(0)))
    sizes = sizes.withColumn("n_train", total - F.col("_loc") - F.col("_sea") + F.col("n_val"))
    good = sizes.filter((F.col("n_val") >= F.floor(total * min_val_share)) & (F.col("n_train") > total * min_train_share))
    first = good.groupBy("fold").agg(F.min("draw").alias("draw"))
    if all_folds:
        every = df.sparkSession.range(k).select(F.col("id").cast("int").alias("fold"))
        missing = F.raise_error(F.concat(F.lit(f"no strict draw in {tries} tries is large enough for fold "), F.col("fold").cast("string"))).cast("int")
        first = every.join(first, "fold", "left").withColumn("draw", F.when(F.col("draw").isNull(), missing).otherwise(F.col("draw")))
    rows = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).join(first, "fold")
    return _roles(rows, locs, seas, space=space, time=time, by=["fold", "draw"]).drop("draw")


def chunked_strict_folds(df: DataFrame, *, space: str, time: str, k: int, seed: int = 42) -> DataFrame:
    """Strict folds from disjoint location chunks; every fold validates a third of the seasons.

    Chunks have max(1, L // k) locations, the last one also takes the remainder.
    """
    locs = numbered(df.select(space).distinct(), [], [space], seed, out="_pos", size="_n")
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / k))
    chunk = F.least(F.floor(F.col("_pos") / size), F.lit(k - 1)).cast("int")
    locs = locs.select(space, chunk.alias("fold"))
    seas = _draw_units(df, unit=time, divisor=3, folds=k, tries=1, seed=seed).select("fold", time)
    rows = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return _roles(rows, locs, seas, space=space, time=time, by=["fold"])


# ---- checks ----------------------------------------------------------------------------------------
def validation_overlaps(membership: DataFrame, *, cube: str) -> DataFrame:
    """Cubes that validate in more than one fold (empty = disjoint)."""
    return membership.filter(F.col("subset") == "val").groupBy(cube).agg(F.count_distinct("fold").alias("n_folds")).filter(F.col("n_folds") > 1)


def shared_groups(membership: DataFrame, *, group: str) -> DataFrame:
    """Groups present on both sides of a fold (empty = strict)."""
    used = membership.filter(F.col("subset").isin("train", "val"))
    return used.groupBy("fold", group).agg(F.count_distinct("subset").alias("n_sides")).filter(F.col("n_sides") > 1)


def strict_fold_check(membership: DataFrame, *, k: int, space: str, time: str) -> DataFrame:
    """Per fold: found, sizes, and no location or season on both sides."""
    by = lambda c: shared_groups(membership, group=c).groupBy("fold").agg(n_rows().alias(f"shared_{c}"))
    sizes = membership.groupBy("fold").agg(*[F.count_if(F.col("subset") == s).alias(f"n_{s}") for s in ("train", "val", "excluded")])
    folds = membership.sparkSession.range(k).select(F.col("id").cast("int").alias("fold"))
    out = folds.join(sizes, "fold", "left").join(by(space), "fold", "left").join(by(time), "fold", "left")
    return out.fillna(0).withColumn("found", flag(F.col("n_val") > 0))


def explode_splits(splits: DataFrame, *, fold: str, train: str, val: str) -> DataFrame:
    """Array documents to (fold, subset, file)."""
    return splits.select(F.col(fold).alias("fold"), F.explode(F.map_from_arrays(F.array(F.lit("train"), F.lit("val")), F.array(F.col(train), F.col(val)))).alias("subset", "_files")).select("fold", "subset", F.explode("_files").alias("file"))


def split_membership(files: DataFrame, metadata: DataFrame, *, cube: str, climate: str) -> tuple[DataFrame, DataFrame]:
    """(membership with metadata, per-fold problems: missing ids, overlap, climate class on both sides)."""
    joined = files.join(metadata.withColumn("_known", F.lit(1)), cube, "left")
    per_cube = joined.groupBy("fold", cube).agg(F.count_distinct("subset").alias("_sides"), F.max("_known").alias("_k"))
    cubes = per_cube.groupBy("fold").agg(F.count_if(F.col("_sides") > 1).alias("n_overlap"), F.count_if(F.col("_k").isNull()).alias("n_missing"))
    classes = joined.groupBy("fold", climate).agg(F.count_distinct("subset").alias("_sides")).groupBy("fold").agg(F.count_if(F.col("_sides") > 1).alias("n_shared_classes"))
    report = cubes.join(classes, "fold")
    why = reasons(
        [
            (F.col("n_missing") > 0, "missing_metadata"),
            (F.col("n_overlap") > 0, "train_val_overlap"),
            (F.col("n_shared_classes") > 0, "climate_class_on_both_sides"),
        ]
    )
    return joined.drop("_known"), report.withColumn("problem", why)


def summarise_folds(membership: DataFrame, *, climate: str) -> DataFrame:
    """Cube and climate-class counts per side and the list of withheld classes (classes are few)."""
    val, train = F.col("subset") == "val", F.col("subset") == "train"
    return membership.groupBy("fold").agg(
        F.count_if(train).alias("n_train"), F.count_if(val).alias("n_val"),
        F.count_distinct(F.when(train, F.col(climate))).alias("n_train_classes"),
        F.count_distinct(F.when(val, F.col(climate))).alias("n_val_classes"),
        F.array_join(F.array_sort(F.collect_set(F.when(val, F.col(climate)))), ",").alias("withheld_classes"),
    )


def subset_shares(membership: DataFrame, *, group: list[str] = ()) -> DataFrame:
    """train / validation / excluded counts and percent per fold (and group)."""
    out = membership.groupBy("fold", *group).agg(
        n_rows().alias("n_total"), *[F.count_if(F.col("subset") == s).alias(f"n_{s}") for s in ("train", "val", "excluded")]
    )
    return out.withColumns({f"pct_{s}": F.col(f"n_{s}") * 100.0 / F.col("n_total") for s in ("train", "val", "excluded")})


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))
