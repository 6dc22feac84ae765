"""Mixing sources to target weights with Sainte-Laguë quotas of equal-token blocks.

Every source is a cyclic stream: its documents in seeded hash order, repeated pass after pass and cut into blocks
of equal length. The apportionment gives each (shard, source) an integer number of blocks; a shard takes the next
blocks of the stream. Since the documents lie in seeded order, a run of blocks is a random choice that cuts at
most two documents. No block is ever a row: a source's share is one number, and the place in the hash order where
its last pass ends is found from counts (``mix``); ``mix_by_shard`` places every document in its source's stream and
says which shards take which part of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from petrichor.llm.common import WORD, fresh, small_or_not, written

#: Hex digits of the order key that make a bucket: 4096 per source.
BUCKET_DIGITS = 3


def _keyed(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))
    return df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"))


def targets(sizes: DataFrame, *, weights: list[int], repeats: int) -> DataFrame:
    """(rank, source, source_size, weight, target): shares by weight, never above ``repeats`` times the source.

    Raising all targets in proportion to their weights until the whole size is used, while full sources stand
    still, is the fixed point of resharing the excess. The sources are ordered by how early they fill up; the
    first prefix after which the next one isn't full gives the level. One row per source goes through this window.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = ranked.withColumns({"weight": w.cast("long"), "most": F.col("source_size") * repeats})
    early = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("rank").asc())
    before = early.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(Window.partitionBy())
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0))
    open_weight = F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumns({"level": left.cast("double") / open_weight, "full": F.col("most") / F.col("weight")})
    # the first source that isn't full at the level left to it ends the prefix of full ones
    ends = F.min(F.when(F.col("full") >= F.col("level"), F.struct("full", "rank", "level"))).over(Window.partitionBy())
    target = F.when(F.struct("full", "rank") < F.struct(ends["full"], ends["rank"]), F.col("most").cast("double")).otherwise(F.col("weight") * ends["level"])
    return rows.select("rank", "source", "source_size", "weight", F.least(F.coalesce(target, F.lit(0.0)), F.col("most").cast("double")).alias("target"))


def quotas(plan: DataFrame, *, block: int, shards: int) -> DataFrame:
    """(shard, rank, blocks): blocks that each shard takes from each source, by highest quotients
    target / (2 s + 1).

    The seats of shards 0..h together are apportioned as one house. Quotas never shrink as the house grows, so
    a shard's blocks are the difference of two houses. With k sources, rounding target / D at
    D = T / (house - k/2) never gives out too many seats and at D = T / (house + k/2) never too few, so only
    the few quotients between the two have to be ranked.
    """
    total, k = F.sum("target").over(Window.partitionBy()), F.count(F.lit(1)).over(Window.partitionBy())
    rows = plan.select("rank", "target", total.alias("total"), k.alias("k")).filter("target > 0")
    houses = rows.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    house = F.floor(F.round(F.col("total") / block) * (F.col("shard") + 1) / shards)
    houses = houses.withColumn("house", house).withColumns(
        {
            "low": F.when(F.col("house") > F.col("k") / 2, F.floor(F.col("target") * (F.col("house") - F.col("k") / 2) / F.col("total") + 0.5)).otherwise(F.lit(0)),
            "high": F.ceil(F.col("target") * (F.col("house") + F.col("k") / 2) / F.col("total") + 0.5),
        }
    )
    between = houses.withColumn("s", F.explode(F.sequence(F.col("low"), F.col("high")))).withColumn("quotient", F.col("target") / (2 * F.col("s") + 1))
    best = Window.partitionBy("shard").orderBy(F.col("quotient").desc(), F.col("rank").asc())
    given = houses.groupBy("shard").agg(F.sum("low").alias("given"))
    won = between.withColumn("place", F.row_number().over(best)).join(given, "shard").filter("place <= house - given")
    seats = houses.join(won.groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("more")), ["shard", "rank"], "left")
    seats = seats.withColumn("seats", F.col("low") + F.coalesce("more", F.lit(0)))
    earlier = F.coalesce(F.lag("seats").over(Window.partitionBy("rank").orderBy("shard")), F.lit(0))
    return seats.select("shard", "rank", (F.col("seats") - earlier).alias("blocks"))


def mixing_plan(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3,
    block: int = 64, shards: int = 16, seed: int = 7,
) -> DataFrame:
    """One row per source: its target, words taken, whole passes, and where the last pass ends.

    ``cut_key`` is the order key of the document in which the last pass ends, ``cut_words`` of its key's
    ``cut_size`` words are still taken. Sizes are first summed per (source, bucket of 1/4096 of the key range),
    before the shuffle; only the one bucket per source that holds the end is sorted.
    """
    rows = _keyed(df, id_col, text_col, source_col, seed)
    buckets = rows.groupBy("source", F.substring("key", 1, BUCKET_DIGITS).alias("bucket")).agg(F.sum("size").alias("words"))
    buckets = written(buckets, "mix-buckets")
    plan = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights=list(weights), repeats=repeats)
    blocks = quotas(plan, block=block, shards=shards).groupBy("rank").agg(F.sum("blocks").alias("blocks"), F.sort_array(F.collect_list(F.struct("shard", "blocks"))).alias("quotas"))
    taken = F.least(F.coalesce("blocks", F.lit(0)) * block, F.col("source_size") * repeats)
    plan = plan.join(blocks, "rank", "left").withColumn("source_taken", taken.cast("long"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("source_taken") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = written(plan.withColumn("passes", passes).withColumn("rest", F.col("source_taken") - F.col("passes") * F.col("source_size")), "mix-plan")
    few = small_or_not(plan.select(F.col("source").alias("p_source"), "rest"), plan.count())
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = buckets.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0))).join(few, F.col("source").eqNullSafe(F.col("p_source")))
    ends = ends.filter("rest >= before AND rest < before + words").select("p_source", F.col("bucket").alias("p_bucket"), (F.col("rest") - F.col("before")).alias("left"))
    ends = written(ends, "mix-ends")
    inside = rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)).join(
        small_or_not(ends, ends.count()), F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket"))
    )
    keys = inside.groupBy("p_source", "left", "key").agg(F.sum("size").alias("cut_size"))
    up = Window.partitionBy("p_source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    cut = keys.withColumn("before", F.coalesce(F.sum("cut_size").over(up), F.lit(0))).filter("left >= before AND left < before + cut_size")
    cut = cut.select("p_source", F.col("key").alias("cut_key"), "cut_size", (F.col("left") - F.col("before")).alias("cut_words"))
    plan = plan.join(cut, F.col("source").eqNullSafe(F.col("p_source")), "left").drop("p_source")
    return written(plan, "mix-cuts")


def mix(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3,
    block: int = 64, shards: int = 16, seed: int = 7,
) -> DataFrame:
    """Every row with size, source_size, target and taken (words that the mix takes from it, repeats counted).

    Sources in code point order, NULL last, get the weights in turn. A NULL text has no words. Rows with the
    same id share one order key: where a pass ends among them, each gives its part in proportion, rounded down.
    Nothing is shuffled but counts; the plan has one row per source and is broadcast if it is small.
    Columns with the names of the results are replaced.
    """
    outs = ["size", "source_size", "target", "taken"]
    options = dict(id_col=id_col, text_col=text_col, source_col=source_col, seed=seed)
    plan = mixing_plan(df, weights=weights, repeats=repeats, block=block, shards=shards, **options)
    df = df.drop(*[c for c in df.columns if c.lower() in outs])
    size, key, p = fresh(df, "size", "key", "plan")
    rows = df.withColumns(
        {
            size: F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"),
            key: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))),
        }
    )
    packed = plan.select(F.struct(*plan.columns).alias(p))
    rows = rows.join(small_or_not(packed, plan.count()), F.col(source_col).eqNullSafe(F.col(f"{p}.source")))
    last = (
        F.when(F.col(key) < F.col(f"{p}.cut_key"), F.col(size))
        .when(F.col(key) == F.col(f"{p}.cut_key"), F.floor(F.col(size) * F.col(f"{p}.cut_words") / F.col(f"{p}.cut_size")))
        .otherwise(F.lit(0))
    )
    return rows.select(
        *[F.col(f"`{c}`") for c in df.columns], F.col(size).alias("size"), F.col(f"{p}.source_size").alias("source_size"), F.col(f"{p}.target").alias("target"),
        (F.col(f"{p}.passes") * F.col(size) + last).cast("long").alias("taken"),
    )


def mix_by_shard(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3,
    block: int = 64, shards: int = 16, seed: int = 7,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, shards) per row: ``shards`` lists (shard, words), the words of
    the row that go to each shard, ascending, without those that take none.

    A shard's blocks of a source are the run of the source's stream after the runs of earlier shards, as long as its
    quota; only the last run is cut where ``repeats`` passes end. Rows are placed in the stream by a window over
    (source, 1/4096 of the key range), so a hot source is many tasks; texts aren't shuffled. ``taken`` is the sum over the shards.
    NULL texts have no words and NULL is a source of its own. Rows with the same id stand side by side, the
    shorter first; rows without an id are such rows. An empty table gives no rows; other columns aren't returned.
    """
    options = dict(id_col=id_col, text_col=text_col, source_col=source_col, seed=seed)
    plan = mixing_plan(df, weights=weights, repeats=repeats, block=block, shards=shards, **options)
    upto = lambda i: F.aggregate(F.slice("quotas", 1, i), F.lit(0).cast("long"), lambda n, q: n + q["blocks"]) * block
    run = lambda q, i: F.struct(q["shard"].alias("shard"), upto(i).alias("lo"), F.least(upto(i + 1), F.col("source_taken")).alias("hi"))
    no_runs = F.array().cast("array<struct<shard:int,lo:bigint,hi:bigint>>")
    runs = plan.select("source", "source_size", "target", "passes", F.coalesce(F.transform("quotas", run), no_runs).alias("runs"))
    rows = _keyed(df, id_col, text_col, source_col, seed).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    rows = written(rows, "mix-rows")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("p_source"), F.col("bucket").alias("p_bucket"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket"))).withColumn("before", F.col("before") + F.col("start"))
    packed = runs.select(F.struct(*runs.columns).alias("p"))
    placed = placed.join(small_or_not(packed, plan.count()), F.col("source").eqNullSafe(F.col("p.source")))
    passes = F.sequence(F.lit(0).cast("long"), F.col("p.passes"))
    overlap = lambda r, at: F.greatest(F.least(r["hi"], at + F.col("size")) - F.greatest(r["lo"], at), F.lit(0).cast("long"))
    words = lambda r: F.aggregate(passes, F.lit(0).cast("long"), lambda n, i: n + overlap(r, i * F.col("p.source_size") + F.col("before")))
    parts = F.filter(F.transform("p.runs", lambda r: F.struct(r["shard"].alias("shard"), words(r).alias("words"))), lambda x: x["words"] > 0)
    placed = placed.select(F.col("id").alias("doc_id"), "source", "size", F.col("p.source_size").alias("source_size"), F.col("p.target").alias("target"), parts.alias("shards"))
    taken = F.aggregate("shards", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "shards")
