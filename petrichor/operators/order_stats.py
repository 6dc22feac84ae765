"""Exact order statistics and row numbers that never bring a whole group to one task.

Spark's ``percentile`` holds all distinct values of a group in one hash map and ``row_number`` sorts a
group in one task. Both are right for small groups. Here a group may hold a third of the data, so

* percentiles of hot groups take two steps: a mergeable sketch gives a narrow value bracket around the
  wanted rank, then rows below the bracket are counted and only rows inside it are ranked;
* groups are routed by their counted rows;
* row numbers are the sum of an offset (rows of the group in earlier hash buckets, a plain count) and
  the rank inside one hash bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from petrichor.functions.scalar import as_text, fold_all, hash_text
from petrichor.session import stored

ALL = "_all"
#: Rows of one group that a task may sort.
TASK_ROWS = 2_000_000


def _join_keys(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", keep: str | None = None
) -> DataFrame:
    """Equi-join in which NULL keys match; the right key columns are dropped (``keep``: one right column)."""
    if keep:
        right = right.select(*keys, keep)
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = fold_all([F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(renamed, cond, how)
    return joined.drop(*[f"_r_{k}" for k in keys])


def ranked_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], accuracy: int = 100_000
) -> DataFrame:
    """Exact linear percentiles per group for groups of any size; columns keys + ``p0``, ``p1``, ...

    The groups' brackets, a row each, are broadcast: rows shuffled to their bracket would be one task's work per group.
    """
    keys = keys or [ALL]
    if keys == [ALL]:
        df = df.withColumn(ALL, F.lit(0))
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    eps = 3.0 / accuracy
    edges = F.array(*[F.lit(max(0.0, p - eps)) for p in probs], *[F.lit(min(1.0, p + eps)) for p in probs])
    sketch = rows.groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        F.percentile_approx("_v", edges, F.lit(accuracy)).alias("_edges"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )
    # Below `accuracy` rows the rank margin is less than one row, so the bracket is the whole group.
    small = F.col("_n") <= accuracy
    sketch = sketch.withColumns({"_low": F.slice("_edges", 1, len(probs)), "_high": F.slice("_edges", len(probs) + 1, len(probs))})
    brackets = sketch.select(
        *keys,
        "_n",
        F.arrays_zip(
            F.sequence(F.lit(0), F.lit(len(probs) - 1)).alias("i"),
            F.when(small, F.transform("_low", lambda x: F.col("_min"))).otherwise(F.col("_low")).alias("low"),
            F.when(small, F.transform("_high", lambda x: F.col("_max"))).otherwise(F.col("_high")).alias("high"),
        ).alias("_b"),
    )
    if keys == [ALL]:  # one row of brackets: a scalar subquery, no join
        one = brackets.select(F.struct("_n", "_b").alias("_s")).scalar()
        tagged = rows.withColumns({"_n": one["_n"], "_b": one["_b"]})
    else:
        tagged = _join_keys(rows, F.broadcast(brackets), keys)
    below = tagged.groupBy(*keys).agg(
        *[F.count_if(F.col("_v") < F.col("_b")[i]["low"]).alias(f"_below{i}") for i in range(len(probs))]
    ).select(*keys, F.posexplode(F.array(*[F.col(f"_below{i}") for i in range(len(probs))])).alias("_i", "_below"))
    inside = (
        tagged.select(
            *keys,
            "_n",
            "_v",
            F.explode(F.filter("_b", lambda b: (b["low"] <= F.col("_v")) & (F.col("_v") <= b["high"]))).alias("_e"),
        )
        .groupBy(*keys, "_n", F.col("_e.i").alias("_i"), "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    stacked = _join_keys(inside.withColumn("_cum", F.sum("_c").over(upto)), below, keys + ["_i"])
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1)
    position = prob * (F.col("_n") - 1)
    reached = F.col("_below") + F.col("_cum")
    low = F.min(F.when(reached > F.floor(position), F.col("_v")))
    high = F.min(F.when(reached > F.ceil(position), F.col("_v")))
    picked = stacked.groupBy(*keys, "_i").agg(
        low.alias("_lo"), high.alias("_hi"), F.first(position - F.floor(position)).alias("_f"),
        F.max(F.col("_below") > F.floor(position)).alias("_missed"),
    )
    exact = F.when(
        F.col("_missed") | F.col("_lo").isNull() | F.col("_hi").isNull(),
        F.raise_error(F.lit("percentile bracket missed its rank")).cast("double"),
    ).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f"))
    wide = picked.withColumn("_p", exact).groupBy(*keys).agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_p"))).alias(f"p{i}") for i in range(len(probs))]
    )
    return wide.drop(ALL)


def sorted_percentiles(df: DataFrame, keys: list[str], values: list[str], probs: list[float], extra: list[Column]) -> DataFrame:
    """Percentiles of groups that fit a task: one shuffle on the keys.

    One value is ranked by a window (sorting spills and beats the percentile aggregate's per-group map about
    threefold when groups are many and small); several values share the shuffle as sorted arrays.
    """
    index = lambda p, n: p * (n - 1)
    if len(values) == 1:
        v = values[0]
        group = Window.partitionBy(*keys)
        ranked = df.withColumn(v, F.col(v).cast("double")).withColumn("_r", F.row_number().over(group.orderBy(F.col(v).asc_nulls_last())) - 1)
        ranked = ranked.withColumn("_n", F.count(v).over(group))
        cols = []
        for i, p in enumerate(probs):
            pos = index(p, F.col("_n"))
            low = F.max(F.when(F.col("_r") == F.floor(pos), F.col(v)))
            high = F.max(F.when(F.col("_r") == F.ceil(pos), F.col(v)))
            cols.append((low + (high - low) * F.max(pos - F.floor(pos))).alias(f"{v}_p{i}"))
        return ranked.groupBy(*keys).agg(*cols, *extra)
    out = df.groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.col(v).cast("double"))).alias(f"_a_{v}") for v in values], *extra)
    cols = []
    for v in values:
        a, n = F.col(f"_a_{v}"), F.size(f"_a_{v}")
        for i, p in enumerate(probs):
            pos = index(p, n)
            low, high = F.try_element_at(a, (F.floor(pos) + 1).cast("int")), F.try_element_at(a, (F.ceil(pos) + 1).cast("int"))
            cols.append(F.when(n > 0, low + (high - low) * (pos - F.floor(pos))).alias(f"{v}_p{i}"))
    return out.select(*keys, *cols, *[c for c in out.columns if c not in keys and not c.startswith("_a_")])


def group_percentiles(
    df: DataFrame,
    keys: list[str],
    values: list[str],
    probs: list[float],
    extra: list[Column] = (),
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Exact percentiles per group: keys + ``<value>_p<i>`` (+ ``extra`` aggregates, any mergeable ones).

    The rows of every group are counted, which combines before the shuffle: groups of more than ``task_rows`` rows
    take the two-step ranking, all others one shuffle. Both ways are exact; the counts only route the rows.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > task_rows).drop("_n")
    cold_rows = _join_keys(df, hot, keys, "left_anti")
    cold = sorted_percentiles(cold_rows, keys, values, probs, list(extra))
    hot_rows_df = _join_keys(df, hot, keys, "left_semi")
    melted = hot_rows_df.select(
        *keys,
        F.inline(F.array(*[F.struct(F.lit(v).alias("_k"), F.col(v).cast("double").alias("_x")) for v in values])),
    )
    ranked = ranked_percentiles(melted, keys + ["_k"], "_x", probs)
    pivoted = ranked.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("_k") == v, F.col(f"p{i}"))).alias(f"{v}_p{i}")
            for v in values
            for i in range(len(probs))
        ]
    )
    # a group whose values are all NULL has no ranked row but must stay
    whole = hot_rows_df.groupBy(*keys).agg(*extra) if extra else hot
    pivoted = _join_keys(whole, pivoted, keys, "left")
    return cold.unionByName(pivoted.select(*cold.columns))


def numbered(
    df: DataFrame,
    keys: list[str],
    unique: list[str],
    seed: int | str = 0,
    *,
    out: str = "idx",
    size: str | None = None,
    first_n: int | None = None,
    digits: int = 4,
) -> DataFrame:
    """0-based row number per group in hash order of ``unique`` (which must identify a row of the group).

    ``first_n`` keeps the first n rows of every group, deciding whole buckets by their counts.
    ``size`` adds the group's row count. A task ranks one of ``16**digits`` buckets of one group.
    """
    # One struct column as group key: it is never NULL itself and its NULL fields compare equal, so plain
    # equality keeps NULL groups, and counting, joining and ranking share one partitioning.
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    hashed = df.withColumns({"_g": group, "_h": hash_text(seed, *[F.col(u) for u in unique])})
    hashed = hashed.withColumn("_b", F.substring("_h", 1, digits))
    counts = hashed.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_c"))
    ordered = Window.partitionBy("_g").orderBy("_b")
    before = F.coalesce(F.sum("_c").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_off", before)
    if size:
        offsets = offsets.withColumn(size, F.sum("_c").over(Window.partitionBy("_g")))
    if first_n is not None:
        offsets = offsets.filter(F.col("_off") < first_n)
    placed = hashed.join(offsets.drop("_c"), ["_g", "_b"])
    within = Window.partitionBy("_g", "_b").orderBy("_h", *unique)
    placed = placed.withColumn(out, (F.row_number().over(within) - 1 + F.col("_off")).cast("bigint"))
    if first_n is not None:
        placed = placed.filter(F.col(out) < first_n)
    return placed.drop("_h", "_b", "_off", "_g")


def ranked_in_order(df: DataFrame, keys: list[str], order: list[str], *, out: str = "rank", size: str | None = None) -> DataFrame:
    """0-based row number per group in the order of ``order`` (NULL first), for groups of any size.

    Rows are dealt to tasks by range of (keys, order) and stored once. A rank is the number of the group's rows in
    earlier tasks plus the place in the task; only counts per (group, task) are added up. Rows that agree in
    ``order`` are numbered in some order of their own. ``size`` adds the group's row count.
    """
    by = [*keys, *order]
    rows = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranked")
    rows = rows.withColumn("_g", F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0))  # a struct: NULL keys compare equal
    counts = rows.groupBy("_g", "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    group = Window.partitionBy("_g")
    earlier = F.coalesce(F.sum("_n").over(group.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_g", "_task", "_first", earlier.alias("_earlier"), *([F.sum("_n").over(group).alias(size)] if size else []))
    placed = rows.join(offsets, ["_g", "_task"]).withColumn(out, F.col("_earlier") + F.col("_at") - F.col("_first"))
    return placed.drop("_g", "_task", "_at", "_first", "_earlier")


def rank_table(df: DataFrame, value: str, *, keys: list[str] = ()) -> DataFrame:
    """(keys, value, lower, count, n, avg_rank) per distinct value of a column of any size.

    ``lower`` rows are smaller, ``n`` is the group's row count. The running sum over distinct values is split
    into value ranges by an approximate-quantile bucketing, so one task sums one range.
    """
    keys = list(keys) or [ALL]
    if keys == [ALL]:
        df = df.withColumn(ALL, F.lit(0))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("count"))
    cuts = counts.groupBy(*keys).agg(
        F.percentile_approx(value, F.array(*[F.lit(i / 256) for i in range(1, 256)]), F.lit(2000)).alias("_cuts")
    )
    if keys == [ALL]:
        with_cuts = counts.withColumn("_cuts", cuts.select("_cuts").scalar())
    else:
        with_cuts = _join_keys(counts, cuts, keys)
    bucketed = with_cuts.withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = bucketed.groupBy(*keys, "_b").agg(F.sum("count").alias("_t"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"), F.sum("_t").over(group).alias("n")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = _join_keys(bucketed, offsets, keys + ["_b"]).withColumn(
        "lower", F.col("_off") + F.coalesce(F.sum("count").over(inside), F.lit(0))
    )
    rank = F.col("lower") + (F.col("count") + 1) / F.lit(2.0)
    return ranks.select(*[k for k in keys if k != ALL], value, "lower", "count", "n", rank.alias("avg_rank"))


def average_ranks(df: DataFrame, value: str, *, out: str = "avg_rank", keys: list[str] = ()) -> DataFrame:
    """Average rank per row (ties share their mean rank), NULL for a NULL value."""
    keys = list(keys)
    ranks = rank_table(df, value, keys=keys).select(*keys, value, F.col("avg_rank").alias(out))
    return _join_keys(df, ranks, [*keys, value], "left")
