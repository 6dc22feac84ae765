"""Cube bootstrap and the result tables built on it.

A group is cut into buckets of bounded size by the hash of its rows' keys. How many of a replicate's draws fall into
a bucket comes from a tree of binomial splits over the bucket sizes; inside a bucket the draws are a pure hash of
(seed, group, replicate, slot). A task turns one bucket into sums per replicate, so no draw is ever shuffled: what
moves is the rows once and one line of sums per (replicate, bucket). A group's draws depend on its own rows only.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from petrichor.functions.scalar import flag, hash_part, hash_text, n_rows, null_if_nan, safe_ratio
from petrichor.session import reused, spread
from petrichor.operators.order_stats import _join_keys, group_percentiles, rank_table, ranked_percentiles


def percentile_interval(df: DataFrame, *, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """(keys, ci_low, ci_high) over finite values; keys without one get NULLs."""
    tail = (1.0 - level) / 2.0
    finite = df.withColumn(value, null_if_nan(F.col(value)))
    if not keys:  # one row in any case
        q = ranked_percentiles(finite, [], value, [tail, 1.0 - tail])
        return df.sparkSession.range(1).select(q.select("p0").scalar().alias("ci_low"), q.select("p1").scalar().alias("ci_high"))
    q = group_percentiles(finite, keys, [value], [tail, 1.0 - tail])
    return q.withColumnsRenamed({f"{value}_p0": "ci_low", f"{value}_p1": "ci_high"})


#: Most rows of a bucket, on average; and replicates that one task computes for it.
BUCKET_ROWS, REPLICATES = 16_384, 500


def _drawn_counts(start: int, bucket: int, path: list, n: int, reps: np.ndarray) -> np.ndarray:
    """Draws of each replicate that fall into the bucket: down the tree, each node splits its count binomially by
    the sizes of its halves, from a generator seeded by (group, replicate, node)."""
    counts = np.full(len(reps), n, np.int64)
    bits = np.random.Philox(key=[0, 0])
    rng, fresh = np.random.Generator(bits), bits.state  # a new key is far cheaper than a new generator
    for level, node in enumerate(path):
        share, at = node["left"] / node["total"], level << 32 | bucket >> (len(path) - level)
        for i, rep in enumerate(reps.tolist()):
            fresh["state"]["key"] = np.array([start << 32 | rep, at], np.uint64)
            bits.state = fresh
            left = rng.binomial(counts[i], share)
            counts[i] = counts[i] - left if node["right"] else left
    return counts


def _weights(start: int, bucket: int, counts: np.ndarray, rows: int, reps: np.ndarray) -> np.ndarray:
    """(replicates, rows): how often each row of the bucket is drawn.

    One replicate at a time, in buffers that stay in the processor's cache."""
    out = np.empty((len(reps), rows))
    most = int(counts.max(initial=0))
    hashed, spare, pick = np.empty(most, np.uint32), np.empty(most, np.uint32), np.empty(most, np.int64)
    with np.errstate(over="ignore"):
        slots = np.arange(most, dtype=np.uint32) * np.uint32(0x85EBCA6B)
        first = np.uint32((start + bucket * 0x632BE5AB) & 0xFFFFFFFF) + reps.astype(np.uint32) * np.uint32(0x9E3779B1)
        for i, n in enumerate(counts):
            x, y, at = hashed[:n], spare[:n], pick[:n]
            np.add(slots[:n], first[i], out=x)
            for shift, factor in ((16, 0x7FEB352D), (15, 0x5BD1E995)):
                np.bitwise_xor(x, np.right_shift(x, np.uint32(shift), out=y), out=x)
                np.multiply(x, np.uint32(factor), out=x)
            np.bitwise_xor(x, np.right_shift(x, np.uint32(16), out=y), out=x)
            np.multiply(x, np.int64(rows), out=at, dtype=np.int64)  # below 2 ** 63: a bucket has far fewer than 2 ** 31 rows
            out[i] = np.bincount(np.right_shift(at, 32, out=at), minlength=rows)
    return out


def replicate_sums(df: DataFrame, *, keys: list[str], unique: list[str], values: list[str], n_boot: int, seed: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(keys, rep, s_<value>, c_<value>): sum and count of every value over the rows that a replicate draws.

    As many rows as the group has are drawn with replacement; replicate -1 is the group itself. ``unique`` names
    a row inside its group; NULL values count as drawn and add nothing.
    """
    group = F.struct(*[F.col(k) for k in keys])
    order = hash_text(seed, *[F.col(u) for u in unique])
    payload = F.array(*[F.col(v).cast("double") for v in values])
    rows = df.select(group.alias("_g"), order.alias("_h"), F.concat_ws("|", *[F.col(u).cast("string") for u in unique]).alias("_u"), payload.alias("_v"))
    sizes = rows.groupBy("_g").agg(n_rows().alias("_n"))
    sizes = sizes.withColumn("_l", F.greatest(F.ceil(F.log2(F.col("_n") / bucket_rows)), F.lit(0)).cast("int"))
    placed = rows.join(sizes, "_g").withColumn("_b", F.expr("shiftright(cast(conv(substring(_h, 1, 8), 16, 10) AS bigint), 32 - _l)"))
    buckets = placed.groupBy("_g", "_n", "_l", "_b").agg(F.array_sort(F.collect_list(F.struct("_h", "_u", "_v"))).alias("_rows"))
    tree = placed.filter("_l > 0").groupBy("_g", "_l", "_b").agg(n_rows().alias("_c")).withColumn("_d", F.explode(F.expr("sequence(0, _l - 1)")))
    tree = tree.withColumns({"_node": F.expr("shiftright(_b, _l - _d)"), "_right": F.expr("shiftright(_b, _l - _d - 1) & 1L = 1L")})
    halves = tree.groupBy("_g", "_d", "_node").agg(F.sum(F.when(~F.col("_right"), F.col("_c")).otherwise(0)).alias("left"), F.sum("_c").alias("total"))
    paths = tree.join(halves, ["_g", "_d", "_node"]).groupBy("_g", "_b").agg(F.array_sort(F.collect_list(F.struct("_d", "left", "total", F.col("_right").alias("right")))).alias("_path"))
    work = buckets.join(paths, ["_g", "_b"], "left").select(
        *[F.col("_g")[k].alias(k) for k in keys], "_n", "_b", "_path", F.flatten(F.transform("_rows", lambda r: r["_v"])).alias("_flat"),
        F.conv(F.substring(hash_text(seed, *[F.col("_g")[k] for k in keys]), 1, 8), 16, 10).cast("bigint").alias("_start"),
        F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1), F.lit(REPLICATES))).alias("_first"),
    )

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                data = np.asarray(row["_flat"], float).reshape(-1, len(values))
                known = ~np.isnan(data)
                both = np.hstack([np.where(known, data, 0.0), known])
                got, names = ([both.sum(axis=0)[None, :]], [-1]) if row["_first"] == 0 else ([], [])
                step = max(1, 1_000_000 // len(data))
                for at in range(row["_first"], min(row["_first"] + REPLICATES, n_boot), step):
                    reps = np.arange(at, min(at + step, row["_first"] + REPLICATES, n_boot))
                    path = [] if row["_path"] is None else list(row["_path"])
                    counts = _drawn_counts(row["_start"], row["_b"], path, row["_n"], reps)
                    got.append(_weights(row["_start"], row["_b"], counts, len(data), reps) @ both)
                    names += reps.tolist()
                stacked = np.concatenate(got)
                yield pd.DataFrame({**{k: [row[k]] * len(names) for k in keys}, "rep": names, "s": list(stacked[:, : len(values)]), "c": list(stacked[:, len(values) :].round().astype(np.int64))})

    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "rep int, s array<double>, c array<bigint>"])
    parts = spread(work).mapInPandas(sums, schema)
    return parts.groupBy(*keys, "rep").agg(*[F.sum(F.col("s")[i]).alias(f"s_{v}") for i, v in enumerate(values)], *[F.sum(F.col("c")[i]).alias(f"c_{v}") for i, v in enumerate(values)])


def _mean(value: str) -> Column:
    return F.when(F.col(f"c_{value}") > 0, F.col(f"s_{value}") / F.col(f"c_{value}"))


def _melt(df: DataFrame, keys: list[str], names: list[str], value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(value)) for m in names])
    return df.select(*keys, F.inline(pairs))


def bootstrap(
    df: DataFrame, *, groups: list[str] = (), strata: list[str] = (), unique: list[str], metrics: list[str],
    ratios: dict[str, tuple[str, str]] | None = None, n_boot: int = 5000, seed: int = 777, level: float = 0.95, count: str | None = None,
) -> DataFrame:
    """(groups, metric, estimate, ci_low, ci_high, n_cubes): rows are independent units.

    ``strata`` resamples inside each stratum and averages strata equally; ``ratios`` adds
    1 - mean(a) / mean(b), without strata. NULL metrics are skipped by the means, not removed from the draw.
    """
    groups, strata, ratios = list(groups), list(strata), dict(ratios or {})
    if strata and ratios:
        raise ValueError("ratios are defined on unstratified draws")
    anchor = groups or ["_one"]
    rows = df if groups else df.withColumn("_one", F.lit(1))
    payload = list(dict.fromkeys([*metrics, *itertools.chain.from_iterable(ratios.values())]))
    counted = count or unique[0]
    drawn = replicate_sums(rows, keys=[*anchor, *strata], unique=unique, values=payload, n_boot=n_boot, seed=seed)
    skill = [(1.0 - safe_ratio(_mean(a), _mean(b))).alias(name) for name, (a, b) in ratios.items()]
    per = drawn.select(*anchor, "rep", *[_mean(m).alias(m) for m in metrics], *skill)
    if strata:
        per = per.groupBy(*anchor, "rep").agg(*[F.avg(m).alias(m) for m in metrics])
    reps = _melt(per, [*anchor, "rep"], [*metrics, *ratios], "v")
    tail = (1.0 - level) / 2.0
    # n_boot values per group and metric: the built-in percentile holds them
    ci = reps.groupBy(*anchor, "metric").agg(
        F.max(F.when(F.col("rep") == -1, F.col("v"))).alias("estimate"),
        F.percentile(F.when(F.col("rep") >= 0, F.col("v")), F.array(F.lit(tail), F.lit(1.0 - tail))).alias("_q"),
    )
    counts = rows.groupBy(*anchor).agg(F.count_distinct(counted).alias("n_cubes"))
    out = ci.select(*anchor, "metric", "estimate", F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"))
    return _join_keys(out, counts, anchor).drop("_one")


def grouped_bootstrap(df: DataFrame, *, group: str, unique: list[str], metrics: list[str], n_boot: int = 5000, seed: int = 777) -> DataFrame:
    """Per group and metric over the rows where that metric is finite."""
    rows = _melt(df, list(dict.fromkeys([group, *unique])), metrics, "value").withColumn("value", null_if_nan(F.col("value"))).filter(F.col("value").isNotNull())
    out = bootstrap(rows.withColumnRenamed("metric", "metric_name"), groups=[group, "metric_name"], unique=unique, metrics=["value"], n_boot=n_boot, seed=seed)
    return out.drop("metric").withColumnRenamed("metric_name", "metric")


# ---- result tables ---------------------------------------------------------------------------------
def cv_summary(cubes: DataFrame, *, n_boot: int = 5000, seed: int = 777) -> DataFrame:
    """Five fold-macro metrics per configuration, fold-stratified intervals."""
    named = cubes.withColumnsRenamed({"nnse": "fold_macro_nnse", "persistence_beaten": "persistence_win_rate"})
    metrics = ["fold_macro_nnse", "mae", "mse_skill", "persistence_win_rate", "bias"]
    out = bootstrap(named, groups=["configuration"], strata=["fold"], unique=["cube_id"], metrics=metrics, n_boot=n_boot, seed=seed)
    folds = cubes.groupBy("configuration").agg(F.count_distinct("fold").alias("n_folds"))
    return out.join(folds, "configuration")


def cv_folds(cubes: DataFrame) -> DataFrame:
    return cubes.groupBy("configuration", "fold").agg(
        F.count_distinct("cube_id").alias("n_cubes"), F.avg("nnse").alias("macro_nnse"), F.avg("mae").alias("macro_mae"),
        F.avg("mse_skill").alias("macro_mse_skill"), F.avg("persistence_beaten").alias("persistence_win_rate"),
    )


def pair_configurations(cubes: DataFrame, metrics: list[str]) -> DataFrame:
    """right - left per (cube, fold) for every ordered pair of configurations.

    A cube has one row per configuration, so the pairing stays inside that short list.
    """
    a = cubes.select("cube_id", "fold", F.col("configuration").alias("left_configuration"), *[F.col(m).alias(f"_l_{m}") for m in metrics])
    b = cubes.select("cube_id", "fold", F.col("configuration").alias("right_configuration"), *[F.col(m).alias(f"_r_{m}") for m in metrics])
    pairs = a.join(b, ["cube_id", "fold"]).filter(F.col("left_configuration") < F.col("right_configuration"))
    return pairs.select("cube_id", "fold", "left_configuration", "right_configuration", *[(F.col(f"_r_{m}") - F.col(f"_l_{m}")).alias(m) for m in metrics])


def _contrast_bootstrap(effects: DataFrame, keys: list[str], metrics: list[str], n_boot: int, seed: int) -> DataFrame:
    rows = _melt(effects, [*keys, "cube_id", "fold"], metrics, "difference").filter(null_if_nan(F.col("difference")).isNotNull())
    out = bootstrap(
        rows.withColumnRenamed("metric", "metric_name"), groups=[*keys, "metric_name"], strata=["fold"], unique=["cube_id"], metrics=["difference"], n_boot=n_boot, seed=seed
    ).drop("metric").withColumnRenamed("metric_name", "metric")
    return out.withColumn("higher_is_better", (F.col("metric") != "mae").cast("int"))


def paired_contrasts(cubes: DataFrame, *, metrics=("nnse", "mse_skill", "mae"), n_boot: int = 5000, seed: int = 777, max_configurations: int = 40) -> DataFrame:
    """Fold-macro mean of right - left with its interval, per ordered pair of configurations and metric.

    Every contrast is resampled by itself: in each fold as many draws as there are cubes with both of its values, from
    those cubes. More than ``max_configurations`` configurations are an error; their names aren't collected otherwise.
    """
    if cubes.select("configuration").distinct().limit(max_configurations + 1).count() > max_configurations:
        raise ValueError(f"more than {max_configurations} configurations")
    effects = pair_configurations(cubes, list(metrics))
    return _contrast_bootstrap(effects, ["left_configuration", "right_configuration"], list(metrics), n_boot, seed)


def factor_effects(
    cubes: DataFrame, metrics: list[str], *, first: str = "architecture", second: str = "optical_input",
    first_levels: tuple[str, str] | None = None, second_levels: tuple[str, str] | None = None,
) -> DataFrame:
    """2 x 2 effects per (cube, fold, metric) where all four cells exist: first, second, interaction.

    Levels default to the sorted pair found in the data; with other than two levels there is no result.
    """
    def levels(col: str, given: tuple[str, str] | None) -> tuple[Column, Column, Column]:
        if given:
            return F.lit(given[0]), F.lit(given[1]), F.lit(2)
        found = cubes.agg(F.min(col).alias("a"), F.max(col).alias("z"), F.count_distinct(col).alias("n"))
        return found.select("a").scalar(), found.select("z").scalar(), found.select("n").scalar()

    a0, a1, na = levels(first, first_levels)
    b0, b1, nb = levels(second, second_levels)
    cells = {"_00": (a0, b0), "_01": (a0, b1), "_10": (a1, b0), "_11": (a1, b1)}
    long = _melt(cubes, ["cube_id", "fold", first, second], metrics, "v")
    wide = long.groupBy("cube_id", "fold", "metric").agg(
        *[F.min(F.when((F.col(first) == a) & (F.col(second) == b), F.col("v"))).alias(name) for name, (a, b) in cells.items()]
    ).dropna(subset=list(cells)).filter((na == 2) & (nb == 2))
    c = {k: F.col(k) for k in cells}
    return wide.select(
        "cube_id", "fold", "metric",
        (0.5 * ((c["_10"] - c["_00"]) + (c["_11"] - c["_01"]))).alias("first_effect"),
        (0.5 * ((c["_01"] - c["_00"]) + (c["_11"] - c["_10"]))).alias("second_effect"),
        ((c["_11"] - c["_10"]) - (c["_01"] - c["_00"])).alias("interaction"),
    )


def factor_contrasts(cubes: DataFrame, *, metrics=("nnse", "mse_skill", "mae"), n_boot: int = 5000, seed: int = 777, **levels) -> DataFrame:
    effects = factor_effects(cubes, list(metrics), **levels).withColumnRenamed("metric", "measure")
    out = _contrast_bootstrap(effects, ["measure"], ["first_effect", "second_effect", "interaction"], n_boot, seed)
    out = out.withColumnsRenamed({"metric": "contrast"}).withColumnRenamed("measure", "metric")
    return out.withColumn("higher_is_better", (F.col("metric") != "mae").cast("int"))


def holdout_overall(cubes: DataFrame, *, n_boot: int = 5000, seed: int = 777) -> DataFrame:
    """Nine metrics; the two NNSE rows only over eligible cubes."""
    named = cubes.withColumnsRenamed({"persistence_beaten": "persistence_win_rate", "r30_direction_match": "r30_direction_accuracy"})
    general = bootstrap(
        named, unique=["cube_id"], metrics=["mae", "mae_base", "mae_gain", "bias", "persistence_win_rate", "r30_direction_accuracy"],
        ratios={"mse_skill_ratio": ("mse", "mse_base")}, n_boot=n_boot, seed=seed,
    )
    eligible = bootstrap(named.filter(F.col("nnse_eligible") == 1), unique=["cube_id"], metrics=["nnse", "nnse_base"], n_boot=n_boot, seed=seed)
    return general.unionByName(eligible)


def holdout_by_step(steps: DataFrame, *, n_boot: int = 5000, seed: int = 777) -> DataFrame:
    """Eight metrics per lead day over the steps with data, with pixel totals."""
    rows = steps.filter(F.col("n_valid") > 0).withColumn("persistence_win_rate", (F.col("mse") < F.col("mse_base")).cast("double"))
    out = bootstrap(
        rows, groups=["lead_day"], unique=["cube_id"],
        metrics=["mae", "mae_base", "bias", "observed_response", "predicted_response", "persistence_win_rate", "spatial_valid_fraction"],
        ratios={"mse_skill_ratio": ("mse", "mse_base")}, n_boot=n_boot, seed=seed,
    )
    return out.join(rows.groupBy("lead_day").agg(F.sum("n_valid").alias("n_valid_pixel_times")), "lead_day")


def environment_summary(
    merged: DataFrame, landcover: DataFrame | None, *, climate: str, metrics=("mae_gain", "mse_skill", "observed_r30"),
    n_boot: int = 5000, seed: int = 777, min_cubes: int = 10,
) -> DataFrame:
    """Climate letter (D and E together) and land-cover groups in one table."""
    letter = F.substring(F.col(climate), 1, 1)
    rows = merged.withColumn("group", F.when(letter.isin("D", "E"), "D/E").otherwise(letter))
    out = grouped_bootstrap(rows, group="group", unique=["cube_id"], metrics=list(metrics), n_boot=n_boot, seed=seed).withColumn("group_type", F.lit("climate"))
    if landcover is not None:
        lc = landcover.withColumn("group", F.col("landcover_group"))
        out = out.unionByName(
            grouped_bootstrap(lc, group="group", unique=["cube_id"], metrics=list(metrics), n_boot=n_boot, seed=seed).withColumn("group_type", F.lit("landcover"))
        )
    return out.withColumn("included_in_main_plot", (F.col("n_cubes") >= min_cubes).cast("int"))


def event_tertiles(df: DataFrame, feature: str, *, out: str | None = None) -> DataFrame:
    """low / middle / high by the tertiles of the average ranks (right-closed); fewer than 3 values: NULL."""
    out = out or f"{feature}_tertile"
    rows = reused(df.withColumn(feature, F.col(feature).cast("double")))  # counted, ranked, labelled
    ranks = rank_table(rows, feature)

    def edge(p: float) -> Column:
        """Linear quantile of the sorted ranks: the ranks at the two positions around p * (n - 1)."""
        position = p * (F.col("n") - 1)
        at = lambda i: F.max(F.when((F.col("lower") <= i) & (i < F.col("lower") + F.col("count")), F.col("avg_rank")))
        low, high = at(F.floor(position)), at(F.ceil(position))
        return low + (high - low) * F.max(position - F.floor(position))

    edges = ranks.agg(F.struct(edge(1 / 3).alias("low"), edge(2 / 3).alias("high"), F.max("n").alias("n")).alias("e")).select("e").scalar()
    rank = F.col("avg_rank")
    label = F.when(rank <= edges["low"], "low").when(rank <= edges["high"], "middle").when(rank.isNotNull(), "high")
    labelled = ranks.select(feature, F.when(edges["n"] >= 3, label).alias(out))
    return _join_keys(rows, labelled, [feature], "left")


def tertile_summary(df: DataFrame, feature: str, *, metrics=("observed_r30", "mae_gain", "mse_skill"), n_boot: int = 5000, seed: int = 777) -> DataFrame:
    from petrichor.operators.meta import join_group_medians

    rows = reused(event_tertiles(df.filter(F.col(feature).isNotNull()), feature, out="group"))
    summary = grouped_bootstrap(rows.filter(F.col("group").isNotNull()), group="group", unique=["cube_id"], metrics=list(metrics), n_boot=n_boot, seed=seed)
    return join_group_medians(summary, rows, group="group", value=feature)


# ---- association -----------------------------------------------------------------------------------
def standardized_beta(df: DataFrame, *, outcome: str, feature: str, controls: list[str] = (), unique: list[str], n_boot: int = 5000, seed: int = 777) -> DataFrame:
    """Standardised OLS coefficient of ``feature`` with a percentile interval over cube resamples.

    Replicates are reduced to second moments by Spark; Python only solves one small system per replicate.
    Constant controls are dropped; too few rows or a constant outcome/feature give NULL.
    """
    columns = [outcome, feature, *controls]
    data = df.select(*unique, *[null_if_nan(F.expr(f"try_cast(`{c}` AS double)")).alias(c) for c in columns]).dropna(subset=columns)
    pairs = list(itertools.combinations(range(len(columns)), 2))
    centre = data.agg(F.struct(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).alias("m")).select("m").scalar()
    centred = data.select(F.lit(1).alias("_one"), *unique, *[(F.col(c) - centre[f"m{i}"]).alias(f"x{i}") for i, c in enumerate(columns)])
    squares = {f"x{i}x{j}": F.col(f"x{i}") * F.col(f"x{j}") for i in range(len(columns)) for j in range(i, len(columns))}
    names = [f"x{i}" for i in range(len(columns))] + list(squares)
    drawn = replicate_sums(centred.withColumns(squares), keys=["_one"], unique=unique, values=names, n_boot=n_boot, seed=seed)
    spread_of = lambda i, j: F.col(f"s_x{i}x{j}") / F.col("c_x0") - F.col(f"s_x{i}") * F.col(f"s_x{j}") / F.col("c_x0") / F.col("c_x0")
    work = drawn.select(
        "rep", F.col("c_x0").alias("n"), F.array(*[F.sqrt(F.greatest(spread_of(i, i), F.lit(0.0))) for i in range(len(columns))]).alias("sd"),
        F.array(*([spread_of(i, j) for i, j in pairs] or [F.lit(0.0)])).alias("cov"),
    )
    alive = data.agg(F.struct(F.array(*[F.stddev_pop(c) > 1e-12 for c in columns]).alias("alive"), n_rows().alias("n")).alias("b")).select("b").scalar()
    work = work.withColumns({"alive": alive["alive"], "n_rows": alive["n"]})

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            betas = []
            for n, sd, cov, keep in zip(pdf["n"], pdf["sd"], pdf["cov"], pdf["alive"]):
                kept = [i for i in range(len(columns)) if i < 2 or keep[i]]
                sd = np.asarray(sd, float)
                beta = None
                if keep[0] and keep[1] and n >= max(10, len(kept) + 3) and (sd[kept] > 0).all():
                    corr = np.eye(len(columns))
                    for (i, j), c in zip(pairs, cov):
                        corr[i, j] = corr[j, i] = c / (sd[i] * sd[j]) if sd[i] > 0 and sd[j] > 0 else 0.0
                    x = kept[1:]
                    # minimum-norm solution, as for rank-deficient designs
                    beta = float(np.linalg.lstsq(corr[np.ix_(x, x)], corr[x, 0], rcond=None)[0][0])
                betas.append(beta)
            yield pd.DataFrame({"rep": pdf["rep"], "n_rows": pdf["n_rows"], "dropped": [[c for c, k in zip(controls, a[2:]) if not k] for a in pdf["alive"]], "beta": pd.array(betas, dtype="Float64")})

    fits = work.mapInPandas(solve, "rep int, n_rows bigint, dropped array<string>, beta double")
    used = F.array_except(F.array(*[F.lit(c) for c in controls]).cast("array<string>"), F.max(F.when(F.col("rep") == -1, F.col("dropped"))))
    quantile = F.percentile(F.when(F.col("rep") >= 0, F.col("beta")), F.array(F.lit(0.025), F.lit(0.975)))
    return fits.agg(
        F.max(F.when(F.col("rep") == -1, F.col("beta"))).alias("standardized_beta"), quantile.alias("_q"),
        F.max("n_rows").alias("n_cubes"), F.concat_ws(";", used).alias("controls"),
    ).select(F.lit(outcome).alias("outcome"), F.lit(feature).alias("feature"), "controls", "standardized_beta", F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"), "n_cubes")


def event_analysis(merged: DataFrame, features: list[str], *, n_boot: int = 5000, seed: int = 777) -> tuple[DataFrame, DataFrame]:
    """(associations, tertile table) for every event feature."""
    data = merged.withColumn("abs_observed_r30", F.abs("observed_r30"))
    controls = ["abs_observed_r30", "target_variance", "spatial_valid_fraction"]
    assoc, tert = None, None
    for f in features:
        rows = data.withColumn(f, F.expr(f"try_cast(`{f}` AS double)")).filter(F.col(f).isNotNull())
        t = tertile_summary(rows, f, n_boot=n_boot, seed=seed).withColumn("feature", F.lit(f)).withColumnRenamed(f"{f}_median", "feature_median")
        a = standardized_beta(rows, outcome="observed_r30", feature=f, unique=["cube_id"], n_boot=n_boot, seed=seed).unionByName(
            standardized_beta(rows, outcome="mae_gain", feature=f, controls=controls, unique=["cube_id"], n_boot=n_boot, seed=seed)
        )
        assoc, tert = (a, t) if assoc is None else (assoc.unionByName(a), tert.unionByName(t))
    return assoc, tert


def stage_guard(cubes: DataFrame, *, stage: str, single_configuration: bool = False) -> DataFrame:
    """Rows pass only if every row has the stage (and, if asked, there is one configuration)."""
    facts = cubes.agg(F.count_if(~F.col("stage").eqNullSafe(stage)).alias("bad"), F.count_distinct("configuration").alias("n"))
    bad, n = facts.select("bad").scalar(), facts.select("n").scalar()
    ok = bad == 0
    if single_configuration:
        ok = ok & (n == 1)
    checked = F.when(ok, F.col("stage")).otherwise(F.raise_error(F.lit(f"only {stage} rows are accepted" + (" of one configuration" if single_configuration else ""))))
    return cubes.withColumn("stage", checked)


def stage_report(cubes: DataFrame, *, stage: str) -> DataFrame:
    """What ``stage_guard`` would say about each configuration's rows: (configuration, n_rows, n_wrong, stages, accepted).
    ``stages`` lists the others that were met; a missing stage is one of them."""
    wrong = ~F.col("stage").eqNullSafe(stage)
    out = cubes.groupBy("configuration").agg(
        n_rows().alias("n_rows"), F.count_if(wrong).alias("n_wrong"), F.array_join(F.array_sort(F.collect_set(F.when(wrong, F.coalesce("stage", F.lit("<missing>"))))), ";").alias("stages")
    )
    return out.withColumn("accepted", flag(F.col("n_wrong") == 0))
