"""Event-anchored 5-day grid: resampling, calendars, trimming, gap-limited interpolation, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from petrichor.functions.scalar import BIN_DAYS, bin_end, flag
from petrichor.operators.order_stats import _join_keys, sorted_percentiles


# ---- resampling ------------------------------------------------------------------------------------
def resample_median(
    df: DataFrame,
    *,
    cube: list[str],
    pixel: list[str],
    time: str,
    values: list[str],
    origin: Column,
    mask: str | None = None,
    days: int = BIN_DAYS,
) -> DataFrame:
    """Median per pixel and right-labelled bin of the values whose mask is 1; ``n`` counts all rows.

    Only bins with observations appear; ``densify`` adds the empty ones.
    """
    cols = {v: (F.when(F.col(mask) == 1, F.col(v)) if mask else F.col(v)) for v in values}
    rows = df.select(
        *cube, *pixel, bin_end(F.col(time), origin, days).alias("bin"), *[c.cast("double").alias(v) for v, c in cols.items()]
    )
    # a pixel's bin holds a handful of acquisitions: one shuffle, no search for hot groups
    out = sorted_percentiles(rows, [*cube, *pixel, "bin"], values, [0.5], [F.count(F.lit(1)).alias("n")])
    return out.withColumnsRenamed({f"{v}_p0": v for v in values})


def bin_span(df: DataFrame, *, cube: list[str], time: str, origin: Column, days: int = BIN_DAYS) -> DataFrame:
    """First and last bin per cube from the raw observations: (cube, first_bin, last_bin)."""
    span = df.groupBy(*cube).agg(F.min(time).alias("_a"), F.max(time).alias("_z"))
    return span.select(*cube, bin_end(F.col("_a"), origin, days).alias("first_bin"), bin_end(F.col("_z"), origin, days).alias("last_bin"))


def calendar(df: DataFrame, cube: list[str], bin_col: str = "bin", days: int = BIN_DAYS) -> DataFrame:
    """Every bin between a cube's first and last one: (cube, bin)."""
    span = df.groupBy(*cube).agg(F.min(bin_col).alias("_a"), F.max(bin_col).alias("_z"))
    return span.select(*cube, F.explode(F.sequence("_a", "_z", F.make_dt_interval(days=F.lit(days)))).alias(bin_col))


def densify(
    df: DataFrame, *, cube: list[str], pixel: list[str], bin_col: str = "bin", days: int = BIN_DAYS, span: DataFrame | None = None
) -> DataFrame:
    """Add NULL rows so that every pixel has every bin of its cube.

    Each row emits the empty bins up to the pixel's next row, the first row also those before it: one shuffle
    per pixel, no join with a calendar, and the result stays partitioned by pixel for the window operators
    that follow. ``span`` (``bin_span`` of the raw observations, one row per cube) spares a second evaluation
    of ``df``.
    """
    if span is None:
        span = df.groupBy(*cube).agg(F.min(bin_col).alias("first_bin"), F.max(bin_col).alias("last_bin"))
    order = Window.partitionBy(*cube, *pixel).orderBy(bin_col)
    step = F.make_dt_interval(days=F.lit(days))
    rows = _join_keys(df, span, cube).withColumns({"_next": F.lead(bin_col).over(order), "_prev": F.lag(bin_col).over(order)})
    start = F.when(F.col("_prev").isNull(), F.col("first_bin")).otherwise(F.col(bin_col))
    stop = F.coalesce(F.date_sub("_next", days), F.col("last_bin"))
    rows = rows.withColumn("_bin", F.explode(F.sequence(start, stop, step)))
    values = [c for c in df.columns if c not in (*cube, *pixel, bin_col)]
    return rows.select(
        *cube, *pixel, F.col("_bin").alias(bin_col), *[F.when(F.col("_bin") == F.col(bin_col), F.col(v)).alias(v) for v in values]
    )


def align_exact(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Right series onto the left bins: exact time only, right-only bins drop, left-only bins get NULL."""
    return left.join(right, keys, "left")


def merge_static(df: DataFrame, static: DataFrame, pixel: list[str]) -> DataFrame:
    """Static layers once per pixel."""
    return df.join(static, pixel, "left")


# ---- trimming and windows --------------------------------------------------------------------------
def trim_to_first_valid(df: DataFrame, *, cube: list[str], time: str, mask: str) -> DataFrame:
    """Drop the leading steps of a cube before its first step with a valid pixel; none valid: unchanged."""
    first = df.groupBy(*cube).agg(F.min(F.when(F.col(mask) == 1, F.col(time))).alias("_first"))
    return _join_keys(df, first, cube).filter(F.col("_first").isNull() | (F.col(time) >= F.col("_first"))).drop("_first")


def context_target_steps(
    df: DataFrame, *, cube: list[str], time: str, event_end: Column, n_context: int, n_target: int
) -> DataFrame:
    """(cube, time, part, step): the last ``n_context`` steps up to the event, the first after it.

    Ranks run over a cube's distinct steps (a short calendar), not over its pixels. ``step`` counts 1..
    in time order inside each part.
    """
    steps = df.select(*cube, time, event_end.alias("_end")).distinct()
    is_context = F.col(time) <= F.col("_end")
    back = Window.partitionBy(*cube, "_ctx").orderBy(F.col(time).desc())
    ahead = Window.partitionBy(*cube, "_ctx").orderBy(F.col(time).asc())
    ranked = steps.withColumn("_ctx", is_context).withColumns(
        {"_back": F.row_number().over(back), "_ahead": F.row_number().over(ahead)}
    )
    kept = ranked.filter(
        F.when(F.col("_ctx"), F.col("_back") <= n_context).otherwise(F.col("_ahead") <= n_target)
    )
    part = F.when(F.col("_ctx"), "context").otherwise("target")
    n_ctx = F.min("_ahead").over(Window.partitionBy(*cube, "_ctx"))
    return kept.select(*cube, time, part.alias("part"), (F.col("_ahead") - n_ctx + 1).alias("step"))


def select_windows(df: DataFrame, *, cube: list[str], time: str, event_end: Column, n_context: int, n_target: int) -> DataFrame:
    """Rows of the context and target windows with their ``part`` and ``step``."""
    steps = context_target_steps(df, cube=cube, time=time, event_end=event_end, n_context=n_context, n_target=n_target)
    return df.join(steps, [*cube, time])


def window_check(df: DataFrame, *, cube: list[str], time: str, event_end: Column, n_context: int, n_target: int, days: int = BIN_DAYS) -> DataFrame:
    """Per cube: event end present, exact lengths, context ends at it, target starts one step later."""
    steps = context_target_steps(df, cube=cube, time=time, event_end=event_end, n_context=n_context, n_target=n_target)
    ends = df.select(*cube, event_end.alias("event_end")).distinct()
    ctx, tgt = F.col("part") == "context", F.col("part") == "target"
    agg = steps.groupBy(*cube).agg(
        F.count_if(ctx).alias("n_context"),
        F.count_if(tgt).alias("n_target"),
        F.max(F.when(ctx, F.col(time))).alias("context_end"),
        F.min(F.when(tgt, F.col(time))).alias("target_start"),
    )
    return ends.join(agg, cube, "left").select(
        *cube, "n_context", "n_target", "context_end", "target_start",
        flag((F.col("context_end") == F.col("event_end"))).alias("ends_at_event"),
        flag((F.col("n_context") == n_context) & (F.col("n_target") == n_target)).alias("full_length"),
        flag(F.datediff("target_start", "event_end") == days).alias("target_follows"),
    )


def fixed_windows(df: DataFrame, *, cube: list[str], time: str, n_context: int, n_target: int) -> DataFrame:
    """Variant without an event: the first steps of a cube are context, the next ones target."""
    steps = df.select(*cube, time).distinct()
    order = F.row_number().over(Window.partitionBy(*cube).orderBy(time))
    steps = steps.withColumn("_o", order).filter(F.col("_o") <= n_context + n_target)
    in_ctx = F.col("_o") <= n_context
    steps = steps.select(
        *cube, time, F.when(in_ctx, "context").otherwise("target").alias("part"),
        F.when(in_ctx, F.col("_o")).otherwise(F.col("_o") - n_context).alias("step"),
    )
    return df.join(steps, [*cube, time])


# ---- interpolation ---------------------------------------------------------------------------------
def interpolate_context(
    df: DataFrame,
    *,
    pixel: list[str],
    time: str,
    values: list[str],
    event_end: Column,
    max_gap_days: int = 30,
    days: int = BIN_DAYS,
    suffix: str = "",
) -> DataFrame:
    """Linear in time, only inside the context, only between two observations.

    The first ``max_gap_days // days`` NULLs of every gap are filled, later ones stay NULL. Series are
    dense and bounded by the calendar, so one pixel in one task is small; all values share one window
    per direction. ``suffix`` keeps the originals and names the filled columns.
    """
    limit = max_gap_days // days
    ctx = F.col(time) <= event_end
    tagged = df.withColumn("_ctx", ctx)
    order = Window.partitionBy(*pixel, "_ctx").orderBy(time)
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    tagged = tagged.withColumn("_row", F.row_number().over(order))
    point = {v: F.when(F.col(v).isNotNull(), F.struct(F.col(v).cast("double").alias("v"), F.col(time).alias("t"), F.col("_row").alias("r"))) for v in values}
    tagged = tagged.withColumns(
        {
            **{f"_prev_{v}": F.last(point[v], ignorenulls=True).over(back) for v in values},
            **{f"_next_{v}": F.first(point[v], ignorenulls=True).over(ahead) for v in values},
        }
    )
    filled = {}
    for v in values:
        prev, nxt = F.col(f"_prev_{v}"), F.col(f"_next_{v}")
        share = F.datediff(F.col(time), prev["t"]) / F.datediff(nxt["t"], prev["t"])
        inside = F.col("_ctx") & prev.isNotNull() & nxt.isNotNull() & (F.col("_row") - prev["r"] <= limit)
        filled[v + suffix] = F.when(F.col(v).isNotNull(), F.col(v).cast("double")).when(inside, prev["v"] + (nxt["v"] - prev["v"]) * share)
    drop = ["_ctx", "_row", *[f"_prev_{v}" for v in values], *[f"_next_{v}" for v in values]]
    return tagged.withColumns(filled).drop(*drop)




def head_tail(df: DataFrame, *, cube: list[str], time: str, n: int, tail: bool = False) -> DataFrame:
    """First or last ``n`` distinct steps of every cube."""
    order = F.col(time).desc() if tail else F.col(time).asc()
    steps = df.select(*cube, time).distinct()
    ranked = steps.withColumn("_o", F.row_number().over(Window.partitionBy(*cube).orderBy(order)))
    return df.join(ranked.filter(F.col("_o") <= n).drop("_o"), [*cube, time], "left_semi")
