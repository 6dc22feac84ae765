"""Column helpers shared by all operators. Missing values are SQL NULL everywhere (never NaN)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

BIN_DAYS = 5


def null_if_nan(c: Column) -> Column:
    """NaN and infinities become NULL: comparisons and aggregates then skip them."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Source-side normaliser: every float/double column loses its NaN/inf values."""
    floats = {name for name, kind in df.dtypes if kind in ("float", "double")}
    return df.select(*[null_if_nan(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def clip(c: Column, low, high) -> Column:
    """Clip that keeps NULL (greatest/least alone would replace it by the bound)."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(c.isNotNull(), F.greatest(low, F.least(high, c)))


def safe_ratio(num: Column, den: Column, eps: float = 1e-12) -> Column:
    return F.when(F.abs(den) > eps, num / den)


def direction(c: Column, threshold: float) -> Column:
    """-1 / 0 / 1 around a dead band, NULL for NULL."""
    return F.when(c > threshold, 1.0).when(c < -threshold, -1.0).when(c.isNotNull(), 0.0)


def flag(condition: Column) -> Column:
    """Condition to 0/1, unknown counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def n_rows() -> Column:
    return F.count(F.lit(1))


def count_true(condition: Column) -> Column:
    return F.count_if(condition)


def bin_end(t: Column, origin: Column, days: int = BIN_DAYS) -> Column:
    """Right label of the left-closed ``days`` bin anchored on ``origin`` (a date).

    Whole days are enough because the origin is a midnight: floor(floor(d) / n) = floor(d / n).
    """
    index = F.floor(F.datediff(F.to_date(t), origin) / F.lit(float(days)))
    return F.date_add(origin, ((index + 1) * days).cast("int"))


def as_text(part) -> Column:
    return (part if isinstance(part, Column) else F.lit(part)).cast("string")


def hash_text(*parts) -> Column:
    """md5 of the '|'-joined parts: a pure function of its inputs, so a lost task redoes the same draw."""
    return F.md5(F.concat_ws("|", *[as_text(p) for p in parts]))


def hash_part(digest: Column, part: Column | int) -> Column:
    """32-bit number from the part-th (0-3) group of 8 hex digits of a digest."""
    start = (part * 8 + 1) if isinstance(part, int) else part * 8 + 1
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")


def draw(n: Column, *parts) -> Column:
    """Uniform integer in [0, n) derived from the parts."""
    return hash_part(hash_text(*parts), 0) % n


def rows_signature(*parts) -> Column:
    """Aggregate: order-free fingerprint of a multiset of rows. The two halves of every row's md5 are summed, so
    repeated rows count, and the number of rows is part of it."""
    known = [F.coalesce(as_text(p), F.lit("<null>")) for p in parts]
    half = lambda start: F.sum(F.conv(F.substring(hash_text(*known), start, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return F.concat_ws(":", half(1), half(16), n_rows().cast("string"))


def fold_all(conditions: list[Column], how: str = "and") -> Column:
    return reduce((lambda a, b: a & b) if how == "and" else (lambda a, b: a | b), conditions)


def reasons(pairs: list[tuple[Column, str]]) -> Column:
    """';'-joined texts of the rules that fired, '' when none did."""
    return F.concat_ws(";", *[F.when(cond, text) for cond, text in pairs])


def first_reason(pairs: list[tuple[Column, Column | str]], default: str) -> Column:
    """Text of the first rule that fired."""
    out = None
    for cond, text in pairs:
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out.otherwise(F.lit(default))
