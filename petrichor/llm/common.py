"""What the operators of this folder share: the shared folder, written tables, free column names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from petrichor.session import shared_folder, stored as written  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
#: One word: a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def small_or_not(df: DataFrame, rows: int, limit: int = 500_000) -> DataFrame:
    """Broadcast hint for a table whose counted rows are few; any larger one is joined by a shuffle."""
    return F.broadcast(df) if rows <= limit else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, *, hot_share: int = 10_000) -> DataFrame:
    """rows with the columns of their group; ``groups`` has one row per non-NULL key, ``size`` counts its rows.

    A key with more than one in ``hot_share`` of all rows would be one task's work in a shuffle. There are at most
    ``hot_share`` such keys, so they are broadcast; the rows of all other keys are shuffled. A row without a group
    gets NULLs. Both tables are read twice and should be written ones.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = F.col(size) * hot_share > total
    (mark,) = fresh(rows.join(groups.limit(0), key, "left"), "hot")
    keys = F.broadcast(groups.filter(hot).withColumn(mark, F.lit(True)))
    first = rows.join(keys, key, "left")
    done = first.filter(F.col(mark)).drop(mark)
    rest = first.filter(F.col(mark).isNull()).select(*[F.col(f"`{c}`") for c in rows.columns]).join(groups.filter(~hot), key, "left")
    return done.unionByName(rest)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that the table doesn't have in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name, n = f"_{stem}", 0
        while name.lower() in taken:
            n += 1
            name = f"_{stem}{n}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots included."""
    return df[f"`{name}`"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
