"""Merkle manifest of a dataset by nested-struct rollup.

Leaves of a group get a rank. The rank's digits to the base ``fan`` are columns: the lowest ``DEPTH`` digits are the
place inside a block of ``fan ** DEPTH`` leaves, what is left is the number of the block. Inside a block the digit
columns are grouped away one after another; each time the children become an array of structs inside their parent,
and the parent's digest is computed from theirs. The rows are partitioned by block once, so all four groupings share
one shuffle. The digests of the blocks are the leaves of the next round, until every group is one node.

A proof needs nothing but the nested block: one transform per level turns each child into (child, siblings to its
left, siblings to its right), explode makes rows of them. Only between two rounds is there a join, of one row per
block with the path above it; leaves are never joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from petrichor.llm.common import small_or_not, written
from petrichor.operators.order_stats import ranked_in_order

#: Digits grouped away per round: a block holds fan ** DEPTH leaves, 4096 with the default fan of 8.
DEPTH = 4
PATH = "array<struct<l:string,r:string>>"
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def field(value: Column) -> Column:
    """``-`` for NULL, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _levels(n: Column, fan: int) -> Column:
    """How many of a round's levels a group of n nodes takes: none for one node, DEPTH for more than a block."""
    out = F.lit(0)
    for k in range(DEPTH):
        out = F.when(n > fan**k, F.lit(k + 1)).otherwise(out)
    return out


def _rollup(nodes: DataFrame, fan: int) -> DataFrame:
    """Nodes (g, rank, n, digest, body) as blocks (g, block, n, levels, digest, kids): kids nests the digits."""
    digits = {f"d{k}": F.floor(F.col("rank") / F.lit(fan**k)).cast("long") % fan for k in range(DEPTH)}
    rows = nodes.withColumns(digits | {"block": F.floor(F.col("rank") / F.lit(fan**DEPTH)).cast("long"), "levels": _levels(F.col("n"), fan)})
    rows = rows.select("g", "block", "n", "levels", *digits, F.struct("d0", "digest", "body").alias("node")).repartition("g", "block")
    for k in range(DEPTH):
        keys = ["g", "block", "n", "levels", *[f"d{j}" for j in range(k + 1, DEPTH)]]
        rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("node")).alias("kids"))
        own = F.when(F.col("levels") > k, F.sha2(F.array_join(F.transform("kids", lambda c: c["digest"]), ""), 256)).otherwise(F.col("kids")[0]["digest"])
        rows = rows.withColumn("digest", own)
        if k + 1 < DEPTH:
            rows = rows.withColumn("node", F.struct(f"d{k + 1}", "digest", "kids"))
    return rows


def _unroll(blocks: DataFrame, fan: int) -> DataFrame:
    """Blocks with ``above``, their own path, as (g, body, leaf, path): path goes from the leaf to the root."""

    def opened(kids: Column) -> Column:
        digests = F.transform(kids, lambda c: c["digest"])
        return F.transform(
            kids,
            lambda c, i: F.struct(c.alias("node"), F.array_join(F.slice(digests, 1, i), "").alias("l"), F.array_join(F.slice(digests, i + 2, fan), "").alias("r")),
        )

    rest = [c for c in blocks.columns if c not in ("kids", "digest", "n")]
    rows = blocks.select(*rest, F.col("above").alias("path"), "kids")
    for k in reversed(range(DEPTH)):
        rows = rows.withColumn("kid", F.explode(opened(F.col("kids"))))
        step = F.when(F.col("levels") > k, F.array(F.struct("kid.l", "kid.r"))).otherwise(F.array().cast(PATH))
        rows = rows.withColumn("path", F.concat(step, "path"))
        rows = rows.withColumn("kids", F.col("kid.node.kids")) if k else rows
    return rows.select(*[c for c in rest if c not in ("above", "levels", "block")], F.col("kid.node.digest").alias("leaf"), F.col("kid.node.body").alias("body"), "path")


def rolled_up(nodes: DataFrame, name: str, *, fan: int = 8) -> tuple[DataFrame, list[DataFrame]]:
    """(tops, rounds): the top digest (g, top) of every group, and the blocks of every round, lowest first.

    A round's blocks are written once and read both on the way up and on the way down.
    """
    rounds = [written(_rollup(nodes, fan), f"{name}-blocks")]
    while rounds[-1].filter("block > 0").limit(1).count():
        blocks = rounds[-1]
        size = F.ceil(F.col("n") / F.lit(fan**DEPTH)).cast("long")
        above_nodes = blocks.select("g", F.col("block").alias("rank"), size.alias("n"), "digest", F.struct("block").alias("body"))
        rounds.append(written(_rollup(above_nodes, fan), f"{name}-blocks"))
    tops = rounds[-1].select("g", F.col("digest").alias("top"))
    return tops, rounds


def proofs(rounds: list[DataFrame], over: DataFrame, *, fan: int = 8) -> DataFrame:
    """(g, leaf, body, path) of the nodes that the first round took; ``over`` (g, over) is the path above a group."""
    top = rounds[-1]
    rows = _unroll(top.join(small_or_not(over, over.count()), "g").withColumnRenamed("over", "above"), fan)
    for blocks in reversed(rounds[:-1]):
        way = rows.select("g", F.col("body.block").alias("block"), F.col("path").alias("above"))
        rows = _unroll(blocks.join(way, ["g", "block"]), fan)
    return rows


def manifest(
    df: DataFrame, *, fields: list[str] | None = None, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", fan: int = 8, tampered: Column | None = None,
) -> DataFrame:
    """(doc_id, group, rank, leaf, subroot, root, proof, proof_sha256, folded_root, verified) per row.

    A leaf is the SHA-256 of ``fields``, each ``-`` if NULL, else byte count, ``:`` and value. Per group (NULL is a
    group, the first one) the leaves ascend by id, then by leaf; runs of ``fan`` become their digest until one node
    is left, the subroot. Subroots in the order of their groups give the root the same way. ``proof`` lists the
    siblings left and right of the path, level by level. ``tampered`` marks rows whose text is lower-cased (A-Z)
    before it is verified; a NULL mark is none. Repeated rows are leaves of their own; NULL ids come first; a group with one row
    is its own subroot and one group's subroot the root. An empty table gives no rows. Columns that aren't
    in ``fields`` don't count, whatever their names.
    """
    fields = fields or LEAF
    value = lambda c: F.col(f"`{c}`")
    leaf = digest(*[field(value(c)) for c in fields])
    other = digest(*[field(ascii_lower(value(c)) if c == text_col else value(c)) for c in fields])
    mark = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    rows = df.select(value(group_col).alias("group"), value(id_col).alias("id"), leaf.alias("digest"), F.when(mark, other).alias("other"))

    groups = written(rows.groupBy("group").agg(F.count(F.lit(1)).alias("members")), "merkle-groups")
    numbered = ranked_in_order(groups, [], ["group"], size="n").select("group", F.col("rank").alias("g"), F.col("n").alias("n_groups"))
    numbered = written(numbered, "merkle-group-numbers")
    n_groups = numbered.count()
    names = numbered.select("g", F.col("group").alias("named"))
    rows = rows.join(small_or_not(names, n_groups), F.col("group").eqNullSafe(F.col("named"))).drop("named")

    leaves = ranked_in_order(rows, ["g"], ["id", "digest"], size="n")
    body = F.struct("id", "group", "rank", "other").alias("body")
    tops, rounds = rolled_up(leaves.select("g", "rank", "n", "digest", body), "merkle", fan=fan)
    tops = written(tops, "merkle-subroots")
    above = tops.join(numbered, "g").select(F.lit(0).alias("g"), F.col("g").alias("rank"), F.col("n_groups").alias("n"), F.col("top").alias("digest"), F.struct("g").alias("body"))
    roots, upper = rolled_up(above, "merkle-root", fan=fan)
    over = proofs(upper, roots.select("g", F.array().cast(PATH).alias("over")), fan=fan)
    root = roots.select("top").first()
    over = written(over.select(F.col("body.g").alias("g"), F.col("leaf").alias("subroot"), F.col("path").alias("over")), "merkle-over")

    found = proofs(rounds, over.drop("subroot"), fan=fan)
    found = found.join(small_or_not(over.select("g", "subroot"), n_groups), "g")
    start = F.coalesce("body.other", "leaf")
    found = found.withColumn("folded_root", F.aggregate("path", start, lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]), 256)))
    top = F.lit(root.top if root else None).cast("string")
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    return found.select(
        F.col("body.id").alias("doc_id"), F.col("body.group").alias("group"), F.col("body.rank").alias("rank"), "leaf", "subroot", top.alias("root"), F.col("path").alias("proof"),
        F.sha2(proof, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == top).alias("verified"),
    )
