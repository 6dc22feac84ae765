"""Exact duplicates with two Bloom passes: only rows whose hash may repeat are shuffled.

Pass one gives every row one slot of a filter with two bits a slot, "seen" and "seen again". Each task fills its own
filter and hands it over by blocks of slots, as the sorted places of the set bits, compressed; blocks are merged with
a saturating OR: seen by two tasks is seen again. What moves is a few rows per task that hold some three bytes a
document, no document rows. Pass two tests every row against a Bloom filter of the slots seen again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from petrichor.llm.common import col, fresh, join_groups, written

#: Slots of the first filter per row: a single row shares its slot with another one in one of 64 cases.
SLOTS_PER_ROW = 64
#: Bits of the second filter per slot seen again, and its probes: it lets 2 % of the single rows through.
BITS, PROBES = 10, 3
#: The second filter is broadcast up to this size. Beyond it, all rows are shuffled as (id, digest).
FILTER_BYTES = 32 << 20
#: Hashes that a task gathers before it hands over its filter.
FLUSH = 1 << 22

BLOCK = "block int, again boolean, n bigint, places binary"
SCHEMA = pa.schema([("block", pa.int32()), ("again", pa.bool_()), ("n", pa.int64()), ("places", pa.binary())])


def _packed(places: np.ndarray) -> bytes:
    return pa.compress(np.diff(places, prepend=np.uint64(0)).astype("<u8").view("u1").reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), "u1")
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").ravel())


def _blocks(slots: np.ndarray, again: bool, shift: int) -> Iterator[dict]:
    """Sorted distinct slots as one row per block."""
    numbers = (slots >> np.uint64(shift)).astype(np.int64)
    edges = np.flatnonzero(np.diff(numbers, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(slots)]):
        yield {"block": int(numbers[a]), "again": again, "n": int(b - a), "places": _packed(slots[a:b])}


def repeated_slots(hashes: DataFrame, h: str, *, rows: int) -> tuple[DataFrame, int]:
    """(table of blocks with the slots seen more than once, bits of a slot number) for a column of 64-bit hashes.

    The filter's size follows from the number of rows. A slot is the hash's first bits, so equal hashes meet.
    """
    bits = max(16, int(SLOTS_PER_ROW * max(rows, 1) - 1).bit_length())
    block_bits = min(14, max(3, (rows >> 16).bit_length()))
    shift = bits - block_bits

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            slots, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pylist([*_blocks(slots, False, shift), *_blocks(slots[times > 1], True, shift)], schema=SCHEMA)

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) >> np.uint64(64 - bits))
            n += len(held[-1])
            if n >= FLUSH:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            slots, times = np.unique(np.concatenate([p for p, _ in own]), return_counts=True)
            twice = np.unique(np.concatenate([slots[times > 1], *[p for p, again in own if again]]))
            return pa.RecordBatch.from_pylist([{"block": now, "again": True, "n": len(twice), "places": _packed(twice)}] if len(twice) else [], schema=SCHEMA)

        now, own = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if now is not None and row["block"] != now:
                    yield out()
                    own = []
                now = row["block"]
                own.append((_unpacked(row["places"], row["n"]), row["again"]))
        if own:
            yield out()

    filters = hashes.select(h).mapInArrow(fill, BLOCK)
    merged = filters.repartition("block").sortWithinPartitions("block").mapInArrow(merge, BLOCK)
    return written(merged, "slots-seen-again"), bits


def _probes(slots: np.ndarray, size: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        x = slots * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        step = (x * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
        return [(x + step * np.uint64(j)) >> np.uint64(64 - size) for j in range(PROBES)]


def bloom_filter(blocks: DataFrame, *, filter_bytes: int = FILTER_BYTES) -> tuple[np.ndarray, int] | None:
    """(64-bit words, bits of a place) of the second filter, sized from the counted slots; None if it is too large."""
    n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    size = max(10, int(BITS * max(n, 1) - 1).bit_length())
    if (1 << size) > 8 * filter_bytes:
        return None

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                slots = _unpacked(row["places"], row["n"])
                places = np.unique(np.concatenate(_probes(slots, size)))
                at, first = np.unique(places >> np.uint64(6), return_index=True)
                masks = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(masks.view(np.int64))], names=["word", "bits"])

    table = blocks.mapInArrow(words, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.uint64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return out, size


def exact_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Every row with keep_id, group_size, kept and text_sha256; columns of these names are replaced.

    Texts are equal when identical; a NULL text counts as empty. Of equal texts the row with the largest id stays.
    Rows that agree in text and id are one document: all of them carry the same decision. A NULL id loses
    against any other; in a group of NULL ids all rows stay. An empty table gives an empty result.

    Rows that fail a probe of the second filter are certainly single: they go straight through. The others shuffle
    as (id, sha256) and are grouped by the digest, so a false positive costs a row of shuffle and never a wrong
    group. Their groups come back by a join in which digests of very many rows are broadcast. If the second
    filter would exceed ``filter_bytes``, all rows are grouped that way; the result is the same.
    """
    outs = ["keep_id", "group_size", "kept", "text_sha256"]
    df = df.drop(*[c for c in df.columns if c.lower() in outs])
    text = F.coalesce(col(df, text_col), F.lit(""))
    hashes = df.select(F.xxhash64(text).alias("h"))
    slots, bits = repeated_slots(hashes, "h", rows=df.count())
    bloom = bloom_filter(slots, filter_bytes=filter_bytes)
    rows = df.withColumn("text_sha256", F.sha2(text, 256))
    names = [c for c in df.columns] + outs
    pick = lambda t: t.select(*[F.col(f"`{c}`") for c in names])
    single, shared = None, rows
    if bloom is not None:
        held, size = df.sparkSession.sparkContext.broadcast(bloom[0]), bloom[1]

        @pandas_udf("boolean")
        def may_repeat(h: pd.Series) -> pd.Series:
            found = np.ones(len(h), bool)
            for p in _probes(h.to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - bits), size):
                found &= (held.value[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
            return pd.Series(found)

        h, maybe = fresh(rows, "h", "maybe")
        flagged = rows.withColumn(h, F.xxhash64(text)).withColumn(maybe, may_repeat(F.col(h))).drop(h)
        single = flagged.filter(~F.col(maybe)).withColumns({"keep_id": F.col(f"`{id_col}`"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
        shared = flagged.filter(F.col(maybe)).drop(maybe)
    groups = written(shared.groupBy("text_sha256").agg(F.max(f"`{id_col}`").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "equal-texts")
    grouped = join_groups(shared, groups, "text_sha256", "group_size").withColumn("kept", F.col(f"`{id_col}`").eqNullSafe(F.col("keep_id")))
    return pick(single).unionByName(pick(grouped)) if single is not None else pick(grouped)
