"""SimHash near-duplicates: an inverted index of positional bytes with count filtering.

A fingerprint of 64 bits is eight bytes at eight positions. Two fingerprints with at most ``radius`` differing bits
differ in at most ``radius`` bytes, so they share at least ``8 - radius`` positional bytes: the guaranteed minimum.
An entry of the index is a combination of so many positions with the bytes found there. A pair that shares s bytes
meets in C(s, 8 - radius) entries, so tallying the entries of a pair tells how many bytes it shares; pairs below
the minimum meet nowhere and never become rows (single bytes as entries would give lists of N / 256 members each).

Only distinct fingerprints are indexed. An entry of at most ``PAIRS`` members gives its pairs, which are tallied and
verified bit by bit. An entry of more members (copies that were each edited a little) gives no pairs: every member
names itself and the values one bit away in its remaining bytes, and members that name the same value are hung on
the smallest of them. Two members two bits apart always have such a value in common, and any two that share one are
at most two bits apart, so both ways give the same components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from petrichor.llm.common import join_groups, written
from petrichor.llm.minhash import components
from petrichor.llm.shingles import slices, small_batches

#: Entries with more members than this are not turned into pairs.
PAIRS = 32
#: Shingle hashes whose bits are counted at once.
CHUNK = 100_000


def _shingle_hashes(text: str, words: int, seed: int) -> np.ndarray:
    w = text.encode().lower().split()  # bytes: only A-Z change, words end at ASCII white space
    k = min(words, len(w))
    if k == 0:
        return np.zeros(0, np.uint64)
    runs = (b" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    return np.fromiter((xxhash.xxh64_intdigest(r, seed) for r in runs), np.uint64, len(w) - k + 1)


def fingerprint(text: str | None, *, words: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the hashes of all ``words``-word shingles, repeats included."""
    hashes = _shingle_hashes(text or "", words, seed)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, *, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, print) of a table (doc_id, text); print is the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = np.array([fingerprint(t, words=words, seed=seed) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.view(np.int64))], schema=schema)

    return df.mapInArrow(sign, "doc_id bigint, print bigint")


def _masks(radius: int) -> list[tuple[int, int]]:
    """(number, mask of the kept bytes as a signed long) of every combination of 8 - radius positions."""
    out = []
    for n, kept in enumerate(combinations(range(8), 8 - radius)):
        mask = sum(0xFF << (8 * p) for p in kept)
        out.append((n, mask - (1 << 64) if mask >> 63 else mask))
    return out


def links(prints: DataFrame, *, radius: int = 2) -> DataFrame:
    """(a, b, bits) over a table (print, rep) of distinct fingerprints: pairs of reps whose fingerprints differ in at
    most ``radius`` bits, enough of them to connect all that are connected.

    Rows become 28 entries and up to 17 centres each, but Spark takes an exploded table for no larger than the one
    before: it would broadcast it by way of the driver, and explode all of it in the few tasks that read the fingerprints.
    So the joins of entries are merge joins by name, and the fingerprints are dealt out first.
    """
    if radius != 2:
        raise ValueError("a crowded entry names the values one bit away, which is exact for radius 2 only")
    masks = _masks(radius)
    least = 8 - radius
    entry = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col("print").bitwiseAND(F.lit(m)).alias("bytes")) for n, m in masks])).alias("entry")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = prints.repartition(parts, "print").select("print", "rep", entry).select("print", "rep", "entry.n", "entry.bytes")
    lists = postings.groupBy("n", "bytes").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    lists = written(postings.join(lists.hint("merge"), ["n", "bytes"]), "byte-postings")

    few = lists.filter(F.col("m") <= PAIRS)
    x, y = (few.select("n", "bytes", F.col("print").alias(f"{s}_print"), F.col("rep").alias(f"{s}_rep")) for s in "xy")
    met = x.join(y.hint("merge"), ["n", "bytes"]).filter("x_rep > y_rep")
    tally = met.groupBy("x_rep", "y_rep", "x_print", "y_print").agg(F.count(F.lit(1)).alias("entries"))
    # s shared bytes meet in C(s, least) entries; entries with many members are left out, so this is a lower bound
    shared = F.lit(0)
    for s in range(least, 9):
        shared = F.when(F.col("entries") >= comb(s, least), F.lit(s)).otherwise(shared)
    differing = F.bit_count(F.col("x_print").bitwiseXOR(F.col("y_print")))
    pairs = tally.withColumn("shared", shared).filter(F.col("shared") >= least).filter(differing <= radius)
    pairs = pairs.select(F.col("x_rep").alias("a"), F.col("y_rep").alias("b"), differing.alias("bits"))

    many = lists.filter(F.col("m") > PAIRS)
    free = F.element_at(F.array(*[F.lit(_free_bits(radius, n)) for n, _ in masks]), F.col("n") + 1)
    centres = F.concat(F.array("print"), F.transform(free, lambda bit: F.col("print").bitwiseXOR(bit)))
    named = many.select("n", "print", "rep", F.explode(centres).alias("centre"))
    least_of = named.groupBy("n", "centre").agg(F.min(F.struct("rep", "print")).alias("low"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    hung = named.join(least_of.hint("merge"), ["n", "centre"]).filter("rep > low.rep")
    hung = hung.select(F.col("rep").alias("a"), F.col("low.rep").alias("b"), F.bit_count(F.col("print").bitwiseXOR(F.col("low.print"))).alias("bits"))
    return pairs.unionByName(hung).filter(F.col("bits") <= radius).distinct()


def _free_bits(radius: int, n: int) -> list[int]:
    """The single bits of the positions that combination n leaves out, as signed longs."""
    kept = list(combinations(range(8), 8 - radius))[n]
    bits = [1 << (8 * p + i) for p in range(8) if p not in kept for i in range(8)]
    return [b - (1 << 64) if b >> 63 else b for b in bits]


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links, group_size) per row.

    Words are runs without ASCII white space, A-Z in lower case; a shingle is ``words`` of them joined by a space, or
    the whole sequence if there are fewer; its hash is XXH64 of its UTF-8 bytes. NULL, empty and blank texts have
    fingerprint zero and are linked like any other. Rows whose fingerprints differ in at most ``radius`` bits are
    linked; ``component_id`` is the smallest id reachable. ``group_size`` counts the rows with the same fingerprint,
    ``n_links`` the links by which that fingerprint was joined to others. Ties and repeated rows: equal fingerprints
    are one class, named by its smallest id; if one id has two fingerprints, these count as linked. Rows
    without an id are fingerprinted, get component NULL and link nothing. Other columns aren't looked at or returned;
    an empty table gives no rows.
    """
    small_batches(df.sparkSession)
    signed = written(fingerprints(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), words=words, seed=seed), "fingerprints")
    classes = written(signed.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("group_size")), "prints")
    found = written(links(classes.filter("rep IS NOT NULL").select("print", "rep"), radius=radius), "print-links")
    labels = components(found)
    degree = found.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    named = named.select("print", F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "group_size")
    out = join_groups(signed, written(named, "print-classes"), "print", "group_size")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), component.alias("component_id"), "n_links", "group_size")
