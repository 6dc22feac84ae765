"""Near duplicates with circulant MinHash, banding and exact verification.

The signature uses two permutations of the 32-bit numbers: the first scatters the shingles, the second is shifted
circularly by k for coordinate k. Documents that agree in all coordinates of a band are candidates, and a candidate
becomes a link only after a comparison of the full shingle sets.

Documents with equal sets are one class from the start. In a bucket every class is compared with the bucket's
smallest one only, and the links found make components. Where a bucket still holds several, its classes are also
compared with one of the largest other component. The classes of buckets that are still mixed get a second circulant
signature with longer bands, which texts well below the threshold hardly ever share; there, too, only pairs whose
signatures agree nearly as often as a link's do become rows, and these are compared exactly. So thousands of copies
cost a few comparisons each. Links that are missed are those that miss the bands, with the probabilities below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from petrichor.llm.common import join_groups, small_or_not, written
from petrichor.llm.shingles import shingle_sets, slices, small_batches

#: 64 bands of 8: a pair at similarity 0.8 misses all of them with probability (1 - 0.8^8)^64, about 8e-6, and one at 0.5,
#: as texts around a common passage are, meets in one with probability 0.2.
BANDS, ROWS = 64, 8
#: The second, longer banding: a pair at 0.8 misses all bands with probability (1 - 0.8^14)^180, about 3e-4; one at 0.6 meets
#: in one with probability 0.13, against 0.66 in the first. Only classes of buckets that stay mixed get it.
LONG_BANDS, LONG_ROWS = 180, 14
#: Coordinates of which one bit is compared inside the join.
PIECES = 2496


def _second_permutation(x: np.ndarray, spare: np.ndarray) -> None:
    """In place: a fixed bijection of the 32-bit numbers."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)


def circulant_signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """(documents, coordinates) minima of the shifted second permutation; every set must have a member."""
    out = np.empty((len(sets), coordinates), np.uint32)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(sets):
            upto, total = at, 0  # some ten thousand shingles at a time stay in the cache
            while upto < len(sets) and (upto == at or total + len(sets[upto]) <= 40_000):
                total += len(sets[upto])
                upto += 1
            scattered = np.concatenate([(s * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32) for s in sets[at:upto]]).astype(np.uint32)
            starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : upto - 1]])]).astype(np.int64)
            value, spare = np.empty_like(scattered), np.empty_like(scattered)
            for k in range(coordinates):
                np.add(scattered, np.uint32(k), out=value)
                _second_permutation(value, spare)
                out[at:upto, k] = np.minimum.reduceat(value, starts)
            at = upto
    return out


def _band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(signatures), bands)).copy()
        for j in range(rows):
            keys = (keys ^ signatures[:, j::rows][:, :bands]) * np.uint64(0xBF58476D1CE4E5B9)
            keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def signatures(df: DataFrame, *, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, class, bands): class is a 128-bit digest of the whole set, NULL when it is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), words)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = _band_keys(circulant_signatures([sets[i] for i in full], bands * rows), bands, rows)
                lists = dict(zip(full, keys))
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                columns = [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([lists.get(i) for i in range(len(sets))], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return df.mapInArrow(sign, "doc_id bigint, n_shingles bigint, class binary, bands array<bigint>")


def _sets(df: DataFrame, words: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [s.tobytes() for s in shingle_sets(part.column("text"), words)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], schema=schema)

    return df.mapInArrow(build, "doc_id bigint, shingles binary")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, same, total) per pair of ids: sizes of the intersection and of the union."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("same", pa.int64()), ("total", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, total = [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                same.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()))
                total.append(len(x) + len(y) - same[-1])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same, pa.int64()), pa.array(total, pa.int64())], schema=schema)

    return both.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint, same bigint, total bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Rounds of large-star and small-star steps: each hangs neighbours below the smallest one known. Minima are
    aggregated before the shuffle and joined back, so a node with very many neighbours is no single task's work.
    """

    def star(e: DataFrame, both: bool) -> DataFrame:
        # e has a > b. Large star: every larger neighbour below the smallest of all; small star: every smaller one
        sides = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if both:
            sides = sides.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        hung = sides.join(least, "u")
        hung = hung.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if both else hung.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return hung.filter("a <> b").distinct()

    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while True:
        edges = written(star(star(edges, True), False), "stars")
        after = mark(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (key, rep, ...) with their component, of the buckets that hold more than one component."""
    named = members.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    keys = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    return named.join(keys, "key", "left_semi")


def _long_signatures(sets: DataFrame) -> DataFrame:
    """(rep, pieces, bands) of sets (doc_id, shingles): one bit of 2496 coordinates, and the keys of the long bands.

    A coordinate is a minimum, whose high bits are all but zero; the bit is folded from lower ones."""
    schema = pa.schema([("rep", pa.int64()), ("pieces", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                all_ = circulant_signatures([np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("shingles")], LONG_BANDS * LONG_ROWS)
                bits = all_[:, :PIECES] ^ (all_[:, :PIECES] >> np.uint32(5)) ^ (all_[:, :PIECES] >> np.uint32(11))
                pieces = np.packbits((bits & np.uint32(1)).astype(bool), axis=1).view(np.int64)
                columns = [part.column("doc_id"), pa.array(list(pieces), pa.list_(pa.int64())), pa.array(list(_band_keys(all_, LONG_BANDS, LONG_ROWS)), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return sets.select("doc_id", "shingles").mapInArrow(sign, "rep bigint, pieces array<bigint>, bands array<bigint>")


def _long_pairs(far: DataFrame, percent: int) -> DataFrame:
    """(a, b) of members (rep, component, n, pieces, bands) of different components that share a long band and whose
    pieces agree as often as a link's would, less four standard errors.

    One side of a pair lies outside its bucket's largest component, so that the many members of one component aren't
    held against each other; the agreement is part of the join's condition, so a hopeless pair never is a row. A member
    carries the keys of its shared buckets, ``LONG_BANDS`` at most, and a pair is made in the least one both have,
    once, however many bands it shares.
    """
    met = written(far.select("rep", "component", F.explode("bands").alias("key")), "long-buckets")
    parts = met.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    main = parts.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    met = written(met.join(main.select("key", "main"), "key"), "long-shared")
    own = met.groupBy("rep").agg(F.collect_list("key").alias("keys"))
    met = written(met.join(far.select("rep", "n", "pieces").join(own, "rep"), "rep").withColumn("is_main", F.col("component") == F.col("main")), "long-members")
    side = lambda s, df: df.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("rep", "component", "is_main", "n", "pieces", "keys")])
    x, y = side("x", met), side("y", met.filter("NOT is_main")).withColumnRenamed("key", "y_key")
    agree = (1 + percent / 100) / 2
    most = PIECES * (1 - agree) + 4 * (PIECES * agree * (1 - agree)) ** 0.5
    differing = F.lit(0)
    for i in range(PIECES // 64):
        differing = differing + F.bit_count(F.col("x_pieces")[i].bitwiseXOR(F.col("y_pieces")[i]))
    sized = F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent
    once = F.col("x_is_main") | (F.col("x_rep") < F.col("y_rep"))
    apart = (F.col("x_component") != F.col("y_component")) & once & sized & (differing <= int(most))
    first = F.col("key") == F.array_min(F.array_intersect("x_keys", "y_keys"))
    near = x.join(y, (F.col("key") == F.col("y_key")) & apart & first)
    return near.select(F.greatest("x_rep", "y_rep").alias("a"), F.least("x_rep", "y_rep").alias("b"))


def _linked(compared: DataFrame, percent: int) -> DataFrame:
    return compared.filter(F.col("same") * 100 >= F.col("total") * percent).select("a", "b")


def near_duplicates(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row.

    A document's set are its distinct ``words``-word shingles (A-Z in lower case); with fewer words the whole
    sequence is one shingle; a text that is NULL, empty or white space has none and links with nothing. Two
    documents are linked if 100 * intersection >= percent * union; ``component_id`` is the smallest id reachable.
    Classes are named by their smallest id: rows with the same id and text are one document and agree in all
    columns; if one id is the smallest of two different texts, these count as linked. A row without id keeps a
    NULL component of its own and is kept. Other columns are not looked at; an empty table gives no rows.
    """
    small_batches(df.sparkSession)
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(signatures(texts, words=words, bands=bands, rows=rows), "signatures")
    named = signed.filter("class IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(named.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("group_size")), "classes")
    buckets = classes.select("rep", "n", F.explode("bands").alias("key"))
    leaders = written(buckets.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("m")).filter("m > 1"), "leaders")
    members = written(join_groups(buckets, leaders, "key", "m").filter("leader IS NOT NULL").drop("m"), "members")
    pairs = written(members.filter("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids")
    wanted = texts.filter("doc_id IS NOT NULL").join(small_or_not(ids, ids.count()), "doc_id", "left_semi")
    sets = written(_sets(wanted, words), "sets")
    first = written(_compared(pairs, sets), "compared")
    links = _linked(first, percent)
    labels = components(links)

    # buckets that still hold several components: their largest one without the leader gives a second pivot
    far = written(_mixed(members, labels), "mixed-buckets")
    parts = far.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("p"), F.max(F.col("rep") == F.col("leader")).alias("own"))
    pivots = parts.filter("NOT own").groupBy("key").agg(F.max_by("p", F.struct("m", -F.col("p"))).alias("pivot"))
    far = written(far.drop("component").join(pivots, "key"), "pivots")
    high, low = F.greatest("rep", "pivot"), F.least("rep", "pivot")
    more = far.filter("rep <> pivot").select(high.alias("a"), low.alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    second = written(_compared(more, sets), "compared-again")
    links = links.unionByName(_linked(second, percent))
    labels = components(links)

    # what is left: members of mixed buckets meet again under longer bands, unless their signatures rule a link out
    far = written(_mixed(members, labels).select("rep", "component", "n").distinct(), "mixed-members")
    reps = far.select(F.col("rep").alias("doc_id"))
    long_ = written(_long_signatures(sets.join(small_or_not(reps, far.count()), "doc_id", "left_semi")), "long-signatures")
    rest = written(_long_pairs(far.join(long_, "rep"), percent).join(first.unionByName(second).select("a", "b"), ["a", "b"], "left_anti"), "rest-pairs")
    if rest.count():
        more = written(_linked(_compared(rest, sets), percent), "rest-links")
        if more.count():
            labels = components(links.unionByName(more))

    by_class = classes.join(labels, classes["rep"] == labels["node"], "left").select("class", "group_size", F.coalesce("component", "rep").alias("component"))
    found = join_groups(signed.select("doc_id", "n_shingles", "class"), written(by_class, "class-components"), "class", "group_size")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
