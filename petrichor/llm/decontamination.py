"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Only DataFrame functions. A window as similar to an item as asked has most of the item's shingles. So the places
where an item's shingles occur in a document are counted first, and every window of the item's size that holds
enough of them is made, in whatever order they stand. Windows aligned with a shared shingle (at the document's position less
the item's) are made as well, the ends of the document cut off; all windows are then compared with all items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from petrichor.llm.common import small_or_not, written

#: Bits that may differ, of 64. Windows at shingle similarity 0.8 have word SimHashes some 9 bits apart.
RADIUS = 16


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; NULL or none: an empty array."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def shingle_hashes(words: Column, k: Column | int) -> Column:
    """Hashes of all runs of k words in order, repeated ones too; none if there are fewer words."""
    k = k if isinstance(k, Column) else F.lit(k)
    last = F.size(words) - k + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, k)))
    return F.when(last >= 1, runs).otherwise(F.array().cast("array<bigint>"))


def simhash(words: Column) -> Column:
    """64 bits: for each, whether most of the words' hashes have it set."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    ones = lambda b: F.size(F.filter(hashes, lambda h: F.getbit(h, b) == 1)) * 2 > F.size(hashes)
    bit = F.lit(0).cast("bigint")
    for b in range(64):
        bit = bit.bitwiseOR(F.when(ones(F.lit(b)), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)))
    return bit


def hamming_blocks(fingerprint: Column, radius: int) -> Column:
    """radius + 1 blocks (number, value): two fingerprints within the radius agree in one block at least."""
    n = radius + 1
    edges = [64 * j // n for j in range(n + 1)]
    value = lambda a, z: F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (z - a)) - 1))
    return F.array(*[F.struct(F.lit(j).alias("block"), value(a, z).alias("value")) for j, (a, z) in enumerate(zip(edges, edges[1:]))])


def _common(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets."""
    times = lambda xs, h: F.size(F.filter(xs, lambda x: x == h))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, h: acc + F.least(times(a, h), times(b, h)))


def _crowded(places: Column, least: Column, span: Column) -> Column:
    """Starts >= 0 of the windows over ``span`` shingles that hold at least so many of the sorted places."""
    runs = F.transform(F.sequence(F.lit(0), F.size(places) - least), lambda i: F.struct(F.get(places, i).alias("first"), F.get(places, i + least - 1).alias("last")))
    near = F.filter(runs, lambda r: r["last"] - r["first"] < span)
    starts = F.flatten(F.transform(near, lambda r: F.sequence(F.greatest(r["last"] - span + 1, F.lit(0)), r["first"])))
    return F.when(F.size(places) >= least, F.array_distinct(starts)).otherwise(F.array().cast("array<int>"))


def passages(
    df: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    words: int = 5, similarity: float = 0.8, radius: int = RADIUS,
) -> DataFrame:
    """(doc_id, item_id, start, similarity): windows similar to a benchmark item; start counts words from 0.

    Similarity is sum of minima / sum of maxima of the shingles' multiplicities; shingles have ``words`` words, or
    as many as the item if it has fewer. Windows have an item's number of words and lie anywhere in the document; a
    shorter document is one window. Items without a word match nothing; repeated items count each. Rows with
    the same id, NULL too, are one document. The item tables are broadcast only after their rows are counted.
    """
    listed = items.select(F.col(item_id).alias("item_id"), words_of(F.col(item_text)).alias("item_words")).filter(F.size("item_words") > 0).distinct()
    listed = listed.withColumn("n", F.size("item_words")).withColumn("k", F.least("n", F.lit(words)))
    listed = written(listed.withColumns({"item_shingles": shingle_hashes(F.col("item_words"), F.col("k")), "item_print": simhash(F.col("item_words"))}), "items")
    seeds = listed.select("n", "k", F.xxhash64("item_words").alias("item"), F.posexplode("item_shingles").alias("offset", "h")).distinct()
    seeds = written(seeds.groupBy("h", "k").agg(F.collect_list(F.struct("n", "item", "offset")).alias("at")), "item-shingles")
    n_seeds, n_items = seeds.count(), listed.count()
    sizes = [r.k for r in seeds.select("k").distinct().collect()]  # at most ``words`` numbers

    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    worded = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    hashed = worded.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), shingle_hashes(F.col("w"), k).alias("hs")) for k in sizes] or [F.struct(F.lit(0).alias("k"), F.array().cast("array<bigint>").alias("hs"))])).alias("s"))
    spots = hashed.select("doc_id", F.col("s.k").alias("k"), F.posexplode("s.hs").alias("pos", "h"))
    hits = spots.join(small_or_not(seeds, n_seeds), ["h", "k"]).select("doc_id", "k", "pos", F.inline("at"))
    met = hits.groupBy("doc_id", "k", "n", "item").agg(F.sort_array(F.collect_set("pos")).alias("places"), F.collect_set(F.col("pos") - F.col("offset")).alias("aligned"))
    # of two multisets of the size ``span``, so many are common at that similarity; of a smaller one and the item's, ``fewer``
    span, places, n = F.col("n") - F.col("k") + 1, F.col("places"), F.col("n")
    at_least = lambda share: F.greatest(F.ceil(span * share - 1e-9).cast("int"), F.lit(1))
    least, fewer = at_least(2 * similarity / (1 + similarity)), at_least(similarity)
    whole = (F.size(places) >= fewer) & (F.element_at(places, -1) - F.element_at(places, 1) < span)
    kind = lambda starts, name: F.transform(starts, lambda x: F.struct(x.alias("start"), F.lit(name).alias("kind")))
    made = F.concat(kind(F.col("aligned"), "cut"), kind(_crowded(places, least, span), "full"), kind(F.when(whole, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), "short"))
    windows = written(met.select("doc_id", "n", F.inline(made)).distinct(), "windows")

    ids = written(windows.select(F.col("doc_id").alias("hit_id")).distinct(), "hit-ids")
    few = small_or_not(ids, ids.count())
    hit = docs.join(few, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_semi").select("doc_id", words_of(F.col("text")).alias("w"))
    cut = hit.join(windows.withColumnRenamed("doc_id", "hit_id"), F.col("doc_id").eqNullSafe(F.col("hit_id")))
    begin, end = F.greatest("start", F.lit(0)), F.least(F.col("start") + F.col("n"), F.size("w"))
    fits = F.when(F.col("kind") == "full", F.col("start") + F.col("n") <= F.size("w")).otherwise((F.col("kind") == "cut") | (F.size("w") < F.col("n")))
    cut = cut.filter((begin < end) & fits).select("doc_id", begin.alias("start"), F.slice("w", begin + 1, end - begin).alias("window")).distinct()
    prints = written(cut.withColumn("print", simhash(F.col("window"))), "window-prints")

    index = listed.select("item_id", "item_print", F.inline(hamming_blocks(F.col("item_print"), radius)))
    probes = prints.select("doc_id", "start", "window", "print", F.inline(hamming_blocks(F.col("print"), radius)))
    near = probes.join(small_or_not(index, n_items * (radius + 1)), ["block", "value"])
    near = near.filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius).select("doc_id", "start", "window", "item_id").distinct()
    both = near.join(small_or_not(listed.select("item_id", "k", "item_shingles"), n_items), "item_id").withColumn("own", shingle_hashes(F.col("window"), F.col("k")))
    both = both.withColumn("same", _common(F.col("own"), F.col("item_shingles")))
    ratio = F.col("same") / (F.size("own") + F.size("item_shingles") - F.col("same"))
    return both.select("doc_id", "item_id", "start", ratio.alias("similarity")).filter(F.col("similarity") >= similarity)


def contamination(df: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, similarity) per row: the benchmark items found in it, ascending,
    and the best similarity (NULL without any)."""
    found = passages(df, items, id_col=id_col, **options)
    per = written(found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity")), "contaminated")
    per = small_or_not(per.withColumnRenamed("doc_id", "hit_id"), per.count(), 100_000)
    rows = df.select(F.col(id_col).alias("doc_id")).join(per, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    ids = F.coalesce("item_ids", F.array().cast(dict(found.dtypes)["item_id"].join(["array<", ">"])))
    return rows.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), "similarity")
