"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

Each works on all rows it is given and, but for the last, returns the columns of ``docs``. Rows are dropped by their
id through an anti-join: the ids to drop are counted and broadcast only if they are few, and texts aren't shuffled
then. A NULL id is never dropped by id. Repeated rows are one document to a stage; the near-dedup keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from petrichor.llm import decontamination, language_id, minhash, mixing, sequences
from petrichor.llm.common import fresh, small_or_not, written

#: A document stays if one language has at least this share of its words.
MIN_SHARE = 0.5


def _without(docs: DataFrame, ids: DataFrame, how: str = "left_anti") -> DataFrame:
    (name,) = fresh(docs, "gone")
    ids = ids.select(F.col("doc_id").alias(name))
    return docs.join(small_or_not(ids, ids.count()), F.col("doc_id") == F.col(name), how)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those of which no language has half the words."""
    model = language_id.learn(docs, text_col="text", lang_col="lang")
    packed = docs.select("text", F.struct("*").alias("row"))
    found = language_id.identify(packed, model)
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SHARE)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component, once; shingles of five words, similarity 0.8."""
    found = written(minhash.near_duplicates(docs, words=5, percent=80), "near-duplicates")
    rest = _without(docs, written(found.filter("NOT kept").select("doc_id").distinct(), "dropped-ids"))
    twice = written(found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    return _without(rest, twice).unionByName(_without(rest, twice, "left_semi").dropDuplicates())


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document that holds a benchmark item."""
    found = decontamination.passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, written(found.select("doc_id").distinct(), "contaminated-ids"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many whole copies of each document as the mix takes of it, rounded: only where a source's last pass ends
    is one cut. Documents without words have no part in a mix."""
    packed = docs.select("doc_id", "text", "source", F.struct("*").alias("row"))
    mixed = mixing.mix(packed).filter("size > 0").withColumn("copies", F.round(F.col("taken") / F.col("size")).cast("int")).filter("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def write_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what they hold of each document."""
    import public_tokenizers

    manifest = sequences.write_token_files(docs, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))
    return sequences.read_documents(manifest)
