"""Words and word shingles of Arrow text columns, hashed in bulk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import SparkSession

_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Whole texts go to Python: fewer rows at once than the default 10,000 keep a batch in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def slices(batch: pa.RecordBatch, text: str = "text", text_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of text, one row at least."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(total):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + text_bytes)))
        yield batch.slice(at, upto - at)
        at = upto


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, words per text). A-Z in lower case; words end at the ASCII white space
    \\x20 \\x09-\\x0D; NULL is empty."""
    flat = pc.replace_substring_regex(pc.fill_null(texts, "").cast(pa.large_string()), r"[\x09-\x0D]", " ")
    parts = pc.split_pattern(flat, " ")
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(parts).dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    # the lower case of bytes is that of A-Z alone
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) for w in words), np.uint64, len(words))
    real = np.fromiter(map(bool, words), bool, len(words))
    codes = coded.indices.to_numpy()
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    kept = real[codes]
    running = np.concatenate([[0], np.cumsum(kept)])
    edges = np.concatenate([[0], np.cumsum(counts)])
    return hashes[codes[kept]], running[edges[1:]] - running[edges[:-1]]


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes per text: runs of ``words`` words; with fewer, the whole sequence as
    one; none without words."""
    hashes, counts = word_hashes(texts)
    out, at = [], 0
    with np.errstate(over="ignore"):
        for n in counts:
            own = hashes[at : at + n]
            at += n
            if n == 0:
                out.append(np.zeros(0, np.uint64))
                continue
            k = min(words, n)
            folded = np.full(n - k + 1, np.uint64(k if k < words else 0))
            for j in range(k):
                folded = (folded ^ own[j : n - k + 1 + j]) * _MIX[0]
                folded = (folded ^ (folded >> np.uint64(29))) * _MIX[1]
            out.append(np.unique(folded ^ (folded >> np.uint64(32))))
    return out
