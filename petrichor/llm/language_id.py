"""Languages of a document as a mixture: expectation-maximisation over n-gram likelihoods.

A word's likelihood in a language is the product of its character trigrams' probabilities there. EM finds the
shares with which the languages explain a document's words. The set of languages is chosen by penalised
likelihood: another language is let in only if it raises the log-likelihood by more than the penalty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from petrichor.llm.common import written
from petrichor.llm.shingles import small_batches

BUCKETS = 1 << 16
#: Characters whose words are weighed at once; a word takes some hundred bytes.
BATCH_CHARS = 400_000
RESULT = "lang_pred string, score double, languages array<string>, shares array<double>"
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each trigram, number of its word, words per text). Words are runs of letters in lower case; a
    trigram may hold the space at one end or both, never in the middle."""
    counts, pieces = [], [np.array([32], np.uint32)]
    for t in texts:
        points = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = _letters()[points]
        kept = np.where(letters, points, np.uint32(32))
        first = letters & np.concatenate([[True], ~letters[:-1]]) if len(letters) else letters
        counts.append(int(first.sum()))
        pieces += [kept, np.array([32], np.uint32)]
    c = np.concatenate(pieces)
    c = c[(c != 32) | np.concatenate([[True], c[:-1] != 32])]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.array(counts, np.int64)
    starts = (c[1:] != 32) & (c[:-1] == 32)
    word = np.cumsum(starts) - 1
    inside = c[1:-1] != 32
    with np.errstate(over="ignore"):
        mixed = (c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    return (mixed >> np.uint32(16))[inside].astype(np.int64), word[:-1][inside], np.array(counts, np.int64)


def _parts(texts: list[str], chars: int) -> Iterator[list[str]]:
    """The texts in runs of at most so many characters, one text at least."""
    at = 0
    while at < len(texts):
        upto, total = at, 0
        while upto < len(texts) and (upto == at or total + len(texts[upto]) <= chars):
            total += len(texts[upto])
            upto += 1
        yield texts[at:upto]
        at = upto


def learn(df: DataFrame, *, text_col: str, lang_col: str, max_languages: int = 500) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability per language and trigram bucket) from all given rows.

    Each task counts into 65,536 buckets per language and hands over the ones it has met; the sums go to the
    driver, 65,536 numbers per language at most, and only after the languages were counted: more than ``max_languages``
    are an error. Rows without text or language teach nothing.
    """
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for lang, n in seen.items():
                at = np.flatnonzero(n)
                yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})
            seen.clear()

        for pdf in batches:
            for lang, own in pdf.groupby("lang"):
                for part in _parts(own["text"].tolist(), BATCH_CHARS):
                    seen[lang] = seen.get(lang, 0) + np.bincount(_trigrams(part)[0], minlength=BUCKETS)
                if len(seen) > 64:
                    yield from flush()
        yield from flush()

    small_batches(df.sparkSession)
    counts = written(rows.mapInPandas(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    if (n := counts.select("lang").distinct().count()) > max_languages:
        raise ValueError(f"{n} languages in {lang_col}, at most {max_languages} can be told apart")
    table = counts.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("ns")).orderBy("lang").collect()
    logs = np.full((len(table), BUCKETS), 0.5)
    for i, row in enumerate(table):
        logs[i, row.buckets] += row.ns
    return [r.lang for r in table], np.log(logs / logs.sum(axis=1, keepdims=True)).astype(np.float32) if table else logs.astype(np.float32)


def _fit(likely: np.ndarray, owner: np.ndarray, edges: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for the texts of a batch at once: (shares, log-likelihood). likely: words x languages."""
    n = np.diff(edges)[:, None]
    for _ in range(rounds):
        part = likely * shares[owner]
        shares = np.add.reduceat(part / part.sum(axis=1, keepdims=True), edges[:-1], axis=0) / n
    return shares, np.add.reduceat(np.log((likely * shares[owner]).sum(axis=1)), edges[:-1])


def mixtures(texts: list[str], logs: np.ndarray, *, rounds: int = 8, penalty: float = 2.0) -> np.ndarray:
    """(texts, languages) shares; all zero for a text without a letter.

    The set starts with the likeliest language. As long as some other language raises the penalised likelihood
    (``penalty`` * log(words) a language), the one that raises it most is let in. A text's result depends on that
    text alone, whatever the others of its batch do.
    """
    bucket, word, counts = _trigrams(texts)
    out = np.zeros((len(texts), len(logs)))
    full = np.flatnonzero(counts)
    if not len(full) or not len(logs):
        return out
    per_word = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    likely = np.stack([np.add.reduceat(row[bucket], per_word) for row in logs], axis=1).astype(np.float64)
    likely = np.maximum(np.exp(likely - likely.max(axis=1, keepdims=True)), 1e-9)  # no word alone rules a language out
    sizes = counts[full]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(full)), sizes)
    singles = np.add.reduceat(np.log(likely), edges[:-1], axis=0)
    chosen = np.zeros(singles.shape, bool)
    chosen[np.arange(len(full)), singles.argmax(axis=1)] = True
    best, value = chosen.astype(float), singles.max(axis=1)
    live = np.arange(len(full))  # the texts whose set may still grow
    for k in range(2, len(logs) + 1):
        if not len(live):
            break
        if len(live) < len(sizes):
            mine = np.isin(owner, live)
            words, n = likely[mine], sizes[live]
        else:
            words, n = likely, sizes
        ends = np.concatenate([[0], np.cumsum(n)])
        whose = np.repeat(np.arange(len(live)), n)
        top, top_shares, which = value[live], best[live], np.full(len(live), -1)
        for lang in range(len(logs)):
            start = chosen[live].astype(float)
            absent = start[:, lang] == 0
            start[:, lang] = 1
            tried, gained = _fit(words, whose, ends, start / start.sum(axis=1, keepdims=True), rounds)
            gained = gained - (k - 1) * penalty * np.log(n)
            better = absent & (gained > top)
            top[better], which[better] = gained[better], lang
            top_shares[better] = tried[better]
        grown = which >= 0
        live, which = live[grown], which[grown]
        best[live], value[live] = top_shares[grown], top[grown]
        chosen[live, which] = True
    out[full] = best
    return out


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], *, text_col: str = "text", batch_chars: int = BATCH_CHARS) -> DataFrame:
    """Every row with lang_pred, score, languages and shares; columns of these names are replaced.

    lang_pred has the largest share of the text's words (ties: the first language in order), score is that share;
    languages and shares list the chosen set, largest share first. NULL, or a text without a letter, is ``und``
    with score 0 and empty lists, and so is every text if nothing was learned.
    """
    languages, logs = model

    @pandas_udf(RESULT)
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = [mixtures(part, logs) for part in _parts(texts.fillna("").tolist(), batch_chars)]
        shares = np.concatenate(found) if found else np.zeros((0, len(logs)))
        order = np.argsort(-shares, axis=1, kind="stable")
        rows = []
        for s, o in zip(shares, order):
            o = [i for i in o if s[i] > 0]
            rows.append((languages[o[0]] if o else UNKNOWN, min(float(s[o[0]]), 1.0) if o else 0.0, [languages[i] for i in o], [float(s[i]) for i in o]))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "languages", "shares"])

    small_batches(df.sparkSession)
    outs = ["lang_pred", "score", "languages", "shares"]
    rest = [c for c in df.columns if c.lower() not in outs]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), predict(F.col(text_col)).alias("found"))
    return packed.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], "found.*")


def held_out(id_col: Column, modulus: int = 5, remainder: int = 0) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a NULL id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % modulus == remainder
