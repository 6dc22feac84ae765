"""Quality classifier as a sparse rule ensemble.

Shallow trees over text statistics give paths; every path is a conjunctive rule. A logistic regression with lasso
penalty keeps few of them. The model is a list of rules with weights and compiles to one Spark column expression,
so scoring is a projection.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from petrichor.llm.common import written

#: (feature, whether the value lies at or below the threshold, threshold)
Condition = tuple[str, bool, float]


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; NULL counts as empty, and an empty text has zeros."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text)
    words = F.split(F.trim(F.regexp_replace(text, r"[\x09-\x0D]", " ")), " +")
    n = F.size(words)
    lines = F.split(text, "\n")
    per_char = lambda pattern: F.regexp_count(text, F.lit(pattern)) / F.greatest(chars, F.lit(1))
    return {
        "words": n.cast("double"),
        "word_length": chars / F.greatest(n, F.lit(1)),
        "distinct_words": F.when(chars > 0, F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1))).otherwise(0.0),
        "distinct_lines": F.when(chars > 0, F.size(F.array_distinct(lines)) / F.size(lines)).otherwise(0.0),
        "line_words": n / F.size(lines),
        "capital_runs": per_char(r"\p{Lu}{2,}"),
        "digits": per_char("[0-9]"),
        "exclamations": per_char("!"),
        "symbols": per_char(r"[#*$%&@^~=+_<>{}\[\]\\/]"),
        "bars": per_char(r"\|"),
        "commas": per_char(","),
        "sentence_ends": per_char(r"[.!?](?=\s|$)"),
        "repeats": per_char(r"(?<![^ ])([^ ]+) (?=\1(?: |$))"),
    }


@dataclass(frozen=True)
class RuleModel:
    rules: list[tuple[tuple[Condition, ...], float]]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1 over the statistics' columns."""
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            total = total + F.when(_rule(conditions), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _rule(conditions: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for feature, below, threshold in conditions:
        out = out & (F.col(feature) <= threshold if below else F.col(feature) > threshold)
    return out


def tree_paths(description: str, features: list[str]) -> set[tuple[Condition, ...]]:
    """All paths from the root of the trees in a forest's printed form, inner nodes' paths included."""
    found, path = set(), []
    for line in description.splitlines():
        if line.lstrip().startswith("Tree"):
            path = []
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m:
            path = [(i, c) for i, c in path if i < len(m[1])] + [(len(m[1]), (features[int(m[2])], m[3] == "<=", float(m[4])))]
            tightest: dict[tuple[str, bool], float] = {}
            for _, (feature, below, threshold) in path:
                old = tightest.get((feature, below), threshold)
                tightest[feature, below] = min(old, threshold) if below else max(old, threshold)
            found.add(tuple(sorted((f, b, t) for (f, b), t in tightest.items())))
    return found


def fit(
    labelled: DataFrame, features: list[str], *, label: str = "label", key: str = "key", max_rows: int = 20_000, trees: int = 20, depth: int = 3, lasso: float = 2e-3, seed: int = 7,
) -> RuleModel:
    """Learn from rows (key, label 0/1, features).

    At most about ``max_rows`` rows are used, a seeded choice by the hash of ``key``. With no rows the score is
    0.5, with one label only it is that label's.
    """
    n = labelled.count()
    share = min(1.0, max_rows / max(n, 1))
    sample = labelled.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = written(sample.select(F.col(label).cast("double").alias("label"), *features), "quality-sample")
    seen = [r[0] for r in sample.select("label").distinct().limit(3).collect()]
    if len(seen) < 2:
        return RuleModel([], 0.0 if not seen else 10.0 * (2 * seen[0] - 1))
    vectors = VectorAssembler(inputCols=features, outputCol="vector").transform(sample).select("label", "vector")
    forest = RandomForestClassifier(featuresCol="vector", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", subsamplingRate=0.5, seed=seed).fit(vectors)
    rules = sorted(tree_paths(forest.toDebugString, features))
    held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="vector").transform(sample.select("label", *[_rule(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)]))
    lines = LogisticRegression(featuresCol="vector", elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(held.select("label", "vector"))
    return RuleModel([(r, float(w)) for r, w in zip(rules, lines.coefficients.toArray()) if w], float(lines.intercept))


def training_rows(stats: DataFrame, labels: DataFrame, *, id_col: str, label: str) -> DataFrame:
    """(key, label, statistics) of labelled documents. Several labels of a document count by majority, ties as 1;
    NULL labels and ids teach nothing."""
    per = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg((F.avg(label) >= 0.5).cast("double").alias("label"))
    return stats.withColumnRenamed(id_col, "key").join(per, "key")
