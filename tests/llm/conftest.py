import random

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def prose():
    """A seeded maker of sentences over a small vocabulary per language."""
    rng = random.Random(5)
    words = {
        lang: ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(400)]
        for lang, parts in {"en": ["th", "er", "ing", "and", "st", "on"], "fr": ["eau", "ou", "é", "que", "ment", "ai"], "de": ["sch", "ung", "ü", "ein", "ich", "ß"]}.items()
    }

    def make(lang, n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(words[lang]) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def corpus(spark, prose):
    """Exact and near copies, ties, NULLs in any column, empty and very long texts, repeated rows, names that clash."""
    rows = []
    for i in range(40):
        lang = ["en", "fr", "de"][i % 3]
        rows.append([i, prose(lang, 30 + 5 * (i % 7), i), lang, f"s{i % 4}", 0])
    for i in range(40, 60):  # copies, near copies
        base = rows[i - 40]
        text = base[1] if i % 2 else base[1] + " tail"
        rows.append([i, text, base[2], base[3], 0])
    rows += [[60, None, "en", "s0", None], [61, "", None, None, 0], [62, "  \t\n ", "en", "s1", 0], [63, "single", "fr", None, 0], [None, "nobody's text", "en", "s2", 0], [64, "1234 !!", "en", "s9", 0]]
    rows += [[65, prose("de", 6000, 65), "de", "s0", 0], [66, rows[3][1], "en", "s1", 0], [66, rows[3][1], "en", "s1", 0], [-5, "l’été  ÉTÉ \x1c x y", "fr", "s1", 0]]
    df = spark.createDataFrame(rows, DOC)
    from pyspark.sql import functions as F

    return df.withColumns({"kept": F.lit("own"), "KEEP_ID": F.lit(1), "_h": F.lit(2), "row": F.lit(3), "score": F.lit("x"), "size": F.lit(None).cast("string"), "a.b": F.lit(4)})
