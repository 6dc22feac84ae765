"""Near-duplicate lines by a deletion-neighbourhood join over words.

Only DataFrame functions. Two lines are near if one word inserted, deleted or replaced turns one into the other.
Such a pair has equal variants: the same words after leaving out word i of both, or one line as it is and the other
without a word. Before variants are made, a count finds the lines that share one half with another line, which any
near pair does; all others emit nothing. Variants are hashed from running XORs of (word, position) hashes, so a
line of n words costs n rows and not n squared.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from petrichor.llm.common import small_or_not, written

MIN_WORDS = 8
_ID = ["h1", "h2"]
#: A line's place as one number that sorts like (doc_id, line_no): lines per document below 2**31, NULL ids first.
_STEP, _NULL = Decimal(1 << 31), Decimal(-(1 << 100))


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, line, h1, h2) of the lines that are more than white space, trimmed."""
    lines = df.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.trim("line", F.lit(" \t\x0b\x0c\r"))).filter("line <> ''")
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64("line", F.lit(1))})


def _place() -> Column:
    return F.coalesce(F.col("doc_id").cast("decimal(20,0)") * F.lit(_STEP), F.lit(_NULL)).cast("decimal(37,0)") + F.col("line_no").cast("decimal(10,0)")


def _document(at: Column) -> Column:
    return F.when(at >= F.lit(_NULL / 2), F.floor(at / F.lit(_STEP)).cast("bigint"))


def _halves(line: Column, n: Column) -> dict[str, Column]:
    """Hashes of the halves that a line shares with any line one edit away.

    If the longer line of a pair has m words, the edit lies either before word m // 2, and the rest is equal, or
    not, and the start is. A line is the longer one for m = n, the shorter or equal one for m = n and n + 1.
    """
    keys = {}
    for name, m in (("", n), ("1", n + 1)):
        cut = F.floor(m / 2).cast("int")
        keys[f"start{name}"] = F.xxhash64(F.lit("start"), m, F.call_function("substring_index", line, F.lit(" "), cut))
        keys[f"end{name}"] = F.xxhash64(F.lit("end"), m, F.call_function("substring_index", line, F.lit(" "), cut - m.cast("int")))
    return keys


def _near(x: Column, y: Column) -> Column:
    """Whether at most one word edit lies between two arrays."""
    a, b = F.when(F.size(x) >= F.size(y), x).otherwise(y), F.when(F.size(x) >= F.size(y), y).otherwise(x)
    differs = F.array_position(F.zip_with(a, b, lambda p, q: ~p.eqNullSafe(q)), True).cast("int")  # 1-based, 0: never
    tail = lambda w, at: F.slice(w, at, F.greatest(F.size(w) - at + 1, F.lit(0)))
    same = (differs == 0) | (tail(a, differs + 1) == tail(b, differs + 1))
    longer = (differs > 0) & (tail(a, differs + 1) == tail(b, differs))
    return F.when(F.size(a) == F.size(b), same).when(F.size(a) == F.size(b) + 1, longer).otherwise(F.lit(False))


def _variants(lines: DataFrame) -> DataFrame:
    """(at, key, kind) for lines (at, n, words, shared): ``key`` is the hashed variant.

    kind "swap": word i left out, together with n and i; "longer": word i left out; "whole": nothing left out.
    ``shared`` names the halves met elsewhere; the edit lies in the other half, so only its words are left out.
    """
    spread = lines.select("at", "n", "shared", F.posexplode("words").alias("i", "word"))
    spread = spread.select("at", "n", "shared", "i", F.xxhash64("word", "i").alias("here"), F.xxhash64("word", F.col("i") - 1).alias("shifted"))
    line = Window.partitionBy("at")
    up = line.orderBy("i")
    before = F.coalesce(F.expr("bit_xor(here)").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.expr("bit_xor(shifted)").over(line).bitwiseXOR(F.expr("bit_xor(shifted)").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    left = spread.withColumn("rest", before.bitwiseXOR(after)).withColumn("whole", F.expr("bit_xor(here)").over(line))
    has = lambda half: F.array_contains("shared", half)
    late = F.col("i") >= F.floor(F.col("n") / 2)
    edited = (late & has("start")) | (~late & has("end"))
    kinds = F.array(
        F.struct(F.when(edited, "swap").alias("kind"), F.xxhash64("rest", "n", "i").alias("key")),
        F.struct(F.when(edited, "longer").alias("kind"), F.xxhash64("rest", F.col("n") - 1).alias("key")),
        F.struct(F.when((F.col("i") == 0) & (has("start1") | has("end1")), "whole").alias("kind"), F.xxhash64("whole", "n").alias("key")),
    )
    return left.select("at", F.inline(kinds)).filter("kind IS NOT NULL")


def duplicate_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, line_no, line_hash, keep_doc, keep_line, near) for every line to drop.

    Lines are compared without white space at their ends; empty ones are left alone. Of equal lines the earliest
    by (doc_id, line_no) stays, NULL ids first. A line of ``min_words`` words or more, as single spaces part them,
    goes as well if an earlier line, itself kept or not, is one word edit away; shorter lines only if equal. So
    the order of work doesn't matter. Ids are integers. Repeated rows are one document. Rows with one id and different
    texts stand at the same places; what is dropped at a place is told by the line's hash.
    """
    lines = _lines(df, id_col, text_col)
    counted = lines.withColumn("n", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    halves = {k: F.when(F.col("n") >= min_words - 1, c) for k, c in _halves(F.col("line"), F.col("n")).items()}
    rows = counted.select(*_ID, "n", _place().alias("at"), *[c.alias(k) for k, c in halves.items()])
    unique = rows.groupBy(*_ID).agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", *halves)])
    unique = written(unique, "lines")

    halved = unique.filter("n >= " + str(min_words - 1)).select("at", F.inline(F.array(*[F.struct(F.lit(k).alias("side"), F.col(k).alias("half")) for k in halves])))
    shared = written(halved.groupBy("half").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("half"), "shared-halves")
    possible = written(halved.join(small_or_not(shared, shared.count()), "half", "left_semi").groupBy("at").agg(F.collect_set("side").alias("shared")), "possible-lines")
    own = written(unique.select(*_ID, "n", "at").join(small_or_not(possible, possible.count()), "at"), "own-lines")
    found = lines.select(*_ID, "line", _place().alias("here")).join(small_or_not(own, own.count()), _ID).filter("here = at")
    texts = written(found.select("at", "n", "shared", F.split("line", " ").alias("words")).dropDuplicates(["at"]), "line-words")

    variants = written(_variants(texts), "variants")
    swap = F.col("kind") == "swap"
    best = variants.groupBy("key", swap.alias("swap")).agg(
        F.count(F.lit(1)).alias("m"), F.min(F.when(F.col("kind") != "longer", F.col("at"))).alias("plain"), F.min(F.when(F.col("kind") == "longer", F.col("at"))).alias("longer")
    ).filter("m > 1")
    met = variants.withColumn("swap", swap).join(best, ["key", "swap"])
    pairs = met.withColumn("lead", F.when(F.col("kind") == "whole", F.col("longer")).otherwise(F.col("plain"))).filter("lead < at").select("at", "lead").distinct()
    named = texts.select("at", "words", "n")
    leads = texts.select(F.col("at").alias("lead"), F.col("words").alias("lead_words"), F.col("n").alias("lead_n"))
    checked = pairs.join(named, "at").join(leads, "lead").filter((F.greatest("n", "lead_n") >= min_words) & _near(F.col("words"), F.col("lead_words")))
    near = written(checked.groupBy("at").agg(F.min("lead").alias("lead")), "near-lines")

    known = unique.select(*_ID, "at", "copies").join(small_or_not(near, near.count()), "at", "left").filter("copies > 1 OR lead IS NOT NULL").select(*_ID, "at", "lead")
    known = written(known, "known-lines")
    every = lines.select(*_ID, "doc_id", "line_no", _place().alias("here")).join(small_or_not(known, known.count()), _ID)
    later = every.filter("lead IS NOT NULL OR here <> at").withColumn("keep", F.coalesce("lead", "at"))
    keep_line = F.col("keep") - F.coalesce(_document(F.col("keep")).cast("decimal(20,0)") * F.lit(_STEP), F.lit(_NULL))
    return later.select("doc_id", "line_no", F.col("h1").alias("line_hash"), _document(F.col("keep")).alias("keep_doc"), keep_line.cast("int").alias("keep_line"), F.col("lead").isNotNull().alias("near")).distinct()


def line_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) per row: the text without the lines that ``duplicate_lines`` names.

    A NULL text stays NULL and has no lines; a text that loses all its lines is empty; an empty table gives no rows.
    A row loses a line only if that very line is named at its place, so rows that share an id don't lose each other's
    lines. Other columns aren't returned.
    """
    dropped = duplicate_lines(df, id_col=id_col, text_col=text_col, min_words=min_words)
    per = written(dropped.groupBy(F.col("doc_id").alias("drop_id")).agg(F.collect_set(F.struct("line_no", "line_hash")).alias("drop")), "dropped-lines")
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.join(small_or_not(per, per.count()), F.col("doc_id").eqNullSafe(F.col("drop_id")), "left")
    rows = rows.withColumn("lines", F.split("text", "\n"))
    hashed = lambda line: F.xxhash64(F.trim(line, F.lit(" \t\x0b\x0c\r")))
    kept = F.filter("lines", lambda line, i: ~F.array_contains(F.col("drop"), F.struct(i.alias("line_no"), hashed(line).alias("line_hash"))))
    rows = rows.withColumn("kept", F.when(F.col("drop").isNull(), F.col("lines")).otherwise(kept))
    n, left = F.coalesce(F.size("lines"), F.lit(0)), F.coalesce(F.size("kept"), F.lit(0))
    count = lambda c: F.when(F.col("text").isNull(), F.lit(0)).otherwise(c).cast("long")
    return rows.select("doc_id", count(n).alias("n_lines"), count(n - left).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
