"""Registered queries of the operators in this folder, with their DuckDB texts where SQL can say the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from petrichor.llm.common import Query, documents

REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn

    return add


OP6_SQL = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


@query("op6_exact_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from petrichor.llm.exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text"), id_col="doc_id", text_col="text").drop("text")


OP9_SQL = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('7|' || CAST(doc_id AS VARCHAR)) AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY 1),
s AS (SELECT source, n, row_number() OVER (ORDER BY source NULLS LAST) AS r, (r - 1) % 3 + 1 AS w, 3 * n AS most FROM s0),
t AS (SELECT CAST(sum(n) AS BIGINT) AS total, sum(w) AS weight FROM s),
levels AS (SELECT a.r, a.most / a.w AS fills, CAST(t.total - (SELECT coalesce(sum(b.most), 0) FROM s b WHERE b.most / b.w < a.most / a.w) AS DOUBLE)
  / (t.weight - (SELECT coalesce(sum(b.w), 0) FROM s b WHERE b.most / b.w < a.most / a.w)) AS level FROM s a, t),
cut AS (SELECT arg_min(level, fills) AS level FROM levels WHERE fills >= level),
g AS (SELECT s.*, least(w * level, CAST(most AS DOUBLE)) AS target FROM s, cut),
house AS (SELECT CAST(round(sum(target) / 64) AS BIGINT) AS seats FROM g),
ends AS (SELECT h, CAST(floor(seats * (h + 1) / 16) AS BIGINT) AS upto, CAST(floor(seats * h / 16) AS BIGINT) AS since FROM house, (SELECT unnest(range(0, 16)) AS h)),
won AS (SELECT r, h, count(*) AS blocks FROM (SELECT r, row_number() OVER (ORDER BY target / (2 * i + 1) DESC, r) AS place FROM (SELECT r, target, unnest(range(0, seats)) AS i FROM g, house WHERE target > 0)) JOIN ends ON place > since AND place <= upto GROUP BY 1, 2),
runs AS (SELECT r, h, CAST(64 * (sum(blocks) OVER o - blocks) AS BIGINT) AS lo, CAST(64 * sum(blocks) OVER o AS BIGINT) AS hi FROM won WINDOW o AS (PARTITION BY r ORDER BY h)),
o AS (SELECT d.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
parts AS (SELECT o.doc_id, runs.h, CAST(sum(greatest(0, least(runs.hi, g.most, i * g.n + o.before + o.size) - greatest(runs.lo, i * g.n + o.before))) AS BIGINT) AS words
  FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source JOIN runs USING (r), (SELECT unnest(range(0, 3)) AS i) GROUP BY 1, 2),
per AS (SELECT doc_id, CAST(sum(words) AS BIGINT) AS taken, string_agg(h || ':' || words, ',' ORDER BY h) AS shard_words FROM parts WHERE words > 0 GROUP BY 1)
SELECT o.doc_id, o.size, g.n AS source_size, g.target, coalesce(taken, 0) AS taken, coalesce(shard_words, '') AS shard_words
FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source LEFT JOIN per ON per.doc_id IS NOT DISTINCT FROM o.doc_id"""


@query("op9_mixing", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from petrichor.llm.mixing import mix_by_shard

    mixed = mix_by_shard(documents(spark, sf_dir).select("doc_id", "text", "source"))
    listed = F.array_join(F.transform("shards", lambda x: F.concat_ws(":", x["shard"], x["words"])), ",")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", listed.alias("shard_words"))


OP5_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS first_id FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', CAST(4 * strpos('0123456789abcdef', substr(x, CAST(i AS INTEGER), 1)) - 3 AS INTEGER), 4)), '') AS bits FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(0, 5), lambda j: (16 >> j) * CAST(substr(bits, CAST(5 * i + j + 1 AS INTEGER), 1) AS INTEGER))) AS INTEGER), 1)), '') AS payload_digest,
 CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM b"""


@query("op5_warc", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from petrichor.llm import warc

    files = warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    records = warc.records_of(warc.read_chunks(files)).withColumnRenamed("record_id", "page_id")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_token_sequences")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from petrichor.llm import sequences

    manifest = sequences.write_token_files(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))
    return sequences.read_documents(manifest)


@query("op7_minhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from petrichor.llm.minhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), words=2)


OP4_SQL = r"""WITH n AS (SELECT item_id AS id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark),
i AS (SELECT id, w, len(w) AS n, least(len(w), 5) AS k FROM n WHERE w <> ['']),
ish AS (SELECT id, n, k, o, array_to_string(w[o + 1 : o + k], ' ') AS g FROM (SELECT *, unnest(range(0, n - k + 1)) AS o FROM i)),
d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
dsh AS (SELECT doc_id, k, p, array_to_string(w[p + 1 : p + k], ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM ish))),
hit AS (SELECT DISTINCT doc_id, p, k, o, n, len(w) AS l FROM dsh JOIN ish USING (g, k) JOIN d USING (doc_id)),
wn AS (SELECT doc_id, greatest(p - o, 0) AS a, least(p - o + n, l) AS z FROM hit UNION SELECT doc_id, 0, l FROM hit WHERE l < n
  UNION SELECT doc_id, a, a + n FROM (SELECT DISTINCT doc_id, n, unnest(range(greatest(p + k - n, 0), least(p, l - n) + 1)) AS a FROM (SELECT DISTINCT doc_id, p, k, n, l FROM hit WHERE l >= n))),
wsh AS (SELECT doc_id, a, z, k, array_to_string(w[p + 1 : p + k], ' ') AS g FROM (SELECT wn.*, w, k, unnest(range(a, z - k + 1)) AS p FROM wn JOIN d USING (doc_id), (SELECT DISTINCT k FROM ish))),
wc AS (SELECT doc_id, a, z, k, g, count(*) AS c FROM wsh GROUP BY ALL), ws AS (SELECT doc_id, a, z, k, sum(c) AS size FROM wc GROUP BY ALL),
ic AS (SELECT id, k, g, count(*) AS c FROM ish GROUP BY ALL), isz AS (SELECT id, sum(c) AS size FROM ic GROUP BY 1),
m AS (SELECT doc_id, id, a, z, k, sum(least(wc.c, ic.c)) AS same FROM wc JOIN ic USING (k, g) GROUP BY ALL),
s AS (SELECT doc_id, id, CAST(same AS DOUBLE) / CAST(ws.size + isz.size - same AS DOUBLE) AS sim FROM m JOIN ws USING (doc_id, a, z, k) JOIN isz USING (id)),
f AS (SELECT doc_id, list_sort(list(DISTINCT id)) AS item_ids, max(sim) AS similarity FROM s WHERE sim >= 0.8 GROUP BY 1)
SELECT doc_id, item_ids IS NOT NULL AS contaminated, CAST(coalesce(len(item_ids), 0) AS BIGINT) AS n_items, coalesce(item_ids, []) AS item_ids, similarity FROM documents LEFT JOIN f USING (doc_id)"""


@query("op4_decontamination", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from petrichor.llm.decontamination import contamination

    return contamination(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""WITH l0 AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t, CASE WHEN t <> '' THEN string_split(t, ' ') ELSE [] END AS w FROM l0),
u AS (SELECT w, len(w) AS n, min(doc_id * 1000000 + line_no) AS spot FROM l WHERE len(w) > 0 GROUP BY 1),
v AS (SELECT w, n, spot, i, array_to_string(w[1 : i] || w[i + 2 : n], ' ') AS rest FROM (SELECT *, unnest(range(0, n)) AS i FROM u WHERE n >= 7)),
near AS (
 SELECT w, min(m) AS lead_at FROM (SELECT w, spot, n, min(spot) OVER (PARTITION BY rest, n, i) AS m FROM v WHERE n >= 8) WHERE m < spot GROUP BY 1
 UNION ALL SELECT v.w, min(u.spot) FROM v JOIN u ON u.n = v.n - 1 AND array_to_string(u.w, ' ') = v.rest WHERE v.n >= 8 AND u.spot < v.spot GROUP BY 1
 UNION ALL SELECT u.w, min(v.spot) FROM v JOIN u ON u.n = v.n - 1 AND array_to_string(u.w, ' ') = v.rest WHERE v.n >= 8 AND v.spot < u.spot GROUP BY 1),
k AS (SELECT l.*, len(l.w) > 0 AND (l.doc_id * 1000000 + l.line_no <> u.spot OR l.w IN (SELECT w FROM near)) AS gone FROM l LEFT JOIN u USING (w))
SELECT d.doc_id, count(k.line_no) AS n_lines, count(*) FILTER (gone) AS n_dropped, CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(k.line, chr(10) ORDER BY k.line_no) FILTER (NOT gone), '') END AS text
FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id, d.text"""


@query("op3_line_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from petrichor.llm.line_dedup import line_dedup

    return line_dedup(documents(spark, sf_dir).select("doc_id", "text"))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from petrichor.llm import language_id

    docs = documents(spark, sf_dir)
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.learn(docs.filter(~out), text_col="text", lang_col="lang")
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "languages", "shares")


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from petrichor.llm import quality_rules
    from petrichor.llm.common import written
    from petrichor.llm.language_id import held_out

    stats = quality_rules.statistics(F.col("text"))
    rows = written(documents(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in stats.items()]), "statistics")
    out = held_out(F.col("doc_id"), 3, 1)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter(~out)
    model = quality_rules.fit(quality_rules.training_rows(rows, labels, id_col="doc_id", label="quality"), list(stats))
    scored = rows.select("doc_id", out.alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op1_main_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from petrichor.llm.site_style import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


@query("op11_simhash")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from petrichor.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a short ASCII text, bit by bit: DuckDB has no such function."""
    bits = "list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))"
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda c, b: {bits}), CAST(4294967295 AS BIGINT))"


def merkle_sql(levels: int = 7, group_levels: int = 3) -> str:
    """A tree level per pair of tables; enough for 8 ** levels documents of a language and 8 ** group_levels languages."""

    def tree(p: str, n: int) -> list[str]:
        out = []
        for k in range(n):
            run = "PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN"
            out.append(
                f"{p}s{k} AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) > 1 AS up, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                f"coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {p}{k})"
            )
            out.append(f"{p}{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN bool_and(up) THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h FROM {p}s{k} GROUP BY 1, 2)")
        return out

    def walk(p: str, n: int, start: str, at: str, g: str) -> list[str]:
        out, before = [], start
        for k in range(n):
            fold = "CASE WHEN s.up THEN sha256(s.l || f || s.r) ELSE f END"
            out.append(f"{p}w{k} AS (SELECT w.* EXCLUDE (f, proof), {fold} AS f, proof || s.l || s.r AS proof FROM {before} w JOIN {p}s{k} s ON s.g = w.{g} AND s.i = w.{at} // {8**k})")
            before = f"{p}w{k}"
        return out

    fields = lambda text: " || ".join(
        f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)
    )
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tables = [
        "lg AS (SELECT lang AS name, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM documents))",
        f"d AS (SELECT doc_id, g, sha256({fields('text')}) AS h, CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN sha256({fields(lower)}) END AS other FROM documents JOIN lg ON lang IS NOT DISTINCT FROM name)",
        "o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d)",
        "t0 AS (SELECT g, i, h FROM o)",
        *tree("t", levels),
        f"u0 AS (SELECT 0 AS g, g AS i, h FROM t{levels})",
        *tree("u", group_levels),
        "a AS (SELECT o.*, 0 AS z, coalesce(other, h) AS f, '' AS proof FROM o)",
        *walk("t", levels, "a", "i", "g"),
        *walk("u", group_levels, f"tw{levels - 1}", "g", "z"),
    ]
    last = f"uw{group_levels - 1}"
    return (
        "WITH " + ",\n".join(tables) + f"\nSELECT w.doc_id, w.h AS leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified "
        f"FROM {last} w JOIN t{levels} s USING (g), u{group_levels} r"
    )


@query("op12_merkle_manifest", merkle_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from petrichor.llm import merkle

    mark = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    found = merkle.manifest(documents(spark, sf_dir).select(*merkle.LEAF), tampered=mark)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


OP13_SQL = (
    r"""WITH RECURSIVE p AS (SELECT conv_id, turn, coalesce(role, ' ') AS r0, coalesce(text, ' ') AS t0, """
    + crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    + r""" % 20 AS c FROM conversations),
m AS (SELECT conv_id, turn, CASE c WHEN 4 THEN 'user' ELSE r0 END AS role, CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t0, '[.!?]', '', 'g') ELSE t0 END AS text,
 unnest(range(CASE c WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last FROM m),
f AS (SELECT *, left(role, 1) AS x, CASE WHEN last = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
 count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
 FROM (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS pair FROM f) GROUP BY conv_id),
nxt AS (SELECT * FROM (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')) AS n0(p, q, role)),
ins AS (SELECT p, p AS q, 0 AS c, '' AS a, '' AS l FROM nxt UNION ALL SELECT p, q, 2, 'I', chr(10) || role || ':' FROM nxt
 UNION ALL SELECT x.p, y.q, 4, 'II', chr(10) || x.role || ':' || chr(10) || y.role || ':' FROM nxt x JOIN nxt y ON x.q = y.p),
best AS (
 SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS q, {'c': CAST(0 AS BIGINT), 'a': '', 'l': ''} AS w FROM (SELECT DISTINCT conv_id FROM conversations)
 UNION ALL
 SELECT conv_id, i, q, min(w) AS w FROM (
  SELECT b.conv_id, f.i, mv.q, {'c': CAST(b.w.c + ins.c + mv.c + CASE WHEN f.fault = 't' AND mv.a <> 'D' THEN 1 ELSE 0 END AS BIGINT), 'a': b.w.a || ins.a || mv.a,
   'l': b.w.l || ins.l || CASE mv.a WHEN 'D' THEN '' WHEN 'R' THEN chr(10) || mv.role || ':' || f.text ELSE chr(10) || f.role || ':' || f.text END} AS w
  FROM best b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1 JOIN ins ON ins.p = b.q
  JOIN (SELECT p, p AS q, 3 AS c, 'D' AS a, '' AS role, '' AS x FROM nxt UNION ALL SELECT p, q, 2, 'R', role, '' FROM nxt UNION ALL SELECT p, q, 0, 'K', '', q FROM nxt UNION ALL SELECT '', 's', 0, 'K', '', 's') mv
   ON mv.p = ins.q AND (mv.a = 'D' OR f.fault NOT IN ('b', 'd')) AND (mv.a <> 'K' OR mv.x = f.x)) GROUP BY conv_id, i, q),
z AS (SELECT b.conv_id, min({'c': b.w.c + ins.c, 'a': b.w.a || ins.a, 'l': b.w.l || ins.l}) AS w FROM best b LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM b.conv_id JOIN ins ON ins.p = b.q
 WHERE b.i = coalesce(g.n, 0) AND ins.q IN ('', 'a') GROUP BY b.conv_id)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 CAST(z.w.c AS BIGINT) AS cost, z.w.a AS audit, sha256(substr(z.w.l, 2)) AS repaired_sha256 FROM z LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM z.conv_id"""
)


@query("op13_conversation_repair", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from petrichor.llm import conversations

    return conversations.repair(conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
