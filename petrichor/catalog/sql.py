"""DuckDB counterparts of ``petrichor.plans.views`` (common table expressions) for the oracle texts."""

BIN = "(DATE '2024-01-16' + CAST(5*(floor(date_diff('day', DATE '2024-01-16', CAST(t AS DATE))/5.0)+1) AS INTEGER))"

EV = """ev AS (SELECT event_id AS id, event_type AS cube, user_id AS px, ts AS t, value AS v,
 CAST(json_extract_string(props,'$.k') AS INTEGER) AS k, CASE WHEN k < 90 THEN k % 12 END AS scl, k % 15 AS cloud FROM events)"""
EVM = EV + """, evm AS (SELECT *,
 CASE WHEN coalesce(scl IN (0,1,2), false) OR coalesce(cloud IN (1,2,3), false) THEN 0 ELSE 1 END AS mask_basic,
 CASE WHEN mask_basic = 1 AND NOT coalesce(scl IN (3,8,9,10), false) THEN 1 ELSE 0 END AS mask_strict FROM ev)"""
EV5 = EVM + f""", ev5 AS (SELECT cube, px, {BIN} AS bin, median(CASE WHEN mask_strict = 1 THEN v END) AS v, count(*) AS n
 FROM evm GROUP BY ALL)"""
EVG = EV5 + """, span AS (SELECT cube, min(bin) a, max(bin) z FROM ev5 GROUP BY 1),
 full_grid AS (SELECT p.cube, p.px, CAST(unnest(generate_series(a, z, INTERVAL 5 DAY)) AS DATE) AS bin FROM (SELECT DISTINCT cube, px FROM ev5) p JOIN span USING (cube)),
 evg AS (SELECT f.cube, f.px, f.bin, e.v, e.n FROM full_grid f LEFT JOIN ev5 e USING (cube, px, bin))"""

IMG = """img AS (SELECT label AS cube, vec_id AS t, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x,
 CASE WHEN CAST(embedding[p+1] AS DOUBLE) >= -0.2 THEN CAST(embedding[p+1] AS DOUBLE) END AS v
 FROM embeddings, (SELECT unnest(range(64)) AS p))"""
BANDS = "bands AS (SELECT label AS cube, vec_id AS t, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x, " + ", ".join(
    f"14000.0::DOUBLE * (0.3::DOUBLE + CAST(embedding[(p+{s})%64+1] AS DOUBLE)) AS {b}"
    for b, s in {"B03": 0, "B04": 5, "B05": 11, "B06": 17, "B07": 23, "B08": 29, "B11": 37, "B12": 47}.items()
) + " FROM embeddings, (SELECT unnest(range(64)) AS p))"
CLEAN = BANDS + ", clean AS (SELECT cube, t, y, x, " + ", ".join(
    f"greatest(0.0::DOUBLE, least(10000.0::DOUBLE, {b}))/10000.0 AS {b}" for b in ["B03", "B04", "B05", "B06", "B07", "B08", "B11", "B12"]
) + " FROM bands)"
INDEX = {
    "NDVI": "(B08-B04)/nullif(B08+B04,0)",
    "kNDVI": "tanh(pow((B08-B04)/nullif(B08+B04,0),2))",
    "NIRv": "(B08-B04)/nullif(B08+B04,0)*B08",
    "NDMI": "(B08-B11)/nullif(B08+B11,0)",
    "NDWI": "(B03-B08)/nullif(B03+B08,0)",
    "IRECI": "(B07-B04)/nullif(B05/nullif(B06,0),0)",
    "CIRE": "B08/nullif(B05,0)-1",
}

PRED = """steps AS (SELECT label || '-' || (vec_id // 60) AS cube_id, CAST(row_number() OVER w AS INTEGER) AS step, embedding AS tv,
 lead(embedding) OVER w AS pv, first_value(embedding) OVER w AS bv FROM embeddings WINDOW w AS (PARTITION BY label, vec_id // 60 ORDER BY vec_id)),
 px0 AS (SELECT cube_id, step, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x, CAST(pv[p+1] AS DOUBLE) AS pred, CAST(tv[p+1] AS DOUBLE) AS tru, CAST(bv[p+1] AS DOUBLE) AS base
 FROM steps, (SELECT unnest(range(64)) AS p)),
 px AS (SELECT *, CASE WHEN tru > -0.15::DOUBLE THEN 1 ELSE 0 END AS mask, CASE WHEN base > -0.2::DOUBLE THEN 1 ELSE 0 END AS is_veg,
 [10,20,30,40,50,60,70,80,90,95,100,0][CAST(greatest(0, least(11, floor((base + 0.6::DOUBLE) * 10))) AS INTEGER) + 1] AS esa_lc,
 (mask = 1 AND pred IS NOT NULL) AS ok FROM px0)"""

CT = """ct0 AS (SELECT o_custkey AS ck, o_orderpriority AS configuration, avg(o_totalprice/123457.0::DOUBLE) AS mae, max(o_totalprice/123457.0::DOUBLE) AS mae_base,
 avg(o_totalprice/123457.0::DOUBLE * (o_totalprice/123457.0::DOUBLE)) AS mse, max(o_totalprice/123457.0::DOUBLE)*min(o_totalprice/123457.0::DOUBLE) + 0.01::DOUBLE AS mse_base,
 avg(o_totalprice/123457.0::DOUBLE)-min(o_totalprice/123457.0::DOUBLE) AS bias, sum(o_totalprice/123457.0::DOUBLE) AS total FROM orders GROUP BY 1,2),
 ct AS (SELECT CAST(ck AS VARCHAR) AS cube_id, configuration, CAST(ck % 3 AS INTEGER) AS fold,
 CASE WHEN configuration IN ('1-URGENT','2-HIGH') THEN 'alpha' WHEN configuration IN ('4-NOT SPECIFIED','5-LOW') THEN 'beta' END AS architecture,
 CASE WHEN configuration IN ('1-URGENT','4-NOT SPECIFIED') THEN 'bands' WHEN configuration IN ('2-HIGH','5-LOW') THEN 'indices' END AS optical_input,
 mae, mae_base, mse, mse_base, bias, mae_base-mae AS mae_gain, 1-mse/mse_base AS mse_skill, CASE WHEN mae < 3.2 THEN 1/(1+mae) END AS nnse, CASE WHEN mae < 3.2 THEN 1/(2+mae) END AS nnse_base,
 CASE WHEN mae < 3.2 THEN 1 ELSE 0 END AS nnse_eligible, CASE WHEN mse < mse_base THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS persistence_beaten,
 CASE WHEN bias > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r30_direction_match, total-5.0::DOUBLE AS observed_r30, mse-mae*mae AS target_variance, 1/(1+total) AS spatial_valid_fraction FROM ct0)"""

META = """meta AS (SELECT c_custkey AS cube, n_name AS location, c_mktsegment AS season, r_name AS climate, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def hash32(*parts: str) -> str:
    """Integer draw of ``petrichor.functions.scalar.draw`` before the modulo."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


def order_hash(seed, *unique: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(unique)}))"
