import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from petrichor.operators.order_stats import average_ranks, group_percentiles, numbered, ranked_percentiles


@pytest.fixture(scope="module")
def skewed(spark):
    """Group 'a' holds most rows, many ties, NULL values and a NULL group."""
    rng = np.random.default_rng(3)
    n = 6000
    g = np.where(rng.random(n) < 0.8, "a", rng.choice(["b", "c", "d"], n)).astype(object)
    g[:40] = None
    v = np.round(rng.lognormal(0, 2, n), 1).astype(object)
    v[rng.random(n) < 0.1] = None
    pdf = pd.DataFrame({"id": range(n), "g": g, "v": v})
    return pdf, spark.createDataFrame(pdf, "id long, g string, v double").repartition(4)


def expected(pdf, probs):
    out = {}
    for key, part in pdf.assign(g=pdf.g.fillna("none")).groupby("g"):
        out[key] = np.quantile(part.v.dropna().astype(float), probs)
    return out


@pytest.mark.parametrize("accuracy", [100, 1000, 100_000])
def test_ranked_percentiles(skewed, accuracy):
    pdf, df = skewed
    probs = [0.0001, 0.05, 0.5, 0.995, 0.9999]
    got = {r.g or "none": [r[f"p{i}"] for i in range(5)] for r in ranked_percentiles(df, ["g"], "v", probs, accuracy).collect()}
    want = expected(pdf, probs)
    assert got.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(got[k], want[k])


def test_global_percentiles(skewed):
    pdf, df = skewed
    row = ranked_percentiles(df, [], "v", [0.3, 0.9], 200).collect()
    assert len(row) == 1
    np.testing.assert_allclose(list(row[0]), np.quantile(pdf.v.dropna().astype(float), [0.3, 0.9]))


@pytest.mark.parametrize("hot", [100, 1500, 10**9])
def test_group_percentiles_hot_and_cold_agree(skewed, hot):
    pdf, df = skewed
    got = group_percentiles(df, ["g"], ["v"], [0.5], [F.count(F.lit(1)).alias("n")], task_rows=hot).collect()
    want = expected(pdf, [0.5])
    assert sorted(r.g or "none" for r in got) == sorted(want)
    for r in got:
        np.testing.assert_allclose(r.v_p0, want[r.g or "none"][0])
        assert r.n == (pdf.g.fillna("none") == (r.g or "none")).sum()


@pytest.mark.parametrize("digits", [1, 4])
def test_numbered_is_a_permutation(skewed, digits):
    pdf, df = skewed
    got = numbered(df, ["g"], ["id"], seed=7, size="n", digits=digits).toPandas()
    assert len(got) == len(pdf)
    for _, part in got.assign(g=got.g.fillna("none")).groupby("g"):
        assert sorted(part.idx) == list(range(len(part)))
        assert (part.n == len(part)).all()
    again = numbered(df.repartition(7), ["g"], ["id"], seed=7, digits=2).toPandas()
    assert dict(zip(got.id, got.idx)) == dict(zip(again.id, again.idx))


def test_first_n(skewed):
    pdf, df = skewed
    full = numbered(df, ["g"], ["id"]).filter("idx < 50").toPandas()
    part = numbered(df, ["g"], ["id"], first_n=50, digits=2).toPandas()
    assert sorted(full.id) == sorted(part.id)


def test_average_ranks(skewed):
    pdf, df = skewed
    got = average_ranks(df, "v").toPandas().set_index("id").avg_rank.sort_index()
    want = pdf.v.astype(float).rank(method="average")
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy())
