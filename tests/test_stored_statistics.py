"""Stored bin counts: refreshing equals recomputing, percentiles keep their bound, unfinished batches don't count."""

import numpy as np
import pytest

from petrichor.session import shared_folder
from petrichor.sources import statistics

KEYS = dict(cube="cube", keys=["var"], value="v", width=0.5)


@pytest.fixture(scope="module")
def cubes(spark):
    rng = np.random.default_rng(5)
    cube = np.where(rng.random(6000) < 0.33, 0, rng.integers(1, 40, 6000))  # one cube holds a third
    rows = [(int(c), "ab"[int(c) % 2], float(x)) for c, x in zip(cube, rng.normal(0, 30, 6000))]
    rows += [(3, "b", None), (3, "b", float("nan")), (4, "a", float("inf")), (None, "a", 1e6), (5, "only null", None), (6, None, 2.0)]
    return spark.createDataFrame(rows, "cube int, var string, v double").cache()


def found(spark, path):
    counts = statistics.stored_counts(spark, path, width=0.5)
    return {tuple(r) for r in statistics.percentiles(counts, keys=["var"], width=0.5, probs=[0.001, 0.5, 1.0]).collect()}


def test_refreshed_equals_recomputed_and_keeps_its_bound(spark, cubes):
    path, whole = shared_folder(spark, "stats"), shared_folder(spark, "stats")
    assert statistics.stored_counts(spark, path, width=0.5) is None
    assert statistics.refresh(cubes.filter("cube < 7"), path, **KEYS) == 7
    assert statistics.refresh(cubes, path, **KEYS) == 33
    assert statistics.refresh(cubes, path, **KEYS) == 0
    statistics.refresh(cubes, whole, **KEYS)
    got = found(spark, path)
    assert got == found(spark, whole)
    assert {r[0] for r in got} == {"a", "b", None}
    rows = cubes.filter("cube IS NOT NULL AND NOT isnan(v) AND abs(v) < 1e300").collect()
    for var, n, *ps in got:
        values = [r.v for r in rows if r["var"] == var]
        assert n == len(values)
        assert np.abs(np.quantile(values, [0.001, 0.5, 1.0]) - ps).max() <= 0.25 + 1e-9


def test_unfinished_batch_and_other_width(spark, cubes):
    path = shared_folder(spark, "stats")
    statistics.refresh(cubes.filter("cube < 7"), path, **KEYS)
    before = found(spark, path)
    # a refresh that died before its commit row
    cubes.filter("cube = 9").select("cube").distinct().write.parquet(f"{path}/cubes/batch=bdead")
    statistics.bin_counts(cubes.filter("cube = 9"), keys=["var"], value="v", width=0.5).write.parquet(f"{path}/bins/batch=bdead")
    assert found(spark, path) == before
    assert statistics.refresh(cubes.filter("cube = 9"), path, **KEYS) == 1
    assert found(spark, path) != before
    with pytest.raises(ValueError, match="width"):
        statistics.refresh(cubes, path, **KEYS | {"width": 1.0})


def test_empty_table(spark, cubes):
    path = shared_folder(spark, "stats")
    assert statistics.refresh(cubes.limit(0), path, **KEYS) == 0
    assert statistics.stored_counts(spark, path, width=0.5) is None
