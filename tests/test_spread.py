"""Operators that spread one hot cube, image or group over tasks: same results as plain versions, whatever the cut."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from petrichor.operators import climate, folds, metrics, order_stats, radar, tiles
from petrichor.session import clear_scratch, scratch_root, stored


def test_nearest_in_time_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    t0 = dt.datetime(2024, 1, 1)
    at = lambda h: t0 + dt.timedelta(hours=float(h))
    left = [(i, None if i % 50 == 0 else "hot" if i % 3 else f"c{i % 4}", None if i % 41 == 0 else at(rng.integers(0, 24 * 90))) for i in range(600)]
    right = [("hot" if i % 3 else f"c{i % 4}" if i % 7 else None, at(rng.integers(0, 24 * 90)), float(i)) for i in range(500)]
    l, r = spark.createDataFrame(left, "id int, c string, t timestamp"), spark.createDataFrame(right, "c string, rt timestamp, v double")
    for direction in ("nearest", "backward", "forward"):
        got = {x.id: (x.matched_time, x.v) for x in climate.nearest_in_time(l, r, cube=["c"], time="t", right_time="rt", values=["v"], tolerance_days=1, direction=direction).collect()}
        assert len(got) == len(left)
        for i, c, t in left:
            best = None
            for rc, rt, v in right:
                if c is None or t is None or rc != c or abs(rt - t) > dt.timedelta(days=1):
                    continue
                if direction == "backward" and rt > t or direction == "forward" and rt < t:
                    continue
                key = (-abs(rt - t), rt, v)
                best = max(best, (key, (rt, v))) if best else (key, (rt, v))
            assert got[i] == (best[1] if best else (None, None)), (direction, i)
    with pytest.raises(ValueError, match="direction"):
        climate.nearest_in_time(l, r, cube=["c"], time="t", right_time="rt", values=["v"], direction="sideways")


def test_blocks_dont_change_a_stencil(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(2, 13, 11))
    rows = [(t, y, x, None if rng.random() < 0.1 else float(v[t, y, x])) for t in range(2) for y in range(13) for x in range(11)]
    df = spark.createDataFrame(rows, "t int, y int, x int, v double")
    lee = lambda b: {(r.t, r.y, r.x): r.v_lee for r in radar.lee_filter(df, image=["t"], y="y", x="x", value="v", size=5, block=b).collect()}
    whole = lee(100)
    assert len(whole) == len(rows)
    for b in (1, 3, 7):
        cut = lee(b)
        assert cut.keys() == whole.keys()
        assert all((a is None) == (whole[k] is None) and (a is None or abs(a - whole[k]) < 1e-12) for k, a in cut.items())

    px = df.withColumns({"true": F.coalesce("v", F.lit(0.0)), "pred": F.coalesce("v", F.lit(0.0)) * 0.9 + 0.1, "base": F.lit(0.0), "mask": F.col("v").isNotNull().cast("int"), "cube": F.lit("c"), "step": F.col("t")})
    px = px.filter("NOT (y = 6 AND x = 6)")  # a hole: its neighbours have no gradient there, in any block
    errors = [metrics.gradient_errors(px, cube=["cube"], block=b).first() for b in (100, 1, 2, 5)]
    for e in errors[1:]:
        assert all(abs(a - w) < 1e-12 for a, w in zip(e, errors[0]))


def test_gradient_errors_against_numpy(spark):
    rng = np.random.default_rng(8)
    true, pred = rng.normal(size=(6, 7)), rng.normal(size=(6, 7))
    mask = rng.random((6, 7)) < 0.8
    rows = [("c", 1, y, x, float(true[y, x]), float(pred[y, x]), int(mask[y, x]), 0.0) for y in range(6) for x in range(7)]
    df = spark.createDataFrame(rows, "cube string, step int, y int, x int, true double, pred double, mask int, base double")
    got = metrics.gradient_errors(df, cube=["cube"], block=3).first()
    grad = 0.0
    for axis in (0, 1):
        d = np.abs(np.diff(pred, axis=axis) - np.diff(true, axis=axis))
        m = mask[:-1] if axis == 0 else mask[:, :-1]
        grad += (d * m).sum() / (m.sum() + 1e-8)
    assert abs(got.gradient_error - grad) < 1e-9


def test_group_percentiles_of_equal_rows(spark):
    """40,000 equal rows in one group: routed by their count, not by what they hold."""
    df = spark.range(40_000).select(F.lit("hot").alias("g"), F.lit(2.5).alias("v")).unionByName(spark.range(101).select(F.lit("cold").alias("g"), F.col("id").cast("double").alias("v")))
    df = df.unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS g, CAST(NULL AS DOUBLE) AS v FROM range(20000)"))
    for task_rows in (10_000, 2_000_000):
        got = {r.g: (r.v_p0, r.v_p1, r.n) for r in order_stats.group_percentiles(df, ["g"], ["v"], [0.1, 0.5], [F.count(F.lit(1)).alias("n")], task_rows=task_rows).collect()}
        assert got == {"hot": (2.5, 2.5, 40_000), "cold": (10.0, 50.0, 101), None: (None, None, 20_000)}


def test_ranked_in_order(spark):
    rng = np.random.default_rng(1)
    data = [(None if i % 9 == 0 else "hot" if i % 3 else "b", int(rng.integers(0, 10**6))) for i in range(3000)]
    got = order_stats.ranked_in_order(spark.createDataFrame(data, "k string, v int"), ["k"], ["v"], out="r", size="n").collect()
    for key in {k for k, _ in data}:
        want = sorted(v for k, v in data if k == key)
        own = sorted((r.r, r.v, r.n) for r in got if r.k == key)
        assert own == [(i, v, len(want)) for i, v in enumerate(want)]


@pytest.mark.parametrize("k", [1, 3, 5])
def test_group_folds_are_the_greedy_ones(spark, k):
    rng = np.random.default_rng(k)
    sizes = [int(n) for n in rng.choice([1, 1, 1, 2, 2, 3, 5, 8, 40], 120)] + [500]
    df = spark.createDataFrame([(f"g{i:03d}",) for i, n in enumerate(sizes) for _ in range(n)], "g string")
    got = dict(map(tuple, folds.balanced_group_folds(df, group=["g"], k=k).select("g", "fold").distinct().collect()))
    loads = [0] * k
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        f = loads.index(min(loads))
        assert got[f"g{i:03d}"] == f
        loads[f] += sizes[i]


def test_stratified_patches_of_several_cubes(spark):
    """Against the walk, corner by corner; one cube has more classes than patches."""
    rng = np.random.default_rng(9)
    data = [(c, y, x, int(rng.choice([10, 20, 30, 40, 60, 50]))) for c in ("a", "b") for y in range(20) for x in range(16) if c == "a" or y < 9]
    df = spark.createDataFrame(data, "cube string, y int, x int, code int")
    for overlap, n in ((0.05, 12), (0.3, 4)):
        got = tiles.stratified_patches(df, cube=["cube"], y="y", x="x", code="code", n_patches=n, patch=4, height=20, width=16, max_overlap=overlap, seed=2)
        got = sorted(tuple(r) for r in got.select("cube", "patch_no", "code", "top", "left").collect())
        quota = {(r.cube, r.code): r.n_patches for r in tiles.patch_allocation(df, cube=["cube"], code="code", n_patches=n).collect()}
        want = []
        for cube in ("a", "b"):
            chosen = []
            for code in (10, 20, 30, 40, 60):
                taken = 0
                pool = sorted((hashlib.md5(f"2|{y}|{x}".encode()).hexdigest(), y, x) for c, y, x, k in data if (c, k) == (cube, code))
                for _, y, x in pool:
                    if len(chosen) >= n or taken >= quota[cube, code]:
                        break
                    top, left = min(max(y - 2, 0), 16), min(max(x - 2, 0), 12)
                    if all(max(0, 4 - abs(top - a)) * max(0, 4 - abs(left - b)) <= 16 * overlap for a, b in chosen):
                        chosen.append((top, left))
                        taken += 1
                        want.append((cube, len(chosen), code, top, left))
        assert got == sorted(want)


def test_retry_on_other_cubes(spark):
    rows = [(i, 0, i, i, "resample" if i % 4 else "accepted") if i % 4 == 0 else (i, None, None, None, "resample") for i in range(40)]
    chosen = spark.createDataFrame(rows, "cube int, attempt int, top int, left int, how string")
    out = {r.cube: r for r in tiles.retry_on_other_cubes(chosen, cube=["cube"], attempts=3, seed=1).collect()}
    assert len(out) == 40
    assert all(r.how == "accepted" and r.from_cube % 4 == 0 and r.top == r.from_cube for r in out.values())
    assert all((r.cube_attempt == 0) == (c % 4 == 0) and r.cube_attempt <= 3 for c, r in out.items())
    assert len({r.from_cube for c, r in out.items() if c % 4}) > 3  # spread over the cubes
    none = tiles.retry_on_other_cubes(chosen.filter("how = 'resample'"), cube=["cube"], attempts=3, seed=1).collect()
    assert len(none) == 30 and all(r.how == "resample" and r.from_cube is None for r in none)
    assert tiles.retry_on_other_cubes(chosen, cube=["cube"], attempts=1, seed=1).filter("how = 'resample'").count() == 0


def test_scratch_has_one_root(spark):
    kept = stored(spark.range(3), "a-table")
    folder = scratch_root(spark).rsplit("/", 1)[1]
    assert kept.inputFiles() and all(f"/{folder}/a-table" in f for f in kept.inputFiles())
    assert clear_scratch(spark)
