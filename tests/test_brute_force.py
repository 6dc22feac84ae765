"""Operators without a SQL oracle, and scale-minded rewrites, against brute force on small fixtures."""

import hashlib
import itertools
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from petrichor.catalog import load
from petrichor.functions import labels as L
from petrichor.operators import climate, folds, meta, metrics, scoring, selection, stats, tiles


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(11)


def test_stratified_patches(spark):
    rng = np.random.default_rng(5)
    codes = rng.choice([10, 30, 40, 50], (12, 12), p=[0.5, 0.3, 0.1, 0.1])
    data = [("c", y, x, int(codes[y, x])) for y in range(12) for x in range(12)]
    df = spark.createDataFrame(data, "cube string, y int, x int, code int")
    for overlap in (0.05, None):
        got = tiles.stratified_patches(df, cube=["cube"], y="y", x="x", code="code", n_patches=8, patch=3, height=12, width=12, max_overlap=overlap, seed=3).toPandas()
        quota = {r.code: r.n_patches for r in tiles.patch_allocation(df, cube=["cube"], code="code", n_patches=8).collect()}
        assert set(quota) == {10, 30, 40}
        import hashlib

        chosen, want = [], []
        for code in sorted(quota):
            pool = sorted((hashlib.md5(f"3|{y}|{x}".encode()).hexdigest(), y, x) for _, y, x, c in data if c == code)
            taken = 0
            for _, y, x in pool:
                if taken >= quota[code] or len(chosen) >= 8:
                    break
                top, left = min(max(y - 1, 0), 9), min(max(x - 1, 0), 9)
                if overlap is None:
                    clash = (top, left) in chosen
                else:
                    clash = any(max(0, 3 - abs(top - a)) * max(0, 3 - abs(left - b)) > 9 * overlap for a, b in chosen)
                if not clash:
                    chosen.append((top, left))
                    want.append((code, top, left))
                    taken += 1
        assert [tuple(r) for r in got.sort_values("patch_no")[["code", "top", "left"]].itertuples(index=False)] == want


def test_stitch_of_cut_is_identity(spark):
    data = [("c", t, y, x, float(t * 100 + y * 10 + x)) for t in range(2) for y in range(7) for x in range(7)]
    df = spark.createDataFrame(data, "cube string, step int, y int, x int, v double")
    cut = tiles.cut_tiles(df, dim=7, patch=3).withColumns({c: F.col("v") for c in ("pred", "true", "base")}).withColumn("mask", F.lit(1))
    back = tiles.stitch(cut, cube=["cube"])
    assert back.count() == len(data)
    assert back.join(df, ["cube", "step", "y", "x"]).filter("abs(pred - v) > 1e-12 or `true` <> v or base <> v").count() == 0
    full = tiles.completeness(cut, cube=["cube"], expected_tiles=9, height=7, width=7).first()
    assert (full.complete, full.uncovered) == (1, 0)
    hole = tiles.completeness(cut.filter("tile_seq <> 4"), cube=["cube"], expected_tiles=9, height=7, width=7).first()
    assert hole.complete == 0


def test_utm_against_forward_series(spark):
    """Forward transverse Mercator (independent meridian-arc integral) then back."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)

    def forward(lon, lat, zone):
        phi, lam = np.radians(lat), np.radians(lon - (zone * 6 - 183))
        s, c, t = np.sin(phi), np.cos(phi), np.tan(phi)
        nu = a / np.sqrt(1 - e2 * s * s)
        ep2 = e2 / (1 - e2)
        eta2, A = ep2 * c * c, lam * c
        grid = np.linspace(0, phi, 20001)
        arc = np.trapezoid(a * (1 - e2) / (1 - e2 * np.sin(grid) ** 2) ** 1.5, grid)
        T = t * t
        x = nu * (A + (1 - T + eta2) * A**3 / 6 + (5 - 18 * T + T * T + 72 * eta2 - 58 * ep2) * A**5 / 120)
        y = arc + nu * t * (A**2 / 2 + (5 - T + 9 * eta2 + 4 * eta2**2) * A**4 / 24 + (61 - 58 * T + T * T + 600 * eta2 - 330 * ep2) * A**6 / 720)
        return 500000 + k0 * x, k0 * y + (10000000 if lat < 0 else 0)

    points = [(9.5, 48.2, 32), (-70.3, -33.1, 19), (36.8, -1.3, 37), (3.0, 60.0, 31)]
    data = [(i, 32600 + z + (100 if lat < 0 else 0), *map(float, forward(lon, lat, z))) for i, (lon, lat, z) in enumerate(points)]
    df = spark.createDataFrame(data, "i int, e int, x double, y double")
    lon, lat = climate.utm_to_lonlat(F.col("e"), F.col("x"), F.col("y"))
    for r in df.select("i", lon.alias("lon"), lat.alias("lat")).collect():
        assert (r.lon, r.lat) == pytest.approx(points[r.i][:2], abs=1e-6)


def test_nearest_point_far_and_clustered(spark, rng):
    q = pd.DataFrame({"q": range(60), "x": rng.uniform(-100, 100, 60), "y": rng.uniform(-100, 100, 60)})
    p = pd.DataFrame({"p": range(80), "px": np.r_[rng.normal(90, 0.1, 70), rng.uniform(-100, 100, 10)], "py": np.r_[rng.normal(90, 0.1, 70), rng.uniform(-100, 100, 10)]})
    got = meta.nearest_point(spark.createDataFrame(q), spark.createDataFrame(p), query_id=["q"], x="x", y="y", px="px", py="py", payload=["p"])
    d = (q.x.values[:, None] - p.px.values) ** 2 + (q.y.values[:, None] - p.py.values) ** 2
    assert {r.q: r.p for r in got.collect()} == dict(zip(q.q, d.argmin(1)))


def test_nearest_point_keeps_far_queries(spark):
    q = spark.createDataFrame([("far", 1e7, 5e6), ("near", 0.0, 0.0), ("none", None, 1.0)], "q string, x double, y double")
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 3.0, 3.0)], "p int, px double, py double")
    got = {r.q: r.p for r in meta.nearest_point(q, p, query_id=["q"], x="x", y="y", px="px", py="py", payload=["p"]).collect()}
    assert got == {"far": 2, "near": 1, "none": None}


def test_nearest_time_prefers_later_on_tie(spark):
    left = spark.createDataFrame([("c", "2024-01-02 12:00:00"), ("c", "2024-01-09 00:00:00")], "c string, s string").select("c", F.col("s").cast("timestamp_ntz").alias("t"))
    right = spark.createDataFrame([("c", "2024-01-02 06:00:00", 1), ("c", "2024-01-02 18:00:00", 2), ("c", "2024-01-10 00:00:01", 3)], "c string, s string, v int").select("c", F.col("s").cast("timestamp_ntz").alias("rt"), "v")
    got = climate.nearest_in_time(left, right, cube=["c"], time="t", right_time="rt", values=["v"]).orderBy("t").collect()
    assert [r.v for r in got] == [2, None]


def test_beta_matches_least_squares(spark, rng):
    n = 40
    x, c1 = rng.normal(size=n), rng.normal(size=n)
    y = 0.7 * x - 0.3 * c1 + rng.normal(scale=0.2, size=n)
    pdf = pd.DataFrame({"cube_id": [str(i) for i in range(n)], "y": y, "x": x, "c1": c1, "const": 3.0})
    r = stats.standardized_beta(spark.createDataFrame(pdf), outcome="y", feature="x", controls=["c1", "const"], unique=["cube_id"], n_boot=40, seed=1).first()
    z = (pdf[["y", "x", "c1"]] - pdf[["y", "x", "c1"]].mean()) / pdf[["y", "x", "c1"]].std(ddof=0)
    want = np.linalg.lstsq(np.c_[np.ones(n), z[["x", "c1"]]], z["y"], rcond=None)[0][1]
    assert r.standardized_beta == pytest.approx(want) and r.controls == "c1" and r.n_cubes == n
    assert r.ci_low < want < r.ci_high
    few = stats.standardized_beta(spark.createDataFrame(pdf.head(9)), outcome="y", feature="x", unique=["cube_id"], n_boot=4).first()
    assert few.standardized_beta is None and few.n_cubes == 9


def test_bootstrap_draws_are_with_replacement_and_stratified(spark):
    df = spark.createDataFrame([(str(i), i % 2, float(i % 2)) for i in range(40)], "cube_id string, fold int, v double")
    r = stats.bootstrap(df, strata=["fold"], unique=["cube_id"], metrics=["v"], n_boot=30).first()
    assert (r.estimate, r.ci_low, r.ci_high, r.n_cubes) == (0.5, 0.5, 0.5, 40)
    sums = stats.replicate_sums(df.withColumn("g", F.lit(1)), keys=["g"], unique=["cube_id"], values=["v"], n_boot=6, seed=2).collect()
    assert {p.rep for p in sums} == {-1, 0, 1, 2, 3, 4, 5} and all(p.c_v == 40 for p in sums)


def test_bootstrap_over_buckets(spark):
    """A group cut into buckets draws as many rows as it has, and its means scatter as they should."""
    n, n_boot = 2000, 400
    df = spark.range(n).select(F.lit("a").alias("g"), F.col("id").alias("u"), (F.col("id") % 97).cast("double").alias("v"))
    both = df.unionByName(df.limit(5).withColumn("g", F.lit(None).cast("string")))
    got = stats.replicate_sums(both, keys=["g"], unique=["u"], values=["v"], n_boot=n_boot, seed=3, bucket_rows=100).toPandas()
    big = got[got["g"] == "a"]
    assert (big["c_v"] == n).all() and len(big) == n_boot + 1 and (got[got["g"].isna()]["c_v"] == 5).all()
    means = big[big["rep"] >= 0]["s_v"] / n
    values = np.arange(n) % 97
    assert abs(means.mean() - values.mean()) < 4 * values.std() / np.sqrt(n * n_boot)
    assert means.std() == pytest.approx(values.std() / np.sqrt(n), rel=0.15)
    alone = stats.replicate_sums(df, keys=["g"], unique=["u"], values=["v"], n_boot=n_boot, seed=3, bucket_rows=100).toPandas()
    assert alone.sort_values("rep")["s_v"].tolist() == big.sort_values("rep")["s_v"].tolist()  # other groups don't matter


# ---- folds -----------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def cubes(spark):
    rng = np.random.default_rng(2)
    data = [(i, f"L{rng.integers(9)}", f"S{rng.integers(5)}", "D" if i % 3 else "B") for i in range(300)]
    return spark.createDataFrame(data, "cube int, loc string, sea string, cls string")


@pytest.mark.parametrize("space,time", [("loc", "sea"), ("loc", None), (None, "sea")])
@pytest.mark.parametrize("k", [1, 3, 20])
def test_fold_rules(cubes, space, time, k):
    got = folds.spacetime_folds(cubes, space=space, time=time, k=k).toPandas()
    n_units = min(cubes.select(c).distinct().count() for c in (space, time) if c)
    assert got.fold.nunique() == min(k, n_units)
    for _, part in got.groupby("fold"):
        train, val = part[part.subset == "train"], part[part.subset == "val"]
        for c in (space, time):
            if c:
                assert not set(train[c]) & set(val[c])
        if not (space and time):
            assert (part.subset != "excluded").all()
    if k > 1:
        assert folds.validation_overlaps(cubes.sparkSession.createDataFrame(got), cube="cube").count() == 0


def test_numeric_strata_rejected(cubes):
    with pytest.raises(ValueError, match="categorical"):
        folds.spacetime_folds(cubes.withColumn("cls", F.lit(1)), space="loc", k=2, strata="cls")


def test_strict_searches(cubes):
    for out in (
        folds.random_strict_folds(cubes, space="loc", time="sea", k=2, min_val_share=0.05, tries=40),
        folds.chunked_strict_folds(cubes, space="loc", time="sea", k=3),
    ):
        out = out.persist()
        assert folds.shared_groups(out, group="loc").count() == 0
        assert folds.shared_groups(out, group="sea").count() == 0
        assert out.filter("subset = 'val'").count() > 0
    with pytest.raises(Exception, match="no strict draw"):
        folds.random_strict_folds(cubes, space="loc", time="sea", k=2, min_val_share=0.9, tries=5).collect()


@pytest.mark.parametrize("seed,found", [(0, [0, 2]), (2, [])])
def test_strict_search_query_leaves_out_what_its_sql_does(spark, tmp_path, seed, found):
    """Cubes spread evenly over locations and seasons: few draws are large enough, and some folds have none."""
    rng = random.Random(seed)
    cells = [(n, s) for n in range(25) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY") for _ in range(round(rng.gauss(40, 1.5)))]
    tables = {
        "customer": spark.createDataFrame([(i, n, s, 0.0) for i, (n, s) in enumerate(cells)], "c_custkey bigint, c_nationkey int, c_mktsegment string, c_acctbal double"),
        "nation": spark.createDataFrame([(n, f"N{n}", n % 5) for n in range(25)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": spark.createDataFrame([(r, f"R{r}") for r in range(5)], "r_regionkey int, r_name string"),
    }
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    query, sql = load()["random_strict_folds"]
    got = sorted(map(tuple, query(spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(sql).fetchall())
    assert sorted({fold for _, fold, _ in got}) == found and len(got) == len(found) * len(cells)


def test_group_balance(cubes):
    out = folds.balanced_group_folds(cubes, group=["loc", "sea"], k=4).toPandas()
    assert (out.groupby("cv_group").fold.nunique() == 1).all()
    sizes = out.groupby("fold").size()
    assert sizes.max() - sizes.min() <= out.groupby("cv_group").size().max()
    loads, want = [0] * 4, {}
    for g, n in sorted(out.groupby("cv_group").size().items(), key=lambda s: (-s[1], s[0])):
        want[g] = loads.index(min(loads))
        loads[want[g]] += n
    assert dict(zip(out.cv_group, out.fold)) == want


def test_split_documents_and_membership(spark):
    doc = spark.createDataFrame([(0, ["a", "b"], ["c"]), (1, ["c", "b"], ["a", "b"])], "k int, tr array<string>, va array<string>")
    files = folds.explode_splits(doc, fold="k", train="tr", val="va").withColumnRenamed("file", "cube")
    assert files.count() == 7
    md = spark.createDataFrame([("a", "D"), ("b", "B")], "cube string, cls string")
    joined, report = folds.split_membership(files, md, cube="cube", climate="cls")
    assert joined.count() == 7
    got = {r.fold: r.problem for r in report.collect()}
    assert got == {0: "missing_metadata", 1: "missing_metadata;train_val_overlap;climate_class_on_both_sides"}


# ---- selection -------------------------------------------------------------------------------------
def runs(spark, extra=()):
    bands, ind = ["B02", "B03", "B04", "B8A"], ["IRECI", "NDMI", "NIRv"]
    spec = [("a-ind", "A", ind, 0.6, [9, 11, 13]), ("a-bands", "A", bands, 0.61, [8, 10, 12]), ("b-ind", "B", ind, 0.62, [7, 9, 11]), ("b-bands", "B", bands, 0.7, [20, 22, 24]), *extra]
    cols = "run_dir string, model_type string, s2_vars array<string>, monitor_metric string, monitor_mode string, k_folds int, cv_enabled boolean, refit_enabled boolean, min_valid_target_coverage double, min_valid_target_count int, min_target_variance double, mean_val_score double, recommended_final_refit_epochs int, run_ts timestamp"
    import datetime as dt

    ts = dt.datetime(2026, 8, 1)
    r = spark.createDataFrame([(d, m, v, "nnse", "max", 3, True, False, 0.15, 1000, 1e-6, s, e[1] + 1, ts - dt.timedelta(days=30 * d.endswith("old"))) for d, m, v, s, e in spec], cols)
    f = spark.createDataFrame([(d, i, s, e[i] if d != "b-ind" else None, f"x/epoch={e[i]}.ckpt") for d, _, _, s, e in spec for i in range(3)], "run_dir string, fold int, best_score double, best_epoch int, best_checkpoint string")
    files = spark.createDataFrame([(d, i, "val", f"c{i}{j}") for d, *_ in spec for i in range(3) for j in range(2)], "run_dir string, fold int, subset string, file string")
    return r, f, files


def grid(spark):
    return spark.createDataFrame(list(itertools.product("AB", ["Indices", "RGBI_kNDVI"])), "model_type string, predictor_set string")


def test_selection_end_to_end(spark):
    old = ("b-bands-old", "B", ["B02", "B03", "B04", "B8A"], 0.9, [1, 2, 3])
    audit = selection.audit_runs(*runs(spark, [old])).persist()
    assert audit.filter("valid = 0").count() == 0
    got = {r.run_dir: r for r in selection.final_selection(audit, expected=grid(spark)).collect()}
    assert [d for d, r in got.items() if r.selected] == ["b-bands"]
    assert got["b-bands"].refit_epochs == 23 and got["b-ind"].refit_epochs == 10
    assert got["b-bands-old"].status == "superseded" and got["a-ind"].status == "active"
    assert got["b-bands"].notes == "" and got["b-bands"].std_score == pytest.approx(0.0)


def test_selection_refuses_incomplete_or_mixed(spark):
    r, f, files = runs(spark)
    missing = selection.audit_runs(r.filter("run_dir <> 'a-ind'"), f, files)
    with pytest.raises(PySparkException, match="incomplete"):
        selection.final_selection(missing, expected=grid(spark)).collect()
    other = files.withColumn("file", F.when(F.col("run_dir") == "a-ind", F.concat("file", F.lit("z"))).otherwise(F.col("file")))
    with pytest.raises(PySparkException, match="different validation cubes"):
        selection.final_selection(selection.audit_runs(r, f, other)).collect()
    broken = selection.audit_runs(r, f.filter("not (run_dir = 'a-ind' and fold = 2)"), files)
    assert "fold results incomplete" in broken.filter("run_dir = 'a-ind'").first().reason


def test_run_name_timestamp(spark):
    df = spark.createDataFrame([("m_2026-08-16_01-02-03",), ("renamed",)], "r string")
    got = [r[0] for r in df.select(selection.run_timestamp(F.col("r")).cast("string")).collect()]
    assert got == ["2026-08-16 01:02:03", None]


# ---- guards ----------------------------------------------------------------------------------------
def test_guards_raise(spark):
    df = spark.createDataFrame([("c", "oof", "x"), ("d", "holdout", "x")], "cube_id string, stage string, configuration string")
    with pytest.raises(PySparkException, match="only oof rows"):
        stats.stage_guard(df, stage="oof").collect()
    md = spark.createDataFrame([("c", 1), ("c", 2)], "id string, v int")
    with pytest.raises(PySparkException, match="duplicate metadata id"):
        meta.merge_metadata(df.filter("cube_id = 'c'"), md, cube="cube_id", metadata_id="id").collect()
    members = spark.createDataFrame([("c", 0, "val"), ("c", 1, "val")], "cube_id string, fold int, subset string")
    with pytest.raises(PySparkException, match="several folds"):
        scoring.out_of_fold(df.select("cube_id"), members, cube="cube_id", configuration="k").collect()


def test_signature_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([("c", i, float(i), 1, 0.0) for i in range(20)], "cube string, t int, true double, mask int, base double")
    sig = lambda d: metrics.data_signature(d, cube=["cube"], keys=["t"]).first().signature
    assert sig(df) == sig(df.orderBy(F.desc("t")).repartition(3))
    assert sig(df) != sig(df.withColumn("true", F.when(F.col("t") == 3, 9.0).otherwise(F.col("true"))))


def test_all_landcover_groups_are_vegetation():
    assert {c for g in L.LANDCOVER_GROUPS.values() for c in g} <= set(L.VEGETATION_CODES)


def test_contrasts_share_their_draws(spark):
    """Masks of missing values, estimates and intervals against numpy with the same weights."""
    rng = np.random.default_rng(2)
    rows = [(f"c{i}", c, i % 2, None if rng.random() < 0.2 else float(rng.normal(j)), float(rng.normal())) for i in range(30) for j, c in enumerate("xyz") if rng.random() < 0.95]
    df = spark.createDataFrame(rows, "cube_id string, configuration string, fold int, nnse double, mae double")
    out = {(r.left_configuration, r.right_configuration, r.metric): r for r in stats.paired_contrasts(df, metrics=("nnse", "mae"), n_boot=300).collect()}
    assert len(out) == 6
    values = {(r[0], r[1]): r for r in rows}
    for (a, b, m), r in out.items():
        k = 3 if m == "nnse" else 4
        per = {f: [values[c, b][k] - values[c, a][k] for c in sorted({x[0] for x in rows if x[2] == f}) if (c, a) in values and (c, b) in values and None not in (values[c, a][k], values[c, b][k])] for f in (0, 1)}
        assert abs(r.estimate - np.mean([np.mean(v) for v in per.values()])) < 1e-9
        assert r.n_cubes == sum(map(len, per.values())) and r.higher_is_better == (m != "mae")
        assert r.ci_low < r.estimate < r.ci_high
    # shared draws: the contrasts of a cycle close in every replicate, so without gaps the interval of a constant shift is a point
    full = spark.createDataFrame([(f"c{i}", c, i % 2, float(i % 7) + j, 0.0) for i in range(20) for j, c in enumerate("xy")], df.schema)
    same = stats.paired_contrasts(full, metrics=("nnse",), n_boot=50).first()
    assert (same.ci_low, same.estimate, same.ci_high) == (1.0, 1.0, 1.0)
    assert stats.paired_contrasts(full.filter("configuration = 'x'"), metrics=("nnse",), n_boot=5).count() == 0
    with pytest.raises(ValueError, match="configurations"):
        stats.paired_contrasts(full, max_configurations=1)


def test_stage_report(spark):
    df = spark.createDataFrame([("a", "oof"), ("a", "oof"), ("b", "oof"), ("b", "holdout"), ("b", None)], "configuration string, stage string")
    got = {r.configuration: (r.n_rows, r.n_wrong, r.stages, r.accepted) for r in stats.stage_report(df, stage="oof").collect()}
    assert got == {"a": (2, 0, "", 1), "b": (3, 2, "<missing>;holdout", 0)}


def test_contrasts_are_resampled_one_by_one(spark):
    """Draws of a contrast come from the cubes that have both of its values, in plain Python by the SQL's formula."""
    rng = np.random.default_rng(4)
    rows = [(f"c{i}", c, i % 2, None if rng.random() < 0.4 else float(rng.normal(j)), float(rng.normal())) for i in range(24) for j, c in enumerate("xyz")]
    df = spark.createDataFrame(rows, "cube_id string, configuration string, fold int, nnse double, mae double")
    values = {(r[0], r[1]): r for r in rows}
    md5 = lambda *parts: hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    n_boot, m32 = 40, 0xFFFFFFFF
    for r in stats.paired_contrasts(df, metrics=("nnse", "mae"), n_boot=n_boot, seed=7).collect():
        k, means = 3 if r.metric == "nnse" else 4, []
        for fold in (0, 1):
            cubes = sorted((f"c{i}" for i in range(fold, 24, 2)), key=lambda c: md5(7, c))
            both = [(values[c, r.left_configuration][k], values[c, r.right_configuration][k]) for c in cubes]
            own = [b - a for a, b in both if a is not None and b is not None]
            start = int(md5(7, r.left_configuration, r.right_configuration, r.metric, fold)[:8], 16)
            means.append([])
            for rep in range(n_boot):
                picks = []
                for slot in range(len(own)):
                    x = (start + rep * 0x9E3779B1 + slot * 0x85EBCA6B) & m32
                    for shift, factor in ((16, 0x7FEB352D), (15, 0x5BD1E995)):
                        x = ((x ^ x >> shift) * factor) & m32
                    picks.append(((x ^ x >> 16) * len(own)) >> 32)
                means[-1].append(np.mean([own[p] for p in picks]))
        want = np.quantile(np.mean(means, axis=0), [0.025, 0.975])
        assert np.allclose([r.ci_low, r.ci_high], want, rtol=0, atol=1e-9), r


def test_replicates_split_a_group_by_themselves():
    """A key beyond 2 ** 63 keeps all its digits: replicates that shared one fell into buckets alike."""
    path = [{"left": 500, "total": 1000, "right": False}]
    for start in (5, 0xF0000001):
        counts = stats._drawn_counts(start, 0, path, 100_000, np.arange(200))
        want = [np.random.Generator(np.random.Philox(key=np.array([start << 32 | rep, 0], np.uint64))).binomial(100_000, 0.5) for rep in range(200)]
        assert counts.tolist() == want and len(set(want)) > 100


def test_cells_are_counted_as_they_come(spark):
    """Distinct cells in one box per cube need no map of all matches, and count as before."""
    cells = spark.createDataFrame([(i, 10.0 + (i // 2) * 0.1, 5.0) for i in range(8)] + [(9, None, 5.0)], "cell long, lat double, lon double")
    boxes = spark.createDataFrame([(1, 9.95, 10.05, 4.5, 5.5), (2, 9.95, 10.25, 4.5, 5.5), (3, 50.0, 51.0, 4.5, 5.5)], "cube long, lat_min double, lat_max double, lon_min double, lon_max double")
    all_ = climate.single_cell_check(climate.cells_in_boxes(boxes, cells), boxes, cube=["cube"])
    few = climate.single_cell_check(climate.cells_in_boxes(boxes, cells.select("lat", "lon").distinct()), boxes, cube=["cube"], distinct=True)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(few) == rows(all_) == [(1, 1, 1), (2, 3, 0), (3, 0, 0)]
    assert "(distinct" not in few._jdf.queryExecution().optimizedPlan().toString()


def test_audit_counts_distinct_files_in_parts(spark, monkeypatch):
    """Repeated, missing and extra files and folds are noted, however many parts the files are counted in."""
    monkeypatch.setattr(selection, "TASK_FILES", 3)
    runs = spark.createDataFrame([(r, "A", ["NDMI"], "nnse", "max", 2, True, False, 0.1, 1, 0.1, None, None) for r in "abcd"], "run_dir string, model_type string, s2_vars array<string>, monitor_metric string, monitor_mode string, k_folds int, cv_enabled boolean, refit_enabled boolean, min_valid_target_coverage double, min_valid_target_count int, min_target_variance double, mean_val_score double, recommended_final_refit_epochs int")
    scores = spark.createDataFrame([(r, f, 0.5, 3, "x") for r in "abcd" for f in (0, 1)], "run_dir string, fold int, best_score double, best_epoch int, best_checkpoint string")
    val = [(r, f, "val", f"f{f}-{i}") for r in "abc" for f in (0, 1) for i in range(5)] + [("b", 1, "val", "f0-1"), ("c", 7, "val", None)]
    files = spark.createDataFrame(val, "run_dir string, fold int, subset string, file string")
    out = selection.audit_runs(runs, scores, files, n_folds=2)
    got = {r.run_dir: r.reason for r in out.collect()}
    assert got == {"a": "", "b": "validation cubes overlap", "c": "validation splits incomplete;validation cubes overlap", "d": "validation splits incomplete"}
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_brackets_are_broadcast(spark):
    """Rows aren't shuffled to their group's bracket: three variables would be three tasks."""
    df = spark.range(3000).select((F.col("id") % 3).cast("string").alias("var"), F.sqrt("id").alias("value"))
    plan = climate.global_percentiles(df, probs=(0.1, 0.9))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") >= 1
    pdf = df.toPandas()
    for r in plan.collect():
        assert np.allclose([r.p_low, r.p_high], np.quantile(pdf[pdf["var"] == r.var]["value"], [0.1, 0.9]))
