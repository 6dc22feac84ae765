"""Hand-computed values for the rules that are easy to get wrong (NULLs, ties, bin edges)."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from petrichor.functions import indices
from petrichor.functions.scalar import bin_end, clip
from petrichor.operators import baselines, masks, metrics, quality, radar, stats, tiles, timegrid


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_quality_masks_missing_code_is_valid(spark):
    df = spark.createDataFrame([(1, 4, 0), (2, 8, 0), (3, 1, 0), (4, 4, 2), (5, None, 0)], "i int, SCL int, cloud_mask int")
    out = rows(masks.quality_masks(df), "i")
    assert [r[1] for r in out] == [1, 1, 0, 0, 1]
    assert [r[2] for r in out] == [1, 0, 0, 0, 1]
    check = masks.quality_mask_check(masks.quality_masks(df), []).first()
    assert (check.n_basic, check.n_strict, check.violated) == (3, 2, 0)


def test_mask_check_compat_mode(spark):
    df = spark.createDataFrame([(4, 0), (4, 0)], "SCL int, cloud_mask int")
    masked = masks.quality_masks(df)
    assert masks.quality_mask_check(masked, []).first().violated == 0
    assert masks.quality_mask_check(masked, [], compat=True).first().violated == 1


def test_band_clip(spark):
    df = spark.createDataFrame([(0, -5.0), (1, 0.0), (2, 2500.0), (3, 12000.0), (4, None)], "i int, B04 double")
    assert masks.band_columns(df) == ["B04"]
    assert [r[1] for r in rows(masks.clean_bands(df), "i")] == [0.0, 0.0, 0.25, 1.0, None]
    assert tuple(masks.band_clip_report(df, ["B04"]).first()) == ("B04", 1, 1)


def test_indices_and_zero_denominator(spark):
    df = spark.createDataFrame([(0.4, 0.1), (0.0, 0.0)], "B08 double, B04 double")
    out = df.select(*[indices.spectral_index(n).alias(n) for n in ("NDVI", "kNDVI", "NIRv")]).collect()
    np.testing.assert_allclose(list(out[0]), [0.6, math.tanh(0.36), 0.24])
    assert list(out[1]) == [None, None, None]


def test_decibel(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1e-10), (2, 0.001), (3, None)], "i int, vv double")
    got = [r[1] for r in rows(radar.to_unit_decibel(df, ["vv"]), "i")]
    np.testing.assert_allclose(got[:3], [30 / 35, 0, 0], atol=1e-12)
    assert got[3] is None


def test_bin_labels(spark):
    df = spark.createDataFrame([("2024-01-15 12:00:00",), ("2024-01-16 00:00:00",), ("2024-01-10 23:59:00",)], "s string")
    got = df.select(bin_end(F.col("s").cast("timestamp_ntz"), F.lit("2024-01-16").cast("date"))).collect()
    assert [str(r[0]) for r in got] == ["2024-01-16", "2024-01-21", "2024-01-11"]


def test_resample_median_with_nulls(spark):
    t = dt.date(2024, 1, 17)
    df = spark.createDataFrame([("a", t, v, w) for v, w in [(1.0, None), (2.0, None), (None, None), (10.0, None), (4.0, None)]], "px string, t date, v double, w double")
    for cols in (["v"], ["v", "w"]):
        r = timegrid.resample_median(df, cube=[], pixel=["px"], time="t", values=cols, origin=F.lit("2024-01-16").cast("date")).first()
        assert r.v == 3.0 and r.n == 5
    assert r.w is None


def test_densify_and_interpolation(spark):
    base = dt.date(2024, 1, 1)
    series = [None, 1.0] + [None] * 8 + [10.0, None]
    data = [("p", base + dt.timedelta(days=5 * i), v) for i, v in enumerate(series)]
    df = spark.createDataFrame(data, "px string, bin date, v double")
    end = F.lit(str(base + dt.timedelta(days=5 * 11))).cast("date")
    got = [r[2] for r in rows(timegrid.interpolate_context(df, pixel=["px"], time="bin", values=["v"], event_end=end).select("px", "bin", "v"), "bin")]
    assert got == [None, 1, 2, 3, 4, 5, 6, 7, None, None, 10, None]
    early = F.lit(str(base + dt.timedelta(days=5 * 9))).cast("date")
    untouched = [r[2] for r in rows(timegrid.interpolate_context(df, pixel=["px"], time="bin", values=["v"], event_end=early).select("px", "bin", "v"), "bin")]
    assert untouched == series
    sparse = df.filter(F.col("v").isNotNull())
    assert timegrid.densify(sparse, cube=["px"], pixel=[]).count() == 10


def test_trim_keeps_cube_without_data(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 3, 0), ("b", 1, 0), ("b", 2, 0)], "c string, t int, m int")
    assert [r[:2] for r in rows(timegrid.trim_to_first_valid(df, cube=["c"], time="t", mask="m"), "c", "t")] == [("a", 2), ("a", 3), ("b", 1), ("b", 2)]


def test_persistence(spark):
    df = spark.createDataFrame([("p", 1, 0.2, 1), ("p", 2, 0.3, 1), ("p", 3, 0.9, 0), ("q", 1, 0.5, 0)], "px string, t int, v double, m int")
    assert rows(baselines.persistence(df, pixel=["px"], time="t", value="v", mask="m"), "px") == [("p", 0.3), ("q", 0.0)]


def test_static_outliers(spark):
    data = [("r", i, -0.1 if i < 8 else 0.6) for i in range(10)] + [("k", i, -0.1) for i in range(4)]
    df = spark.createDataFrame(data, "px string, t int, NDVI double").withColumns({"NDWI": F.lit(None).cast("double"), "mask_strict": F.lit(1), "is_veg": F.lit(1)})
    got = {r.px: (r.error_freq, r.static_valid) for r in quality.static_outliers(df, pixel=["px"]).collect()}
    assert got == {"r": (0.8, 0), "k": (0.0, 1)}


def test_lee_filter(spark):
    data = [(0, y, x, 10.0 if (y, x) == (1, 1) else 1.0) for y in range(3) for x in range(3)]
    df = spark.createDataFrame(data, "t int, y int, x int, v double").withColumn("v", F.when(~((F.col("y") == 0) & (F.col("x") == 0)), F.col("v")))
    got = {(r.y, r.x): r.v_lee for r in radar.lee_filter(df, image=["t"], y="y", x="x", value="v").collect()}
    assert got[0, 0] is None
    assert got[1, 1] == pytest.approx(9.756877, abs=1e-6)
    assert all(v == pytest.approx(1.034732, abs=1e-6) for k, v in got.items() if k not in {(0, 0), (1, 1)})


def test_tertiles(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 1.0, 1.0, 2.0, 3.0, 4.0, None])], "i int, f double")
    got = [r.f_tertile for r in stats.event_tertiles(df, "f").orderBy("i").collect()]
    assert got == ["low", "low", "low", "middle", "high", "high", None]
    two = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i int, f double")
    assert {r.f_tertile for r in stats.event_tertiles(two, "f").collect()} == {None}


def test_tile_offsets_and_rotation(spark):
    assert tiles.axis_offsets(1000, 128) == [0, 124, 248, 372, 496, 620, 744, 872]
    assert tiles.axis_offsets(1000, 256) == [0, 248, 496, 744]
    cells = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "row int, col int").withColumns({"r0": F.col("row"), "c0": F.col("col")})
    once = {(r.r0, r.c0): (r.row, r.col) for r in tiles.rotate(cells, patch=2, turns=1).collect()}
    assert once == {(0, 0): (1, 0), (0, 1): (0, 0), (1, 0): (1, 1), (1, 1): (0, 1)}
    back = cells
    for _ in range(4):
        back = tiles.rotate(back, patch=2, turns=1)
    assert all((r.row, r.col) == (r.r0, r.c0) for r in back.collect())
    image = np.arange(9).reshape(3, 3)
    flat = spark.createDataFrame([(int(y), int(x), int(image[y, x])) for y in range(3) for x in range(3)], "row int, col int, v int")
    for k in range(4):
        turned = np.zeros((3, 3), int)
        for r in tiles.rotate(flat, patch=3, turns=k).collect():
            turned[r.row, r.col] = r.v
        assert (turned == np.rot90(image, k)).all()


def test_channel_layout_counts():
    layout = tiles.channel_layout(["kNDVI", "B02", "B03", "B04", "B8A"], ["vv", "vh"], [f"c{i}" for i in range(6)], ["dem"])
    assert (len(layout["context"]), len(layout["future"])) == (29, 20)
    assert layout["context"][1:20] == layout["future"][1:]
    assert layout["context"][-3:] == ["mask_target", "mask_s2", "mask_s1"]


def test_unknown_landcover_raises(spark):
    df = spark.createDataFrame([(10,), (11,)], "c int")
    with pytest.raises(PySparkException, match="unknown land-cover label 11"):
        df.select(*tiles.one_hot_landcover(F.col("c"))).collect()


def test_patch_choice_rank(spark):
    df = spark.createDataFrame([("a", 0, 1, 1, 7, 0, 0.0 + 7, 3, 0), ("a", 1, 2, 2, 3, 1, 8.0, 2, 0), ("b", 0, 1, 1, 0, 0, 0.0, 0, 0)], "c string, attempt int, top int, left int, g int, h int, score double, target_valid long, accepted int")
    got = {r.c: (r.top, r.how) for r in tiles.choose_patch(df, cube=["c"]).collect()}
    assert got == {"a": (2, "fallback"), "b": (None, "resample")}


# ---- prediction metrics ----------------------------------------------------------------------------
def cube(spark, broken=False):
    data = []
    for s, (t, p) in enumerate([(0.01, 0.005), (0.02, 0.015), (0.03, 0.025)], start=1):
        for y in range(2):
            for x in range(2):
                bad = broken and (y, x) == (0, 0)
                data.append(("c", s, y, x, 99.0 if bad else 0.4 + p, -99.0 if bad else 0.4 + t, 0.0 if bad else 1.0, 0.4))
    return spark.createDataFrame(data, "cube_id string, step int, y int, x int, pred double, true double, mask double, base double")


def test_metric_goldens(spark):
    steps = metrics.step_metrics(cube(spark), cube=["cube_id"], response_threshold=0.001)
    eligible = spark.createDataFrame([("c", 4)], "cube_id string, n_eligible long")
    r = metrics.cube_metrics(steps, cube=["cube_id"], eligible=eligible, min_count=0, min_coverage=0.0, min_variance=0.0).first()
    want = {
        "mse": 2.5e-5, "mae": 0.005, "bias": -0.005, "mse_base": 4.666667e-4, "mae_base": 0.02, "mse_skill": 0.9464286, "mae_gain": 0.015, "persistence_beaten": 1.0,
        "target_variance": 6.666667e-5, "nse": 0.625, "nnse": 0.7272727, "nse_base": -6.0, "nnse_base": 0.125, "observed_r30": 0.03, "predicted_r30": 0.025,
        "observed_response_auc": 0.02, "predicted_response_auc": 0.015, "valid_target_coverage": 1.0, "r30_direction_match": 1.0, "r30_abs_error": 0.005,
    }
    for k, v in want.items():
        assert r[k] == pytest.approx(v, rel=1e-4), k
    s = steps.orderBy("step").collect()
    assert [x.response_amplitude_ratio for x in s] == pytest.approx([0.5, 0.75, 0.8333333])
    assert all(x.nse is None and x.response_spatial_correlation is None for x in s)
    assert [x.lead_day for x in s] == [5, 10, 15]


def test_masked_extremes_never_enter(spark):
    steps = metrics.step_metrics(cube(spark, broken=True), cube=["cube_id"])
    r = metrics.cube_metrics(steps, cube=["cube_id"]).first()
    assert r.n_valid_target_pixel_times == 9 and r.mae == pytest.approx(0.005)
    assert r.nnse_exclusion_reason == "insufficient_valid_target_count" and r.nnse is None


def test_empty_step_and_empty_cube(spark):
    df = cube(spark).withColumn("mask", F.when(F.col("step") == 3, 0.0).otherwise(F.col("mask")))
    steps = metrics.step_metrics(df, cube=["cube_id"])
    last = steps.filter("step = 3").first()
    assert last.n_valid == 0 and last.mse is None and last.spatial_valid_fraction == 0.0
    r = metrics.cube_metrics(steps, cube=["cube_id"], min_count=0).first()
    assert r.observed_r30 is None and r.observed_response_auc == pytest.approx(0.015)
    empty = metrics.step_metrics(cube(spark).withColumn("mask", F.lit(0.0)), cube=["cube_id"])
    with pytest.raises(PySparkException, match="without any usable target value"):
        metrics.cube_metrics(empty, cube=["cube_id"]).collect()


def test_nan_and_infinity_are_not_valid(spark):
    df = cube(spark).withColumn("pred", F.when(F.col("step") == 1, float("nan")).when(F.col("step") == 2, float("inf")).otherwise(F.col("pred")))
    assert [r.n_valid for r in metrics.step_metrics(df, cube=["cube_id"]).orderBy("step").collect()] == [0, 0, 4]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (7.0,)], "v double")
    assert [r[0] for r in df.select(clip(F.col("v"), 0.0, 5.0)).collect()] == [None, 5.0]


def test_landcover_names(spark):
    df = spark.createDataFrame([(10,), (10,), (95,)], "c int")
    got = [tuple(r) for r in quality.landcover_distribution(df, cube=[], code="c").collect()]
    assert got == [(10, "LC_Tree", 66.67), (95, "Unmapped Code (95)", 33.33)]
