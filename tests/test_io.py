import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from petrichor import schema as S
from petrichor.operators import scoring
from petrichor.sources import readers, writers


def obs(spark):
    return spark.createDataFrame(
        [(f"2024-01-0{d} 00:00:00", y, x, float("nan") if x == 0 else 1.0 * x, 0.5, "train", c) for d in (1, 2) for y in range(3) for x in range(3) for c in ("2020-0001-ABC", "2021-0002-DEF")],
        "t string, y int, x int, vv double, vh double, split string, cube_id string",
    ).select(F.col("t").cast("timestamp").alias("t"), "y", "x", F.col("vv").cast("float").alias("vv"), F.col("vh").cast("float").alias("vh"), "split", "cube_id")


def test_cube_round_trip_prunes_and_drops_nan(spark, tmp_path):
    root = str(tmp_path / "obs")
    writers.write_cubes(obs(spark), root, chunk=2, rows_per_file=5)
    df = readers.read_table(spark, root, S.OBS_RADAR)
    assert df.count() == 36 and df.filter("vv is null").count() == 12
    one = df.filter("cube_id = '2020-0001-ABC'").select("vv")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cube_id" in plan and "ReadSchema: struct<vv:float>" in plan
    got, skipped = readers.read_cubes(spark, [f"{root}/split=train/cube_id=2020-0001-ABC", f"{root}/split=train/cube_id=gone"], S.OBS_RADAR)
    assert got.select("cube_id").distinct().collect()[0][0] == "2020-0001-ABC" and got.count() == 18
    assert skipped == [f"{root}/split=train/cube_id=gone"]
    with pytest.raises(FileNotFoundError):
        readers.read_cubes(spark, [f"{root}/nothing"], S.OBS_RADAR)
    writers.write_cubes(obs(spark).filter("cube_id like '2020%' and y = 0"), root, overwrite_cubes_only=True)
    assert readers.read_table(spark, root, S.OBS_RADAR).count() == 6 + 18


def test_json_and_csv_sources(spark, tmp_path):
    (tmp_path / "splits.json").write_text(json.dumps({f"fold_{k}": {"train_files": ["a", "b"], "val_files": [f"v{k}"], "num_train": 2, "num_val": 1} for k in range(2)}, indent=1))
    got = sorted(tuple(r) for r in readers.read_splits(spark, str(tmp_path / "splits.json")).collect())
    assert got == [(0, "train", "a"), (0, "train", "b"), (0, "val", "v0"), (1, "train", "a"), (1, "train", "b"), (1, "val", "v1")]
    (tmp_path / "cv_summary.json").write_text(json.dumps({"folds": [{"fold": 0, "best_score": 0.5, "best_epoch": 3, "best_checkpoint": "e"}], "recommended_final_refit_epochs": 4}, indent=1))
    r = readers.read_cv_summary(spark, str(tmp_path / "cv_summary.json")).first()
    assert r.recommended_final_refit_epochs == 4 and r.folds[0].best_epoch == 3 and r.cv_summary_path.endswith("cv_summary.json")
    (tmp_path / "stats.json").write_text(json.dumps({"t2m": {"p0_01": -1.0, "p99_99": 2.0}}))
    assert tuple(readers.read_global_stats(spark, str(tmp_path / "stats.json")).first()) == ("t2m", -1.0, 2.0)
    (tmp_path / "m.csv").write_text("id,v\na,1.5\nb,oops\n")
    assert [r.v for r in readers.read_csv(spark, str(tmp_path / "m.csv"), numeric=["v"]).orderBy("id").collect()] == [1.5, None]


def test_path_list(spark, tmp_path):
    (tmp_path / "ok.txt").write_text("# head\n\n a/b.zarr \nc.zarr\n")
    assert [r.path for r in readers.read_path_list(spark, str(tmp_path / "ok.txt")).collect()] == ["a/b.zarr", "c.zarr"]
    (tmp_path / "bad.txt").write_text("a.zip\n")
    with pytest.raises(PySparkException, match="not a cube path"):
        readers.read_path_list(spark, str(tmp_path / "bad.txt")).collect()


def test_manifests(spark, tmp_path):
    head = "configuration,architecture,optical_input,stage,fold,cube_id,tensor_path"
    (tmp_path / "a.csv").write_text(head + "\nk,A,rgb,oof,0,c1,x\nk,A,rgb,oof,0,c1,y\n")
    (tmp_path / "b.csv").write_text(head + ",extra\nk,A,rgb,oof,1,c2,x,7\n")
    m = readers.load_manifests(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert m.count() == 3 and m.select("manifest_path").distinct().count() == 2
    tensors = spark.createDataFrame([("k", "oof", "c1")], "configuration string, stage string, cube_id string")
    assert sorted(tuple(r) for r in readers.manifest_problems(m, tensors).collect()) == [("k", "oof", "c1", "duplicate"), ("k", "oof", "c2", "missing_tensor")]
    with pytest.raises(PySparkException, match="several manifest rows"):
        writers.manifest_table(m).collect()
    (tmp_path / "c.csv").write_text("configuration,stage\nk,oof\n")
    with pytest.raises(ValueError, match="missing columns"):
        readers.load_manifests(spark, [str(tmp_path / "c.csv")])
    good = spark.createDataFrame([("k", "oof", None, "c3", "x"), ("k", "oof", 1, "c2", "x"), ("k", "oof", 0, "c1", "x")], "configuration string, stage string, fold int, cube_id string, tensor_path string")
    writers.write_manifest(good, str(tmp_path / "out"))
    assert [r.cube_id for r in writers.manifest_table(good).collect()] == ["c1", "c2", "c3"]


def test_prediction_sink_and_resume(spark, tmp_path):
    pred = spark.createDataFrame([(s, y, x, 0.1, 0.2, 1.0, 0.3, "k", "oof", 0, c) for s in (1, 2) for y in range(2) for x in range(2) for c in ("c1", "c2")], S.PREDICTIONS.replace("float", "double"))
    root = str(tmp_path / "pred")
    writers.write_predictions(pred, root)
    back = spark.read.parquet(root)
    assert back.count() == 16
    check = readers.prediction_check(back, cube=["cube_id"]).collect()
    assert all(r.ok == 1 for r in check)
    wobbly = readers.prediction_check(back.withColumn("base", F.col("base") + F.col("step")).filter("not (cube_id = 'c2' and step = 1 and y = 0)"), cube=["cube_id"])
    assert {r.cube_id: r.problem for r in wobbly.collect()} == {"c1": "base_not_constant", "c2": "grid_incomplete;base_not_constant"}
    work = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "cube_id string")
    assert [r.cube_id for r in writers.remaining(work, back).collect()] == ["c3"]
    ran = []
    with pytest.raises(FileExistsError):
        writers.export_if_needed(work, lambda: back, ran.append)
    assert writers.export_if_needed(work.filter("cube_id <> 'c3'"), lambda: back, ran.append) == "reused" and not ran
    with pytest.raises(RuntimeError, match="2 of 3 cubes"):
        writers.export_if_needed(work, lambda: back, ran.append, overwrite=True)
    stored = lambda: back if len(ran) < 2 else work  # noqa: E731  what the second run leaves
    assert writers.export_if_needed(work, stored, ran.append, overwrite=True) == "exported" and len(ran) == 2
    writers.write_export_document(work, back, str(tmp_path / "doc"), stage="oof")
    assert spark.read.json(str(tmp_path / "doc")).first().asDict() == {"n_expected": 3, "n_existing": 2, "state": "partial", "stage": "oof"}


def test_stats_cache(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.createDataFrame([(1.5,)], "vv_max double")

    for _ in range(2):
        assert writers.cached_stats(spark, str(tmp_path / "stats"), compute).first().vv_max == 1.5
    assert len(calls) == 1


def test_statics_keep_cubes_without_layers(spark):
    layers = spark.createDataFrame([("c1", 0, 0, 1, 0, 10), ("c1", 0, 0, 2, 1, 20)], "cube_id string, y int, x int, t int, is_veg int, esa_lc int")
    pixel = ["cube_id", "y", "x"]
    one = readers.reduce_statics(layers, pixel=pixel, time="t")
    pred = spark.createDataFrame([("c1", 0, 0), ("c2", 0, 0)], "cube_id string, y int, x int")
    assert sorted(tuple(r) for r in readers.attach_statics(pred, one, pixel=pixel).collect()) == [("c1", 0, 0, 1, 10), ("c2", 0, 0, None, None)]


def test_score_tiles_uses_batches(spark):
    df = spark.range(10).select("id", F.col("id").cast("double").alias("v"))
    out = scoring.score_tiles(df, lambda pdf: pdf["v"] * 2).collect()
    assert all(r.pred == r.v * 2 for r in out)


def test_results(spark, tmp_path):
    df = spark.range(3)
    writers.write_result(df, str(tmp_path / "r.csv"))
    writers.write_result(df, str(tmp_path / "r.json"), "json")
    assert spark.read.option("header", True).csv(str(tmp_path / "r.csv")).count() == 3
    assert spark.read.json(str(tmp_path / "r.json")).count() == 3


def test_climate_scan(spark, tmp_path):
    for i, var in enumerate(("pei_30", "t2m")):
        spark.createDataFrame([(1.0, 2.0, var, float("nan") if i else 3.0)], "lat double, lon double, var string, value double").withColumn("day", F.lit("2024-01-01").cast("date")).write.parquet(str(tmp_path / var))
    got = readers.read_climate(spark, [str(tmp_path / "pei_30"), str(tmp_path / "t2m")])
    assert sorted((r.var, r.value) for r in got.collect()) == [("pei_30", 3.0), ("t2m", None)]


def test_a_box_reads_few_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    px = spark.range(12 * 64 * 64).select(
        F.lit("train").alias("split"), F.lit("c").alias("cube_id"), (F.col("id") / 4096).cast("bigint").alias("t"), (F.col("id") / 64 % 64).cast("int").alias("y"), (F.col("id") % 64).cast("int").alias("x"), F.rand(1).alias("v")
    )
    root = str(tmp_path / "cubes")
    writers.write_cubes(px, root, chunk=8, rows_per_file=4000, row_group_bytes=4096)
    files = list((tmp_path / "cubes").rglob("*.parquet"))
    assert len(files) >= 10  # one cube, many tasks
    all_, hit = 0, 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            stat = {n: meta.row_group(g).column(i).statistics for i, n in enumerate(names)}
            all_ += 1
            hit += stat["t"].min <= 5 <= stat["t"].max and all(stat[c].min < 16 for c in "yx")  # t = 5, y and x below 16
    assert all_ >= 24 and hit <= all_ / 8
    back = spark.read.parquet(root)
    assert back.count() == 12 * 64 * 64 and back.filter("t = 5 AND y < 16 AND x < 16").count() == 256


def test_z_order_is_morton(spark):
    got = spark.range(64).select((F.col("id") / 8).cast("int").alias("r"), (F.col("id") % 8).cast("int").alias("c")).withColumn("z", writers.z_order(F.col("r"), F.col("c"))).collect()
    for r in got:
        bits = "".join(a + b for a, b in zip(f"{r.r:03b}", f"{r.c:03b}"))
        assert r.z == int(bits, 2)


def test_commit_markers(spark, tmp_path):
    root = str(tmp_path / "out")
    assert writers.commit_state(spark, root).count() == 0
    rows = [("k", "oof", c, s, y, 0, 0.5) for c in "abc" for s in range(2) for y in range(3)]
    df = spark.createDataFrame(rows, "configuration string, stage string, cube_id string, step int, y int, x int, pred double")
    writers.write_predictions(df, root)
    state = lambda: {r.cube_id: (r.n_rows, r.n_stored, r.state) for r in writers.commit_state(spark, root).collect()}
    assert set(state().values()) == {(None, 6, "uncommitted")}
    writers.commit(df.filter("cube_id <> 'c'"), root)
    assert state() == {"a": (6, 6, "complete"), "b": (6, 6, "complete"), "c": (None, 6, "uncommitted")}
    writers.write_predictions(df.filter("cube_id = 'b' AND step = 0"), root)  # a job that dies after half a cube
    assert state()["b"] == (6, 3, "truncated")
    assert sorted(r.cube_id for r in writers.remaining(df.select("cube_id").distinct(), writers.complete_cubes(spark, root)).collect()) == ["b", "c"]
    redo = df.filter("cube_id = 'b' AND step = 0")
    writers.commit(redo, root)  # the newest marker counts
    assert state()["b"] == (3, 3, "complete")
    writers.commit(df.withColumn("cube_id", F.lit("gone")), root)
    assert state()["gone"] == (18, None, "missing")


def test_split_lines(spark, tmp_path):
    files = spark.range(250).select((F.col("id") % 2).cast("int").alias("fold"), F.when(F.col("id") < 200, "train").otherwise("val").alias("subset"), F.col("id").cast("string").alias("file"))
    writers.write_splits(files, str(tmp_path / "s"), block=20)
    lines = spark.read.json(str(tmp_path / "s"))
    assert lines.count() > 8 and lines.selectExpr("max(size(files)) AS n").first().n < 60
    back = readers.read_split_lines(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, files.collect()))


def test_tasks_of_a_write_stay_small(spark, tmp_path):
    """Without a size asked for, 2.5 million rows of one cube are several tasks' work."""
    df = spark.range(2_500_000).select(F.lit("train").alias("split"), F.lit("c").alias("cube_id"), F.col("id").alias("t"), F.lit(0).alias("y"), F.lit(0).alias("x"))
    writers.write_cubes(df, str(tmp_path / "big"))
    assert len(list((tmp_path / "big").rglob("*.parquet"))) >= 3
    assert spark.read.parquet(str(tmp_path / "big")).count() == 2_500_000
