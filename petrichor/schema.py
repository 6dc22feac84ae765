"""Explicit schemas of the long tables. One table per time axis; partition columns are split and cube_id."""

from __future__ import annotations

from pyspark.sql import types as T

_BANDS = ["B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B11", "B12"]


CUBES = "cube_id string, split string, epsg int, precip_start date, precip_end date, drought_start date, drought_end date"
OBS_OPTICAL = "t timestamp, y int, x int, " + ", ".join(f"{b} float" for b in _BANDS) + ", SCL smallint, cloud_mask smallint, split string, cube_id string"
OBS_RADAR = "t timestamp, y int, x int, vv float, vh float, split string, cube_id string"
STATIC = "y int, x int, ux double, uy double, esa_lc smallint, dem float, is_veg tinyint, split string, cube_id string"
CLIMATE_DAILY = "lat double, lon double, day date, var string, value double"
PREDICTIONS = "step int, y int, x int, pred float, true float, mask float, base float, configuration string, stage string, fold int, cube_id string"
MANIFEST = (
    "configuration string, architecture string, optical_input string, source_run_dir string, config_path string, stage string, "
    "fold int, cube_id string, tensor_path string, source_cube_path string, checkpoint_path string, cv_summary_path string"
)
MANIFEST_REQUIRED = ["configuration", "architecture", "optical_input", "stage", "fold", "cube_id", "tensor_path"]
EXCLUDED = "cube_id string, reason string"
EVENTS_META = (
    "`DisNo.` string, iso string, country string, continent string, climate_class string, koppen_geiger string, "
    "pheno_label_id int, pheno_season_name string, latitude double, longitude double, start_date date, end_date date, split string, tp_rollingmax double"
)
CV_SUMMARY = (
    "folds array<struct<fold:int,best_score:double,best_epoch:int,best_checkpoint:string>>, "
    "mean_val_score double, std_val_score double, recommended_final_refit_epochs int"
)
CV_SPLIT = "map<string, struct<train_files:array<string>,val_files:array<string>,num_train:int,num_val:int>>"
GLOBAL_STATS = "map<string, struct<p0_01:double,p99_99:double>>"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
