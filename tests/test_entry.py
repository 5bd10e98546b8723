"""The driver's contract: the library's queries import, run and agree with their SQL on the smallest tables."""

import importlib.util
import os

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "cell_basic", "cell_surface", "cell_pca_axes", "cell_intensity", "contact_features", "contact_continuity", "knn_features", "local_neighbour_stats", "region_task", "summary_stats", "valid_patches_p999", "patch_store", "training_patches",
    "percentile_normalize", "voxel_argmax", "class_topk", "mask_costs", "merge_groups", "conflict_components", "match_instances", "slice_components", "split_disconnected", "clicked_component", "clean_instances", "finalized_labels", "resize_linear",
    "surface_faces", "mesh_store", "apply_edit_log", "active_edits", "rasterize_polygons", "smooth_polygons", "crop_centered", "select_clicked_query", "grown_boxes", "strided_voxels", "anomaly_from_scores", "lof_scores", "lof_on_features", "edit_rate", "edit_sessions",
    "online_confidence", "online_label_sizes", "npy_slices", "volume_store", "chunked_store", "run_parameters", "feature_map_store", "appended_log",
    "isolation_forest_points", "shallow_undo", "undo_stream", "npy_volume", "time_series", "chunked_box", "chunked_clicks", "rolled_frames", "mapped_features", "z_run_bbox", "z_run_near_click", "bright_display", "knn_join_points",
]
#: Queries that SQL cannot say, with the columns that they must have.
ROWS_ONLY = {
    "anomaly_scores": {"anomaly_score", "is_anomaly"}, "cluster_cells": {"cluster_id"}, "cluster_single_feature": {"cluster_id"}, "isolation_forest_scores": {"isolation_forest_score"}, "postprocess_patch": {"label", "confidence"},
    "stitch_patches": {"label", "confidence"}, "flip_rot90": {"label"}, "sample_patches": {"patch_id"}, "principal_directions": {"orientation_z"}, "augmented_patches": {"norm"}, "morphometry_summary": {"metric", "value"},
}


@pytest.fixture(scope="module")
def entry():
    spec = importlib.util.spec_from_file_location("__spark_entry__", f"{ROOT}/__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def same(df, con, sql):
    left, right = df.toPandas(), con.execute(sql).df()
    names = sorted(left.columns)
    assert names == sorted(right.columns)
    shown = lambda p: sorted(tuple("" if v is None or v != v else f"{v + 0.0:.6g}" if isinstance(v, float) else str(v) for v in r) for r in p[names].itertuples(index=False))
    assert shown(left) == shown(right)


def test_entry_has_rows(spark, entry):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query(entry):
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, entry, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    same(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, entry, name):
    found = entry.queries()[name](spark, SF)
    assert ROWS_ONLY[name] <= set(found.columns) and found.count() > 0


def test_the_rest_has_sql(entry):
    assert {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"} == set(ROWS_ONLY) | {n for n in entry.oracle_sql() if not n.startswith("op")}
