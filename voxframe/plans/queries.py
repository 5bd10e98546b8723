"""The registered queries of the library: each takes (spark, sf_dir) and returns a DataFrame with doubles rounded for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import log_note
from ..functions.joins import merge_join
from ..functions.scratch import new_path, stored
from ..operators import augment, cell, components, edits, geometry, learn, patches, segment, spatial, voxel
from ..sources import chunks, npy
from ..sources import fixtures as fx
from ..sources import volumes as io
from ..streaming import streams
from . import tasks

PATCH, STRIDE = (8, 16, 16), (6, 12, 12)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits (3 where they are large), without negative zeros."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def local_times(df: DataFrame) -> DataFrame:
    """Instants as the log's own kind of time."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def query(f: Callable) -> Callable:
    """Register under the function's name. The function gets what its parameters are named for."""
    names = f.__code__.co_varnames[: f.__code__.co_argcount]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = {"spark": lambda *_: spark, "sf_dir": lambda *_: sf_dir, "vox": fx.label_vox, "vol": fx.volumes, "raw": fx.raw_vox, "masks": fx.query_vox, "pred": fx.pred_vox, "log": fx.curation_log, "rois": fx.roi_vertices, "points": fx.cells3}
        return rounded(f(*(given[n](spark, sf_dir) for n in names)))

    QUERIES[f.__name__] = run
    return f


# --- cells -------------------------------------------------------------------------------------


@query
def label_sizes(vox):
    return voxel.label_sizes(voxel.foreground(vox))


@query
def size_summary(vox):
    return voxel.size_summary(vox)


@query
def distinct_labels(vox):
    return voxel.distinct_labels(vox)


@query
def label_width(vox):
    return voxel.label_width(vox)


@query
def cell_basic(vox, vol):
    return voxel.basic_features(vox, vol)


@query
def touch_border_cells(vox, vol):
    return voxel.basic_features(vox, vol).where("touch_border").select("vol_id", "label")


@query
def cell_surface(vox, vol):
    return voxel.surface_area(vox, vol)


@query
def cell_shape(vox, vol):
    return voxel.shape_features(voxel.basic_features(vox, vol), voxel.surface_area(vox, vol)).select("vol_id", "label", "sphericity", "compactness")


@query
def cell_intensity(vox, raw):
    return voxel.intensity_features(vox, raw)


@query
def cell_pca_axes(vox, vol):
    return rounded(voxel.pca_axes(vox, vol), 4)


@query
def principal_directions(vox, vol):
    return voxel.principal_directions(vox, vol)


@query
def basic_info(vox, vol):
    return tasks.basic_info(vox, vol)[0]


@query
def summary_stats(vox, vol):
    return tasks.basic_info(vox, vol)[1]


@query
def size_histogram(vox):
    return tasks.size_statistics(vox)[1]


@query
def relabel_sequential(vox):
    return voxel.relabel_sequential(vox)


@query
def next_label_id(vox):
    return voxel.next_label_id(vox)


@query
def foreground_per_slice(vox):
    return voxel.foreground_per_slice(vox)


@query
def richest_slice(vox):
    return voxel.richest_slice(vox)


@query
def voxel_anisotropy(vol):
    return tasks.anisotropy(vol)


# --- contacts ----------------------------------------------------------------------------------


@query
def contact_edges(vox, vol):
    return voxel.contact_edges(vox, vol)


@query
def contact_features(vox, vol):
    return tasks.contact(vox, vol)[0]


@query
def contact_summary(vox, vol):
    return tasks.contact(vox, vol)[1]


# --- neighbourhoods ----------------------------------------------------------------------------


@query
def knn_features(vox, vol):
    return spatial.knn_features(voxel.basic_features(vox, vol), (5, 10, 20))


@query
def knn_join_points(points):
    return spatial.knn_join(points, 10).withColumn("rank", F.col("rank").cast("long"))


@query
def radius_features(vox, vol):
    return spatial.radius_features(voxel.basic_features(vox, vol), 20.0, spatial.INDEX, "px")


@query
def local_neighbour_stats(vox, vol):
    return spatial.local_neighbour_stats(voxel.basic_features(vox, vol), ["volume_um3", "equivalent_diameter_um"], 10)


@query
def local_comparison_knn(vox, vol):
    return tasks.local_comparison(vox, vol)[0]


@query
def local_comparison_radius(vox, vol):
    return tasks.local_comparison(vox, vol, mode="radius", radius_vox=12.0)[0]


@query
def region_bins(vox, vol):
    return spatial.region_bins(voxel.basic_features(vox, vol), vol).select("vol_id", "label", "region_z_bin", "region_y_bin", "region_x_bin", "region_id")


@query
def region_features(vox, vol):
    return spatial.region_features(voxel.basic_features(vox, vol), vol)


# --- scores ------------------------------------------------------------------------------------


@query
def robust_zscores(vox, vol):
    return learn.robust_zscore(voxel.basic_features(vox, vol), "volume_um3").select("vol_id", "label", "robust_z_volume_um3")


@query
def normalize_scores(vox, vol):
    return learn.normalize_score(voxel.basic_features(vox, vol), "volume_um3").select("vol_id", "label", "volume_um3_score")


@query
def feature_matrix(vox, vol):
    return learn.prepare_feature_matrix(voxel.basic_features(vox, vol), ["volume_um3", "centroid_z_um"])


@query
def lof_scores(points):
    return learn.local_outlier_factor(points, spatial.UM)


@query
def isolation_forest_scores(vox, vol):
    cells = tasks.morphology(vox, vol)
    return learn.isolation_forest_score(cells, learn.choose_feature_columns(cells))


@query
def isolation_forest_points(points):
    return learn.isolation_forest_score(points, spatial.UM)


@query
def anomaly_scores(vox, vol):
    return tasks.anomaly(vox, vol).select("vol_id", "label", "anomaly_score", "is_anomaly", "anomaly_reason")


@query
def cluster_cells(vox, vol):
    cells = tasks.morphology(vox, vol)
    return learn.cluster_cells(cells, learn.choose_feature_columns(cells)).select("vol_id", "label", "cluster_id")


@query
def cluster_single_feature(vox, vol):
    return tasks.clustering(vox, vol)[0]


# --- maps --------------------------------------------------------------------------------------


@query
def feature_map_uint16(vox, vol):
    return cell.feature_maps(vox, voxel.basic_features(vox, vol), ["volume_um3", "centroid_z_um"])


@query
def categorical_map(vox, vol):
    return cell.feature_maps(vox, spatial.region_bins(voxel.basic_features(vox, vol), vol), ["region_z_bin", "region_x_bin"])


# --- patches -----------------------------------------------------------------------------------


@query
def percentile_normalize(raw):
    return patches.percentile_normalize(raw)


@query
def minmax_normalize(raw):
    return patches.minmax_normalize(raw)


@query
def normalized_threshold(raw):
    return patches.normalized_threshold(patches.percentile_stats(raw), 20)


@query
def auto_contrast(raw, vol):
    return patches.auto_contrast(raw, vol)


@query
def patch_grid(vol):
    return patches.patch_grid(vol, PATCH, STRIDE)


@query
def inference_grid(vol):
    return patches.inference_grid(vol, PATCH)


@query
def pad_volume(raw, vol):
    return patches.pad_volume(raw, vol, (8, 48, 48), (6, 36, 36))


@query
def crop_box(raw):
    return patches.crop_box(raw, (1, 2, 3), (6, 20, 30))


@query
def crop_centered(raw, vol, rois):
    clicks = rois.where("ord = 1").selectExpr("vol_id", "roi_id AS click_id", "z AS cz", "y AS cy", "x - 5 AS cx")
    return patches.crop_centered(raw, vol, clicks, (8, 16, 16))


@query
def instances_per_patch(vox, vol):
    return patches.instances_per_patch(vox, patches.patch_grid(vol, PATCH, STRIDE))


@query
def valid_patches_max(raw, vol):
    return patches.valid_patches_max(raw, patches.patch_grid(vol, PATCH, STRIDE), 230)


@query
def valid_patches_p999(raw, vol):
    return patches.valid_patches_p999(patches.percentile_normalize(raw), patches.patch_grid(vol, PATCH, STRIDE), 0.9)


@query
def sample_patches(vol):
    return patches.sample_patches(patches.patch_grid(vol, PATCH, STRIDE), 20)


@query
def training_patches(vox, raw, vol):
    return patches.training_patches(vox, raw, vol, PATCH, STRIDE)[2]


@query
def patch_export_summary(vox, raw, vol):
    kept = patches.training_patches(vox, raw, vol, PATCH, STRIDE)[0]
    return patches.patch_export_summary(patches.patch_grid(vol, PATCH, STRIDE), kept, patches.percentile_stats(raw))


@query
def flip_rot90(vox, vol):
    corner = patches.patch_grid(vol, PATCH, STRIDE).withColumn("patch_name", F.format_string("%s_z%04d_y%04d_x%04d", "vol_id", "z0", "y0", "x0"))
    corner = corner.select("vol_id", "patch_id", "patch_name", *(f"{a}0" for a in "zyx"), *(f"p{a}" for a in "zyx"))
    local = [(F.col(a) - F.col(f"{a}0")).alias(a) for a in "zyx"]
    labels = patches.voxels_in_patches(vox, corner).select("patch_name", *local, "label", "pz", "py", "px")
    return augment.flip_rot90(labels, ("pz", "py", "px")).drop("pz", "py", "px")


# --- segmentation ------------------------------------------------------------------------------


@query
def mask_quality(masks):
    return segment.mask_quality(masks)


@query
def topk_queries(masks):
    return segment.topk_queries(masks, 30, 0.4).select("patch_id", "query_id", "final_score", F.col("rank").cast("long").alias("rank"))


@query
def mask_pair_overlap(masks):
    return segment.mask_pair_overlap(masks, 0.3, 2)


@query
def merge_groups(masks):
    return segment.merge_groups(segment.mask_pair_overlap(masks, 0.3, 1), 0.05, 0.02)


@query
def voxel_argmax(masks):
    return segment.voxel_argmax(masks, min_score=0.4)


@query
def postprocess_patch(masks):
    return segment.postprocess_patch(masks, 8 * 88 * 88, min_score=0.4)


@query
def dice_matrix(pred, vox):
    return segment.dice_matrix(pred, vox)


@query
def match_instances(pred, vox):
    return segment.match_instances(pred, vox)


@query
def confidence_mean(masks):
    return segment.confidence_mean(masks.withColumnRenamed("prob", "confidence"))


@query
def filter_instances(vox, raw):
    return segment.filter_instances(vox, raw, 30, 400, 150)


@query
def select_clicked_query(masks, rois):
    clicks = rois.where("ord = 1").selectExpr("roi_id AS click_id", "z AS cz", "y AS cy", "x - 5 AS cx")
    return segment.select_clicked_query(masks, clicks).select("click_id", "patch_id", "query_id", "click_prob", "valid", "rank_score", "mask_threshold")


@query
def slice_components(vox):
    return components.slice_components(vox)


@query
def clean_instances(vox, raw):
    return segment.clean_instances(vox, raw, 10, 30)


def _few_labels(vox):
    """All voxels under seven labels, so that each label is in many pieces."""
    return vox.withColumn("label", F.col("label") % 7 + 1)


@query
def split_disconnected(vox):
    return components.split_disconnected(_few_labels(vox))


@query
def clicked_component(vox, rois):
    clicks = rois.where("ord = 1").selectExpr("vol_id", "roi_id AS click_id", "z", "y", "x - 5 AS x")
    return components.clicked_component(_few_labels(vox), clicks)


@query
def stitch_patches(masks, vol):
    """Instances of each half of the volume, with an overlap, stitched again."""
    grid = patches.patch_grid(vol, (8, 64, 64), (6, 40, 40))
    best = masks.where("prob > 0.5").groupBy("z", "y", "x").agg(F.max_by("query_id", F.struct("prob", "query_id")).alias("label"), F.max("prob").alias("confidence"))
    rows = best.withColumn("vol_id", F.lit(fx.VOL))
    local = patches.voxels_in_patches(rows, grid).select("vol_id", "patch_id", "z", "y", "x", "label", "confidence")
    return segment.stitch_patches(local, grid, vol, (6, 40, 40), min_core=8)


# --- geometry and edits ------------------------------------------------------------------------


@query
def resize_nearest(vox, vol):
    return geometry.resize_nearest(vox, vol.selectExpr("*", "nz + 3 AS tz", "ny div 2 AS ty", "nx AS tx"))


@query
def resize_linear(raw, vol):
    return geometry.resize_linear(raw, geometry.target_shape(vol, (1.0, 2.0, 2.0)))


@query
def exposed_faces(vox):
    return geometry.exposed_faces(vox).groupBy("vol_id", "label", "axis").agg(F.count(F.lit(1)).alias("faces"))


@query
def surface_faces(vox):
    vertices, faces = geometry.surface_faces(vox)
    return vertices.groupBy("vol_id", "label").agg(F.count(F.lit(1)).alias("n_vertices")).join(faces.groupBy("vol_id", "label").agg(F.count(F.lit(1)).alias("n_triangles")), ["vol_id", "label"])


@query
def smooth_polygons(rois):
    return geometry.smooth_polygons(rois)


@query
def rasterize_polygons(rois, vol):
    return geometry.rasterize_polygons(rois, vol)


@query
def add_roi(vox, vol, rois):
    return edits.add_roi(vox, geometry.rasterize_polygons(rois, vol), 9999)


@query
def subtract_roi(vox, vol, rois):
    return edits.subtract_roi(vox, geometry.rasterize_polygons(rois, vol), 52)


@query
def new_label(vox, vol, rois):
    return edits.new_label(vox, geometry.rasterize_polygons(rois, vol))


@query
def change_label(vox):
    return edits.change_label(vox, 12, 4321, 4)


@query
def delete_on_slice(vox):
    return edits.delete_on_slice(vox, 12, 4)


@query
def delete_near(vox):
    return edits.delete_near(vox, 12, 4, 2)


@query
def delete_inside_roi(vox, vol, rois):
    return edits.delete_inside_roi(vox, geometry.rasterize_polygons(rois, vol), 2)


@query
def replace_cell(vox, vol, rois):
    return edits.replace_cell(vox, geometry.rasterize_polygons(rois, vol), 52, ((0, 0, 0), (10, 40, 40)))


@query
def edit_delta(vox, vol, rois):
    return edits.edit_delta(vox, edits.subtract_roi(vox, geometry.rasterize_polygons(rois, vol), 52))


@query
def apply_edit_log(vox, log):
    """Each logged edit of a slice paints, renames or clears its label's voxels there."""
    marks = merge_join(log.withColumn("z", F.col("z_index")), vox.withColumnRenamed("label", "label_id"), ["label_id", "z"])
    new = F.when(F.col("operation").startswith("delete") | F.col("operation").startswith("subtract"), 0).when(F.col("operation") == "change label", F.col("label_id") + 1).otherwise(F.col("label_id"))
    return edits.apply_edit_log(vox, marks.select("vol_id", "seq", "z", "y", "x", new.cast("long").alias("label")))


@query
def latest_edits(log):
    return edits.latest_edits(log).select("layer_name", "seq", F.col("place").cast("long").alias("place"))


@query
def edit_audit(log):
    return edits.edit_audit(log)


@query
def z_run_bbox(vox):
    thin = vox.withColumn("label", F.col("label") % 7 * 1000 + F.col("y") * 100 + F.col("x"))  # columns of voxels, with gaps along z
    starts = thin.groupBy("vol_id", "label").agg(F.min("z").alias("start_z"))
    return edits.z_run_bbox(thin, starts)


@query
def z_run_near_click(vox):
    starts = vox.groupBy("vol_id", "label").agg(F.min("z").alias("start_z"))
    return edits.z_run_bbox(vox, starts, reach=3)


# --- sources and streams -----------------------------------------------------------------------


@query
def pair_files(spark, sf_dir):
    return io.pair_files(fx.image_files(spark, sf_dir), fx.label_files(spark, sf_dir))


@query
def common_stems(spark, sf_dir):
    return io.common_stems(fx.image_files(spark, sf_dir), fx.label_files(spark, sf_dir))


@query
def training_records(spark, sf_dir):
    return io.training_records(fx.image_files(spark, sf_dir), fx.label_files(spark, sf_dir))


@query
def batch_summary(spark, sf_dir):
    return io.batch_summary(io.batch_plan(fx.image_files(spark, sf_dir), fx.label_files(spark, sf_dir)))


@query
def edit_rate(spark, log):
    return local_times(streams.replayed(spark, streams.closing(log), streams.edit_rate))


@query
def edit_sessions(spark, log):
    return local_times(streams.replayed(spark, streams.closing(log), streams.edit_sessions))


@query
def dedup_log(spark, log):
    twice = log.select("ts", "operation", "label_id", "z_index", "layer_name")
    return local_times(streams.replayed(spark, twice.union(twice), streams.dedup_log))


@query
def online_confidence(spark, masks):
    rows = masks.select(F.lit(fx.VOL).alias("vol_id"), "z", "y", "x", F.col("prob").alias("confidence"))
    return streams.replayed(spark, rows, streams.online_confidence, "update", ("vol_id", "z", "y", "x"))


@query
def online_label_sizes(spark, log, vox):
    sizes = voxel.label_sizes(vox).select(F.col("label").alias("label_id"), "voxel_count")
    sign = F.when(F.col("operation") == "add to label", 1).when(F.col("operation") == "subtract from label", -1).otherwise(0)
    deltas = log.join(sizes, "label_id").select(F.col("label_id").alias("label"), (sign * F.col("voxel_count")).alias("delta"))
    return streams.replayed(spark, deltas, streams.online_label_sizes, "update", ("label",))


# --- readers and writers: each writes to the shared folder and returns what it reads back --------


@query
def npy_slices(raw):
    return io.decode_npy(io.encode_npy(raw)).select("path", "y", "x", "value")


@query
def volume_store(spark, vox):
    path = new_path(spark, "volume")
    io.write_volume(vox, path, 4)
    return io.read_volume(spark, path, z=(2, 7)).select("vol_id", "z", "y", "x", "label")


def _chunks(spark, rows):
    path = new_path(spark, "chunks")
    chunks.write_chunks(rows, path, (4, 16, 16), 20_000)
    return path


@query
def chunked_store(spark, vox):
    return spark.read.parquet(f"{_chunks(spark, vox)}/voxels").select("vol_id", "z", "y", "x", "label")


@query
def chunked_box(spark, vox, vol):
    """A box from the chunks that it meets."""
    return chunks.read_box(spark, _chunks(spark, vox), fx.VOL, (1, 10, 3), (6, 40, 30)).select("vol_id", "z", "y", "x", "label")


@query
def chunked_clicks(spark, raw, vol, rois):
    """Patches around clicks from the chunks that they meet."""
    clicks = rois.where("ord = 1").selectExpr("vol_id", "roi_id AS click_id", "z AS cz", "y AS cy", "x - 5 AS cx")
    return chunks.crop_clicks(spark, _chunks(spark, raw), vol, clicks, (8, 16, 16))


@query
def npy_volume(spark, raw, vol):
    """A volume as .npy files of eight slices, read again in slabs."""
    path = new_path(spark, "npy")
    npy.write_npy(raw, vol, path, slices=8).collect()
    found = npy.read_npy(spark, f"{path}/{fx.VOL}", slab=40_000)
    return found.select((F.col("t") * 8 + F.col("z")).alias("z"), "y", "x", "value")


@query
def time_series(spark, raw, vol):
    """Frames of a moving volume, the second and third of them."""
    raw, vol, path = stored(raw, "raw"), stored(vol, "volumes"), new_path(spark, "frames")
    for frame in range(3):
        moved = raw.withColumn("vol_id", F.lit(f"f{frame}")).withColumn("value", F.col("value") + 1000 * frame)
        npy.write_npy(moved, vol.withColumn("vol_id", F.lit(f"f{frame}")), path, slices=1 << 20).collect()
    return npy.read_npy(spark, path, z=(1, 4), t=(1, 3), recursive=True).select("t", "z", "y", "x", "value")


@query
def rolled_frames(vox, vol):
    """The volume in three frames that roll."""
    shape = vol.select("nz", "ny", "nx").first()
    return io.sample_time_series(vox, shape, 3).select(F.col("t").cast("long").alias("t"), "z", "y", "x", "label")


@query
def mapped_features(vox, vol):
    """The features of a table that a map can show, one row for each cell and feature."""
    cells = voxel.basic_features(vox, vol)
    names = cell.map_features(cells, "core")
    return cells.select("vol_id", "label", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names))).alias("f")).select("vol_id", "label", "f.*")


@query
def empty_label(spark, vol):
    rows, volumes = io.empty_label(spark, vol)
    return volumes.join(rows.groupBy("vol_id").agg(F.count(F.lit(1)).alias("voxels")), "vol_id", "left").fillna(0, ["voxels"])


@query
def validated_voxels(vox, vol):
    return voxel.validated(vox, vol).select("vol_id", "z", "y", "x", "label")


@query
def task_csv(spark, vox, vol):
    paths = io.write_task_csv(tasks.basic_info(vox, vol), new_path(spark, "csv"), "basic_info")
    return spark.read.option("header", True).schema("vol_id string, label_id long, volume_um3 double").option("enforceSchema", True).csv(paths[0]).select("vol_id", "label_id", "volume_um3")


@query
def run_parameters(spark, vol):
    path = new_path(spark, "parameters")
    io.write_parameters(spark, {"knn_k": (5, 10), "seed": 0, "feature_set": "shape"}, vol, path)
    at = lambda p: F.get_json_object("value", p)
    return spark.read.text(path).select(at("$.config.knn_k[1]").cast("long").alias("knn_k"), at("$.config.feature_set").alias("feature_set"), at("$.derived.label_shape[0]").cast("long").alias("nz"), at("$.derived.voxel_volume_um3").cast("double").alias("voxel_volume_um3"))


@query
def feature_map_store(spark, vox, vol):
    cells, folder = spatial.region_bins(voxel.basic_features(vox, vol), vol), new_path(spark, "maps")
    cell.write_feature_maps(vox, cells, ["volume_um3", "region_z_bin"], folder)
    listed = spark.read.parquet(f"{folder}/manifest").select("group", "feature")
    return spark.read.parquet(f"{folder}/maps").groupBy("feature").agg(F.count(F.lit(1)).alias("voxels"), F.sum("value").alias("total")).join(listed, "feature")


@query
def appended_log(spark, log):
    path = new_path(spark, "log")
    for part in (0, 1):
        io.append_log(log.where(f"seq % 2 = {part}"), path)
    return spark.read.parquet(path).select("seq", "operation", "label_id", "z_index", "layer_name")


@query
def mesh_store(spark, vox):
    path = new_path(spark, "mesh")
    io.save_mesh(*geometry.surface_faces(vox), path, 4.0)
    return io.load_mesh(spark, path)[2]


@query
def patch_store(spark, vox, raw, vol):
    path = new_path(spark, "patches")
    io.write_training_patches(*patches.training_patches(vox, raw, vol, PATCH, STRIDE, threshold=0.5)[1:], path)
    images = spark.read.parquet(f"{path}/images").groupBy("patch_name").agg(F.count(F.lit(1)).alias("voxels"), F.avg("norm").alias("mean_norm"))
    labels = spark.read.parquet(f"{path}/labels").groupBy("patch_name").agg(F.max("label").alias("labels"), F.count(F.lit(1)).alias("labelled"))
    return images.join(labels, "patch_name")


@query
def all_files(spark, sf_dir):
    return io.distinct_files(fx.image_files(spark, sf_dir), fx.label_files(spark, sf_dir), fx.image_files(spark, sf_dir))


# --- more operators ------------------------------------------------------------------------------


@query
def original_labels(vox):
    numbered = voxel.relabel_sequential(vox)
    return cell.map_ids(voxel.label_sizes(numbered), voxel.label_numbers(vox)).select("vol_id", "label", "voxel_count")


@query
def cell_preview(vox, vol):
    return cell.preview(voxel.basic_features(vox, vol).select("vol_id", "label", "volume_um3"), 20)


@query
def strided_voxels(vox):
    return patches.strided_sample(vox, 500)


@query
def logits_to_prob(masks):
    raw = masks.withColumn("logit", F.when(F.col("patch_id") % 2 == 0, F.col("prob") * 4 - 1).otherwise(F.col("prob")))
    return segment.logits_to_prob(raw).select("patch_id", "query_id", "z", "y", "x", "prob")


@query
def class_topk(masks):
    q = masks.select("patch_id", "query_id").distinct().withColumn("class", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    logits = q.withColumn("logit", ((F.col("query_id") * 7 + F.col("class") * 13) % 11) / 4.0 + F.col("class") * F.col("query_id") / 10000.0)
    return segment.class_topk(logits, 60).withColumn("rank", F.col("rank").cast("long"))


@query
def mask_costs(masks, vox):
    return segment.mask_cost_matrix(masks.select(F.lit(fx.VOL).alias("vol_id"), "query_id", "z", "y", "x", "prob"), vox, 100_000)


@query
def conflict_components(masks):
    return segment.conflict_components(masks, 0.3, 3).select("patch_id", "z", "y", "x", "component")


@query
def contact_continuity(vox):
    """The area in which two cells touch along z, and how much of it hangs together."""
    up = vox.select("vol_id", (F.col("z") + 1).alias("z"), "y", "x", F.col("label").alias("below"))
    touching = merge_join(vox, up, ["vol_id", "z", "y", "x"]).where("label <> below").withColumn("slice", F.col("z"))
    return components.contact_continuity(touching, ["vol_id", "label", "below", "slice"])


@query
def grown_boxes(vox, vol):
    box = voxel.basic_features(vox, vol).join(vol.select("vol_id", "nz", "ny", "nx"), "vol_id")
    box = box.select("vol_id", "label", *(F.col(f"bbox_{a}_min").alias(f"lo_{a}") for a in "zyx"), *((F.col(f"bbox_{a}_max") + 1).alias(f"hi_{a}") for a in "zyx"), "nz", "ny", "nx")
    return patches.expand_bbox(box, 2.0, 5).drop("nz", "ny", "nx")


@query
def united_boxes(vox, vol):
    box = voxel.basic_features(vox, vol).join(vol.select("vol_id", "nz", "ny", "nx"), "vol_id").withColumn("group", F.col("label") % 7)
    box = box.select("vol_id", "group", *(F.col(f"bbox_{a}_min").alias(f"lo_{a}") for a in "zyx"), *((F.col(f"bbox_{a}_max") + 1).alias(f"hi_{a}") for a in "zyx"), "nz", "ny", "nx")
    return patches.union_bboxes(box, ("vol_id", "group"))


@query
def bright_display(raw, vol):
    return patches.bright_display(raw, patches.auto_contrast(raw, vol)).select("vol_id", "z", "y", "x", "display")


@query
def coarse_patches(raw, vol):
    norm = patches.minmax_normalize(raw).withColumn("patch_name", F.col("vol_id"))
    return augment.coarse_xy(norm.select("patch_name", "z", "y", "x", "norm"), 3)


@query
def augmented_patches(vox, raw, vol):
    """Every kept patch, jittered in intensity, degraded, turned and scaled by its own draws."""
    images = patches.training_patches(vox, raw, vol, PATCH, STRIDE)[1].select("patch_name", "z", "y", "x", "norm")
    return augment.random_scale(augment.flip_rot90(augment.degrade(augment.intensity_jitter(images)), PATCH), PATCH)


@query
def log_notes(log):
    return log.select("seq", log_note(F.col("operation"), F.col("label_id"), F.col("z_index"), F.col("seq") % 100, F.col("seq") % 70).alias("line"))


def _with_undo(log, every: str):
    """A log in which some of the entries are undos."""
    return log.withColumn("operation", F.when(F.expr(every), "undo").otherwise(F.col("operation")))


@query
def active_edits(log):
    return edits.active_edits(_with_undo(log, "operation = 'delete all Z'")).select("seq", "layer_name", "operation")


@query
def shallow_undo(log):
    """Edits that stay where a layer remembers three of them and two fifths of the entries are undos."""
    return edits.active_edits(_with_undo(log, "seq % 5 > 2"), depth=3).select("seq", "layer_name", "operation")


@query
def undo_stream(spark, log):
    """The same, from keyed state."""
    entries = _with_undo(log, "seq % 5 > 2").select("layer_name", "seq", "operation").orderBy("seq").coalesce(1)
    found = streams.replayed(spark, entries, lambda s: streams.undo_stream(s, depth=3), "update", ("layer_name", "seq"), streams.ROCKSDB)
    return found.where("active").select("seq", "layer_name")


# --- whole tasks ---------------------------------------------------------------------------------


@query
def neighborhood_task(vox, vol):
    return tasks.neighborhood(vox, vol)[0]


@query
def intensity_task(vox, vol, raw):
    return tasks.intensity(vox, vol, raw)


@query
def region_task(vox, vol):
    return tasks.region(vox, vol)[1]


@query
def anomaly_from_scores(vox, vol):
    """The anomaly score where the two outlier scores are given."""
    near = tasks.with_neighbourhood(tasks.morphology(vox, vol))
    given = near.withColumns({"isolation_forest_score": (F.col("label") % 101) / 100.0, "lof_score": (F.col("label") % 89) / 88.0})
    return learn.anomaly_score(given).select("vol_id", "label", "anomaly_score", "is_anomaly", "anomaly_reason")


@query
def lof_on_features(vox, vol):
    cells = tasks.morphology(vox, vol)
    columns = ["volume_um3", "surface_area_um2", "sphericity", "elongation"]
    return learn.local_outlier_factor(learn.prepare_feature_matrix(cells, columns), columns)


@query
def morphometry_summary(vox, vol, raw):
    return tasks.morphometry(vox, vol, raw)[2]


@query
def finalized_labels(masks, vol, raw):
    rows = masks.where("prob > 0.5").groupBy("z", "y", "x").agg(F.min("query_id").alias("label"), F.max("prob").alias("confidence"))
    labels, confidence = tasks.finalize_segmentation(rows.withColumn("vol_id", F.lit(fx.VOL)), vol.selectExpr("*", "nz AS tz", "ny div 2 AS ty", "nx div 2 AS tx"), raw, 4, 30, None, 120, shape=True)
    # a little more, so that no value lies halfway between two rounded ones
    return merge_join(confidence.select("vol_id", "z", "y", "x", (F.col("value") + 1e-9).alias("confidence")), labels, ["vol_id", "z", "y", "x"], "left").select("vol_id", "z", "y", "x", "confidence", F.coalesce("label", F.lit(0)).cast("long").alias("label"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
