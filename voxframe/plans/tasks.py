"""Whole tasks, K1-K12: each composes operators into one plan and returns (table, summary)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EPS
from ..functions.joins import merge_join
from ..functions.scratch import stored
from ..operators import cell, geometry, learn, segment, spatial, voxel
from ..operators.voxel import CELL


@dataclass(frozen=True)
class Config:
    """Parameters and their defaults."""

    knn_k: tuple[int, ...] = (5, 10, 20)
    local_k: int = 10
    radius_um: tuple[float, ...] = (20.0, 50.0)
    radius_vox: float = 20.0
    grid: tuple[int, int, int] = (6, 6, 6)
    feature_set: str = "shape"
    clusters: int = 6
    seed: int = 0
    contamination: float = 0.02


NEEDS_SURFACE = {"surface_area_um2", "sphericity", "compactness"}
NEEDS_AXES = {"axis_major_um", "axis_intermediate_um", "axis_minor_um", "elongation", "flatness", "major_minor_ratio"}
NEEDS_RAW = {"min_intensity", "max_intensity", "mean_intensity", "std_intensity", "cv_intensity", "sum_intensity", "skewness_intensity", "kurtosis_intensity"}


def base_table(voxels: DataFrame, volumes: DataFrame, raw: DataFrame | None, features: Sequence[str]) -> DataFrame:
    """The cells with what the features need and no more: passes that no feature asks for are not in the plan."""
    wanted = set(features)
    cells = voxel.basic_features(voxels, volumes)
    if wanted & NEEDS_SURFACE:
        cells = voxel.shape_features(cells, voxel.surface_area(voxels, volumes))
    if wanted & NEEDS_AXES:
        cells = cells.join(voxel.pca_axes(voxels, volumes), CELL, "left")
    if wanted & NEEDS_RAW and raw is not None:
        cells = cells.join(voxel.intensity_features(voxels, raw), CELL, "left")
    return cells


BASIC = ("volume_um3", "equivalent_diameter_um", "surface_area_um2", "centroid_z_um", "centroid_y_um", "centroid_x_um", "sphericity", "compactness")


def basic_info(voxels: DataFrame, volumes: DataFrame, raw: DataFrame | None = None, features: Sequence[str] = BASIC) -> tuple[DataFrame, DataFrame]:
    """K1."""
    cells = base_table(voxels, volumes, raw, [x for f in features for x in cell.EXPANDED.get(f, [f])])
    chosen = cell.select_features(cells, features)
    return cell.public_cell_table(cells).select("vol_id", "label_id", *chosen), cell.summary_stats(cells, chosen)


def neighborhood(voxels: DataFrame, volumes: DataFrame, mode: str = "knn", k: int = 10, radius_vox: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """K2."""
    cells = stored(voxel.basic_features(voxels, volumes), "cells")  # the voxels are read once
    out = spatial.knn_features(cells, (k,)) if mode == "knn" else spatial.radius_features(cells, radius_vox, spatial.INDEX, "px")
    return out.withColumnRenamed("label", "label_id"), cell.summary_stats(out, out.columns[2:])


def local_comparison(voxels: DataFrame, volumes: DataFrame, raw: DataFrame | None = None, feature: str = "volume_um3", mode: str = "knn", k: int = 10, radius_vox: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """K3."""
    out = spatial.local_comparison(base_table(voxels, volumes, raw, [feature]), feature, mode, k, radius_vox)
    return out.withColumnRenamed("label", "label_id"), cell.summary_stats(out, out.columns[2:])


def contact(voxels: DataFrame, volumes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contact features, their summary, and the edges."""
    faces = voxel.adjacency(voxels)
    edges = voxel.contact_edges(voxels, volumes, faces)
    out = cell.contact_features(voxel.surface_area(voxels, volumes, faces), edges)
    return out.withColumnRenamed("label", "label_id"), cell.summary_stats(out, out.columns[2:]), edges


def clustering(voxels: DataFrame, volumes: DataFrame, raw: DataFrame | None = None, feature: str = "volume_um3", k: int = 6, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """K5."""
    if feature.startswith("contact_"):
        cells = contact(voxels, volumes)[0].withColumnRenamed("label_id", "label")
    else:
        cells = base_table(voxels, volumes, raw, [feature])
    out = learn.cluster_single_feature(cells.select(*CELL, feature), feature, k, seed)
    return out.withColumnRenamed("label", "label_id"), cell.summary_stats(out, [feature])


def morphology(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """K6: sizes, surfaces, contacts and axes of all cells."""
    faces = voxel.adjacency(voxels)
    surfaces = voxel.surface_area(voxels, volumes, faces)
    cells = voxel.shape_features(voxel.basic_features(voxels, volumes), surfaces)
    out = cell.merge_features(cells, cell.contact_features(surfaces, voxel.contact_edges(voxels, volumes, faces)), voxel.pca_axes(voxels, volumes))
    return stored(out, "morphology")  # many statistics of the cells follow; the voxels are read once


def intensity(voxels: DataFrame, volumes: DataFrame, raw: DataFrame) -> DataFrame:
    """K7."""
    return cell.merge_features(voxel.basic_features(voxels, volumes), voxel.intensity_features(voxels, raw))


def with_neighbourhood(cells: DataFrame, config: Config = Config()) -> DataFrame:
    """Neighbour distances, radius counts and local statistics beside the cells."""
    near = spatial.knn_join(cells, max(*config.knn_k, config.local_k))
    tables = [spatial.knn_features(cells, config.knn_k, neighbours=near)] + [spatial.radius_features(cells, r) for r in config.radius_um]
    local = [f for f in ("volume_um3", "sphericity", "elongation") if f in cells.columns]
    if local:
        tables.append(spatial.local_neighbour_stats(cells, local, config.local_k, neighbours=near).drop(*local))
    return stored(cell.merge_features(cells, *tables), "neighbourhood")


def region(voxels: DataFrame, volumes: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """K8: the cells with their regions, and the regions."""
    cells = with_neighbourhood(morphology(voxels, volumes), config)
    return spatial.region_bins(cells, volumes, config.grid), spatial.region_features(cells, volumes, grid=config.grid)


def anomaly(voxels: DataFrame, volumes: DataFrame, raw: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """K9. With ``raw``, intensity takes part."""
    cells = with_neighbourhood(morphology(voxels, volumes), config)
    if raw is not None:
        cells = cells.join(voxel.intensity_features(voxels, raw), CELL, "left")
    columns = learn.choose_feature_columns(cells, "shape_neighborhood" if raw is None else "all", raw is not None)
    cells = stored(learn.outlier_scores(cells, columns, seed=config.seed), "scores")
    return learn.anomaly_score(cells, config.contamination)


def morphometry(voxels: DataFrame, volumes: DataFrame, raw: DataFrame | None = None, config: Config = Config()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All feature groups, the regions and the summary."""
    cells = anomaly(voxels, volumes, raw, config)
    cells = learn.cluster_cells(cells, learn.choose_feature_columns(cells, config.feature_set, raw is not None), config.clusters, config.seed)
    cells = stored(spatial.region_bins(cells, volumes, config.grid), "morphometry")
    regions = spatial.region_features(cells.drop("region_z_bin", "region_y_bin", "region_x_bin", "region_id"), volumes, grid=config.grid)
    return cell.public_cell_table(cells), regions, cell.summary_stats(cells)


def size_statistics(voxels: DataFrame, bins: int = 50) -> tuple[DataFrame, DataFrame]:
    """The size summary and its histogram."""
    return voxel.size_summary(voxels), cell.size_histogram(voxel.label_sizes(voxels), bins)


def finalize_segmentation(instances: DataFrame, volumes: DataFrame, raw: DataFrame | None = None, min_area: int = 20, min_size: int = 0, max_size: int | None = None, min_intensity: float | None = None, shape: bool = False) -> tuple[DataFrame, DataFrame]:
    """Labels, and confidence (vol_id, z, y, x, value), after cleaning and cut to the volume. Voxels without a label have no confidence.

    With ``shape`` both are resized to the volumes' tz, ty, tx: labels to the nearest source, confidence linearly.
    """
    inside = instances.join(volumes.select("vol_id", "nz", "ny", "nx"), "vol_id").where("z < nz AND y < ny AND x < nx").drop("nz", "ny", "nx")
    inside = stored(inside, "instances")
    labels = segment.clean_instances(inside.select("vol_id", "z", "y", "x", "label"), raw, min_area, min_size, max_size, min_intensity)
    labels = stored(labels.select("vol_id", "z", "y", "x", "label"), "labels")
    confidence = merge_join(inside.select("vol_id", "z", "y", "x", F.col("confidence").alias("value")), labels.drop("label"), ["vol_id", "z", "y", "x"], "left_semi")
    if shape:
        return geometry.resize_nearest(labels, volumes), geometry.resize_linear(confidence, volumes)
    return labels, confidence


def anisotropy(volumes: DataFrame) -> DataFrame:
    """The longest over the shortest side of a voxel."""
    return volumes.select("vol_id", (F.greatest("vz", "vy", "vx") / (F.least("vz", "vy", "vx") + EPS)).alias("voxel_anisotropy_ratio"))
