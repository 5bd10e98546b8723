"""From cells to cells: contact features, public tables, summaries, histograms, feature maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EPS, categorical_code, missing_if_nan, quantized_uint16
from .voxel import CELL

#: Names that stand for several columns.
EXPANDED = {"centroid": ["centroid_z_um", "centroid_y_um", "centroid_x_um"]}
#: Columns whose values are classes.
CATEGORICAL = ("cluster_id", "is_anomaly", "region_z_bin", "region_y_bin", "region_x_bin")
#: Columns of each group that maps may be made of.
GROUPS = {
    "morphology": ("volume_um3", "equivalent_diameter_um", "surface_area_um2", "sphericity", "compactness", "axis_major_um", "axis_intermediate_um", "axis_minor_um", "elongation", "flatness", "major_minor_ratio"),
    "intensity": ("mean_intensity", "std_intensity", "cv_intensity", "sum_intensity", "skewness_intensity", "kurtosis_intensity"),
    "neighborhood": ("nearest_neighbor_distance_um", "neighbor_mean_volume_um3", "self_vs_neighbor_volume_um3_zscore", "self_vs_neighbor_sphericity_zscore", "self_vs_neighbor_elongation_zscore"),
    "contact": ("contact_neighbor_count", "contact_area_total_um2", "contact_area_mean_um2", "contact_fraction"),
    "region": ("region_z_bin", "region_y_bin", "region_x_bin"),
    "anomaly": ("anomaly_score", "robust_z_log_volume", "robust_z_sphericity", "robust_z_elongation", "isolation_forest_score", "lof_score"),
    "cluster": ("cluster_id",),
}
#: Columns that maps are made of if nothing else is said.
CORE = ("volume_um3", "equivalent_diameter_um", "sphericity", "elongation", "nearest_neighbor_distance_um", "anomaly_score", "cluster_id")
#: Columns that a summary describes, as far as a table has them.
SUMMARY = ("volume_um3", "equivalent_diameter_um", "surface_area_um2", "sphericity", "elongation", "flatness", "nearest_neighbor_distance_um", "anomaly_score")


def merge_features(cells: DataFrame, *tables: DataFrame) -> DataFrame:
    """Left joins of feature tables on the cell."""
    for t in tables:
        cells = cells.join(t, CELL, "left")
    return cells


def edge_endpoints(edges: DataFrame) -> DataFrame:
    """Each edge from both its ends."""
    out = edges.select("vol_id", F.col("label_a").alias("label"), F.col("label_b").alias("other"), "contact_area_um2")
    return out.unionByName(edges.select("vol_id", F.col("label_b").alias("label"), F.col("label_a").alias("other"), "contact_area_um2"))


def contact_features(surfaces: DataFrame, edges: DataFrame) -> DataFrame:
    """Number, total, mean, greatest and share of the surface of each cell's contacts; 0 without any."""
    found = edge_endpoints(edges).groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n"), F.sum("contact_area_um2").alias("_total"), F.max("contact_area_um2").alias("_max"))
    out = surfaces.join(found, CELL, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("_n", "_total", "_max")})
    return out.select(
        *CELL, F.col("_n").cast("long").alias("contact_neighbor_count"), F.col("_total").cast("double").alias("contact_area_total_um2"),
        (F.col("_total") / (F.col("_n") + EPS)).alias("contact_area_mean_um2"), F.col("_max").cast("double").alias("contact_area_max_um2"),
        (F.col("_total") / (F.col("surface_area_um2") + EPS)).alias("contact_fraction"),
    )


def map_ids(table: DataFrame, numbers: DataFrame, columns: Sequence[str] = ("label",)) -> DataFrame:
    """Internal numbers back to the original labels, in each of the columns."""
    for c in columns:
        back = numbers.select("vol_id", F.col("new_label").alias(c), F.col("label").alias("_old"))
        table = table.join(back, ["vol_id", c]).drop(c).withColumnRenamed("_old", c)
    return table


def public_cell_table(cells: DataFrame) -> DataFrame:
    """``label_id`` first, without boxes and inner numbers."""
    hidden = {"label", "label_contiguous", *(c for c in cells.columns if c.startswith("bbox_"))}
    return cells.select("vol_id", F.col("label").alias("label_id"), *(c for c in cells.columns if c not in hidden | {"vol_id"}))


def select_features(cells: DataFrame, names: Sequence[str] | None = None) -> list[str]:
    """P10: the columns that requested names stand for, as far as they exist, in order; volume_um3 by default."""
    wanted = [c for n in (names or ["volume_um3"]) for c in EXPANDED.get(n, [n])]
    return [c for c in dict.fromkeys(wanted) if c in cells.columns] or ["volume_um3"]


def map_features(cells: DataFrame, mode: str = "core", groups: Sequence[str] = (), custom: Sequence[str] = ()) -> list[str]:
    """The numeric columns to paint: a few (``core``), those of ``groups``, those named (``custom``), or ``all``."""
    numeric = [c for c, t in cells.dtypes if t in ("double", "float", "int", "bigint", "boolean") and c not in ("label", "label_id") and not c.startswith("bbox_")]
    unknown = [g for g in groups if g not in GROUPS]
    if mode not in ("core", "groups", "custom", "all") or unknown:
        raise ValueError(f"unknown mode {mode}" if not unknown else f"unknown groups {unknown}")
    if mode == "groups":
        local = [c for c in numeric if c.startswith(("local_density_k", "radius_"))] if "neighborhood" in groups else []
        wanted = [*(c for g in groups for c in GROUPS[g]), *local]
    else:
        wanted = {"core": CORE, "custom": custom, "all": numeric}[mode]
    return [c for c in dict.fromkeys(wanted) if c in numeric]


def summary_stats(cells: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """A10: (metric, value) with the number of cells, each feature's mean, median, deviation and 5 % and 95 % points over its finite
    values (none if there are no such), and the share of anomalies where they are marked."""
    aggs = [F.count(F.lit(1)).cast("double").alias("cell_count_total")]
    for f in SUMMARY if features is None else features:
        if f not in cells.columns:
            continue
        v = missing_if_nan(F.col(f))
        p = F.percentile(v, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
        aggs += [F.avg(v).alias(f"{f}_mean"), p[1].alias(f"{f}_median"), F.stddev_pop(v).alias(f"{f}_std"), p[0].alias(f"{f}_q05"), p[2].alias(f"{f}_q95")]
    if "is_anomaly" in cells.columns:
        aggs.append(F.avg(F.col("is_anomaly").cast("double")).alias("anomaly_fraction"))
    wide = cells.groupBy("vol_id").agg(*aggs)
    return wide.unpivot(["vol_id"], wide.columns[1:], "metric", "value").where("value IS NOT NULL")


def size_histogram(sizes: DataFrame, bins: int = 50, column: str = "voxel_count") -> DataFrame:
    """Cells in equal-width bins between the least and the greatest size; the last bin is closed."""
    ends = sizes.groupBy("vol_id").agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    v = sizes.join(ends, "vol_id")
    at = F.when(F.col("_hi") == F.col("_lo"), F.lit(bins // 2)).otherwise(F.least(F.floor((F.col(column) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))), F.lit(bins - 1)))
    return v.groupBy("vol_id", at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("cells"))


def percentile_bounds(cells: DataFrame, feature: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    p = F.percentile(missing_if_nan(F.col(feature)), F.array(F.lit(low), F.lit(high)))
    return cells.groupBy("vol_id").agg(p[0].alias("p_low"), p[1].alias("p_high"))


def feature_codes(cells: DataFrame, features: Sequence[str]) -> DataFrame:
    """Each feature as an image value of 16 bits."""
    out = cells
    for f in features:
        if f in CATEGORICAL:
            out = out.withColumn(f, categorical_code(F.col(f).cast("int")))
        else:
            out = out.join(percentile_bounds(cells, f), "vol_id").withColumn(f, quantized_uint16(missing_if_nan(F.col(f)), F.col("p_low"), F.col("p_high"))).drop("p_low", "p_high")
    return out.select(*CELL, *features)


def feature_maps(voxels: DataFrame, cells: DataFrame, features: Sequence[str]) -> DataFrame:
    """The features' image values on every voxel of their cell, all features in one join."""
    return voxels.join(feature_codes(cells, features), CELL, "left").select("vol_id", "z", "y", "x", *(F.coalesce(f, F.lit(0)).alias(f) for f in features))


def feature_map_manifest(cells: DataFrame, features: Sequence[str], folder: str) -> DataFrame:
    """(group, feature, path, note) of the maps of features."""
    group = {f: g for g, names in GROUPS.items() for f in names}
    note = {True: "class number + 1, 0 where there is none", False: "0..65535 between the 1 % and 99 % points, 0 where there is no value"}
    rows = [(group.get(f, "other"), f, f"{folder}/{f}", note[f in CATEGORICAL]) for f in features if f in cells.columns]
    return cells.sparkSession.createDataFrame(rows, "group string, feature string, path string, note string")


def write_feature_maps(voxels: DataFrame, cells: DataFrame, features: Sequence[str], folder: str) -> DataFrame:
    """One map per feature, painted in one join, as tables of (vol_id, z, y, x, value); returns their manifest, which is written beside them."""
    features = [f for f in features if f in cells.columns]
    maps = feature_maps(voxels, cells, features).unpivot(["vol_id", "z", "y", "x"], list(features), "feature", "value")
    maps.write.partitionBy("feature").parquet(f"{folder}/maps")
    manifest = feature_map_manifest(cells, features, f"{folder}/maps").withColumn("path", F.concat(F.lit(f"{folder}/maps/feature="), "feature"))
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    return manifest


def preview(cells: DataFrame, n: int = 20) -> DataFrame:
    """O1: the first rows by label."""
    return cells.orderBy(*CELL).limit(n)
