"""Spatial joins on cell tables: nearest neighbours, radius neighbours, local statistics, regions.

Cells carry coordinates in three columns. Pairs are found through a grid of buckets, by equi joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EPS, missing_if_nan, region_bin
from .metric import nearest_in_matrix
from .voxel import CELL

UM = ("centroid_z_um", "centroid_y_um", "centroid_x_um")
INDEX = ("centroid_z", "centroid_y", "centroid_x")


def _points(cells: DataFrame, coords: Sequence[str]) -> DataFrame:
    return cells.select(*CELL, *(F.col(c).cast("double").alias(a) for c, a in zip(coords, "zyx"))).where("z IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL")


def _near_pairs(left: DataFrame, right: DataFrame, side) -> DataFrame:
    """Pairs of different cells in the same or adjoining buckets of the given side, with their distance."""
    bucket = lambda a: F.floor(F.col(a) / side)
    here = left.withColumns({f"b{a}": bucket(a) for a in "zyx"})
    for a in "zyx":
        here = here.withColumn(f"b{a}", F.explode(F.array(*(F.col(f"b{a}") + d for d in (-1, 0, 1)))))
    there = right.withColumns({f"b{a}": bucket(a) for a in "zyx"})
    there = there.select("vol_id", *(f"b{a}" for a in "zyx"), F.col("label").alias("other"), *(F.col(a).alias(f"o{a}") for a in "zyx"))
    pairs = here.join(there, ["vol_id", "bz", "by", "bx"]).where("label <> other")
    distance = F.sqrt(sum((F.col(a) - F.col(f"o{a}")) * (F.col(a) - F.col(f"o{a}")) for a in "zyx"))
    return pairs.withColumn("distance", distance)


def radius_join(cells: DataFrame, radius: float, coords: Sequence[str] = UM) -> DataFrame:
    """(vol_id, label, other, distance) of all other cells within the radius, its end included."""
    p = _points(cells, coords)
    return _near_pairs(p, p, F.lit(float(radius))).where(F.col("distance") <= radius).select(*CELL, "other", "distance")


def knn_join(cells: DataFrame, k: int, coords: Sequence[str] = UM, block: int = 512) -> DataFrame:
    """(vol_id, label, other, distance, rank) of the k nearest other cells, or all if there are fewer; ties by label. Cells without coordinates have none.

    Cells are dealt into blocks of bounded size that follow the density, so a dense cluster is many blocks and not one; see ``metric.nearest_in_matrix``.
    """
    return nearest_in_matrix(_points(cells, coords), "zyx", k, block)


#: Ways to choose a cell's neighbours.
MODES = ("knn", "radius", "knn_radius", "contact", "all")


def neighbours(cells: DataFrame, mode: str, k: int = 10, radius: float = 20.0, edges: DataFrame | None = None, coords: Sequence[str] = UM) -> DataFrame:
    """(vol_id, label, other, distance) by mode: the k nearest, those within a radius, those of the k nearest that are within it, those in contact
    (``edges`` as of ``contact_edges``; a contact's distance is that of the centroids), or all three together, each pair once."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode in ("contact", "all") and edges is None:
        raise ValueError(f"mode {mode} needs the contact edges")
    found = []
    if mode in ("knn", "knn_radius", "all"):
        near = knn_join(cells, k, coords).drop("rank")
        found.append(near.where(F.col("distance") <= radius) if mode == "knn_radius" else near)
    if mode in ("radius", "all"):
        found.append(radius_join(cells, radius, coords))
    if mode in ("contact", "all"):
        p = _points(cells, coords)
        ends = edges.select("vol_id", F.col("label_a").alias("label"), F.col("label_b").alias("other"))
        both = ends.unionByName(ends.select("vol_id", F.col("other").alias("label"), F.col("label").alias("other")))
        other = p.select("vol_id", F.col("label").alias("other"), *(F.col(a).alias(f"o{a}") for a in "zyx"))
        pairs = both.join(p, CELL).join(other, ["vol_id", "other"])
        distance = F.sqrt(sum((F.col(a) - F.col(f"o{a}")) * (F.col(a) - F.col(f"o{a}")) for a in "zyx"))
        found.append(pairs.select(*CELL, "other", distance.alias("distance")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy(*CELL, "other").agg(F.min("distance").alias("distance")) if len(found) > 1 else out


_SPHERE = 4.0 / 3.0 * 3.141592653589793


def knn_features(cells: DataFrame, ks: Sequence[int] = (5, 10, 20), coords: Sequence[str] = UM, neighbours: DataFrame | None = None) -> DataFrame:
    """Nearest distance, and for each k the mean and median distance and the density of the k nearest."""
    near = knn_join(cells, max(ks), coords) if neighbours is None else neighbours
    aggs = [F.min("distance").alias("nearest_neighbor_distance_um")]
    for k in ks:
        d = F.when(F.col("rank") <= k, F.col("distance"))
        aggs += [F.avg(d).alias(f"knn_mean_distance_k{k}_um"), F.percentile(d, F.lit(0.5)).alias(f"knn_median_distance_k{k}_um"), (F.count(d) / (_SPHERE * F.pow(F.max(d), F.lit(3.0)) + EPS)).alias(f"local_density_k{k}_per_um3")]
    return cells.select(*CELL).join(near.groupBy(*CELL).agg(*aggs), CELL, "left")


def radius_features(cells: DataFrame, radius: float, coords: Sequence[str] = UM, unit: str = "um") -> DataFrame:
    """Number and density of the cells within a radius."""
    found = radius_join(cells, radius, coords).groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0)).cast("long")
    name = f"{radius:g}"
    return cells.select(*CELL).join(found, CELL, "left").select(*CELL, n.alias(f"radius_neighbor_count_r{name}_{unit}"), (n / (_SPHERE * radius**3 + EPS)).alias(f"radius_density_r{name}_per_{unit}3"))


def _against_neighbours(cells: DataFrame, near: DataFrame, features: Sequence[str], named) -> DataFrame:
    near = near.select(*CELL, "other")
    theirs = cells.select("vol_id", F.col("label").alias("other"), *(missing_if_nan(F.col(f)).alias(f"_{f}") for f in features))
    aggs = [g(f"_{f}").alias(f"_{s}_{f}") for f in features for s, g in (("mean", F.avg), ("std", F.stddev_pop))]
    stats = near.select(*CELL, "other").join(theirs, ["vol_id", "other"]).groupBy(*CELL).agg(*aggs)
    out = cells.select(*CELL, *features).join(stats, CELL, "left")
    return out.select(*CELL, *features, *(c for f in features for c in named(f)))


def local_neighbour_stats(cells: DataFrame, features: Sequence[str], k: int = 10, coords: Sequence[str] = UM, neighbours: DataFrame | None = None) -> DataFrame:
    """Mean and deviation of features over the k nearest cells, and each cell's deviation from them. ``neighbours``, if given, has the k nearest at least."""
    named = lambda f: [F.col(f"_mean_{f}").alias(f"neighbor_mean_{f}"), F.col(f"_std_{f}").alias(f"neighbor_std_{f}"), ((F.col(f) - F.col(f"_mean_{f}")) / (F.col(f"_std_{f}") + EPS)).alias(f"self_vs_neighbor_{f}_zscore")]
    near = knn_join(cells, k, coords) if neighbours is None else neighbours.where(F.col("rank") <= k)
    return _against_neighbours(cells, near, features, named)


def local_comparison(cells: DataFrame, feature: str, mode: str = "knn", k: int = 10, radius_vox: float = 20.0) -> DataFrame:
    """A feature against its finite values at the k nearest cells (micrometres) or within a radius (voxels)."""
    if mode not in ("knn", "radius"):
        raise ValueError(f"unknown mode {mode}")
    near = knn_join(cells, k, UM) if mode == "knn" else radius_join(cells, radius_vox, INDEX)
    named = lambda f: [F.col(f"_mean_{f}").alias(f"local_neighbor_mean_{f}"), F.col(f"_std_{f}").alias(f"local_neighbor_std_{f}"), ((F.col(f) - F.col(f"_mean_{f}")) / (F.col(f"_std_{f}") + EPS)).alias(f"local_zscore_{f}")]
    return _against_neighbours(cells, near, [feature], named)


def region_bins(cells: DataFrame, volumes: DataFrame, grid: Sequence[int] = (6, 6, 6)) -> DataFrame:
    """The grid bin of each cell's centroid, and its name."""
    at = cells.join(volumes.select("vol_id", *(f"n{a}" for a in "zyx"), *(f"v{a}" for a in "zyx")), "vol_id")
    at = at.withColumns({f"region_{a}_bin": region_bin(F.col(c), F.col(f"n{a}") * F.col(f"v{a}"), g) for a, c, g in zip("zyx", UM, grid)})
    at = at.withColumn("region_id", F.format_string("z%02d_y%02d_x%02d", "region_z_bin", "region_y_bin", "region_x_bin"))
    return at.select(*cells.columns, "region_z_bin", "region_y_bin", "region_x_bin", "region_id")


#: Features that regions are described by, as far as a table has them; local densities come beside.
REGION_FEATURES = ("volume_um3", "equivalent_diameter_um", "sphericity", "elongation", "flatness", "nearest_neighbor_distance_um", "anomaly_score")


def region_features(cells: DataFrame, volumes: DataFrame, features: Sequence[str] | None = None, grid: Sequence[int] = (6, 6, 6)) -> DataFrame:
    """Cells, volume, density and feature statistics of each region, and the share of outliers if their flag is there."""
    if features is None:
        features = [*(f for f in REGION_FEATURES if f in cells.columns), *(c for c in cells.columns if c.startswith("local_density_k") and c.endswith("_per_um3"))]
    binned = region_bins(cells, volumes, grid)
    aggs = [F.count(F.lit(1)).alias("region_cell_count")]
    for f in features:
        v = missing_if_nan(F.col(f))
        aggs += [F.avg(v).alias(f"region_mean_{f}"), F.percentile(v, F.lit(0.5)).alias(f"region_median_{f}"), F.stddev_pop(v).alias(f"region_std_{f}")]
    if "is_anomaly" in cells.columns:
        aggs.append(F.avg(F.col("is_anomaly").cast("double")).alias("region_outlier_fraction"))
    out = binned.groupBy("vol_id", "region_id").agg(*aggs).join(volumes, "vol_id")
    size = F.col("nz") * F.col("vz") * F.col("ny") * F.col("vy") * F.col("nx") * F.col("vx") / (grid[0] * grid[1] * grid[2])
    keep = [c for c in out.columns if c.startswith("region_") and c not in ("region_id", "region_cell_count")]
    return out.select("vol_id", "region_id", "region_cell_count", size.alias("region_volume_um3"), (F.col("region_cell_count") / (size + EPS)).alias("region_cell_density_per_um3"), *keep)
