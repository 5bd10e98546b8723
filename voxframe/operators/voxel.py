"""From voxels to cells: sizes, boxes, faces, contacts, intensities and axes of each label.

A label volume is a table (vol_id, z, y, x, label) with one row per foreground voxel, a raw volume
(vol_id, z, y, x, value) one row per voxel, and ``volumes`` one row per volume with nz, ny, nx, vz, vy, vx.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EPS, compactness, equivalent_diameter, sphericity, symmetric_eigenvalues, width_of_label
from ..functions.joins import merge_join

VOXEL = ["vol_id", "z", "y", "x"]
CELL = ["vol_id", "label"]


def foreground(voxels: DataFrame) -> DataFrame:
    """Positive labels only, as whole numbers."""
    return voxels.withColumn("label", F.col("label").cast("long")).where("label > 0")


def validated(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """The voxels, or an error if there are none or one lies outside its volume."""
    if not voxels.limit(1).count():
        raise ValueError("no labels in the volume")
    known = voxels.join(volumes.select("vol_id", "nz", "ny", "nx"), "vol_id", "left")
    if known.where("nz IS NULL OR z < 0 OR y < 0 OR x < 0 OR z >= nz OR y >= ny OR x >= nx").limit(1).count():
        raise ValueError("a voxel lies outside its volume")
    return voxels


def label_sizes(voxels: DataFrame) -> DataFrame:
    """A1: voxels of each label."""
    return voxels.groupBy(*CELL).agg(F.count(F.lit(1)).alias("voxel_count"))


def size_summary(voxels: DataFrame) -> DataFrame:
    """A1: number of labels and their least and greatest size, for each volume."""
    return label_sizes(voxels).groupBy("vol_id").agg(F.count(F.lit(1)).alias("n_labels"), F.min("voxel_count").alias("min_size"), F.max("voxel_count").alias("max_size"))


def distinct_labels(voxels: DataFrame) -> DataFrame:
    """The labels that occur, in order."""
    return voxels.select(*CELL).distinct().orderBy(*CELL)


def label_width(voxels: DataFrame) -> DataFrame:
    """Narrowest unsigned type for each volume's labels."""
    return voxels.groupBy("vol_id").agg(width_of_label(F.max("label")).alias("label_type"), F.max("label").alias("max_label"))


def basic_features(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """Size, volume, diameter, centroid, box and border contact of each cell, in one aggregation."""
    cells = voxels.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("voxel_count"),
        *(F.sum(a).alias(f"_sum_{a}") for a in "zyx"), *(F.min(a).alias(f"bbox_{a}_min") for a in "zyx"), *(F.max(a).alias(f"bbox_{a}_max") for a in "zyx"),
    )
    cells = cells.join(volumes.select("vol_id", "nz", "ny", "nx", "vz", "vy", "vx"), "vol_id")
    n = F.col("voxel_count")
    volume = n * F.col("vz") * F.col("vy") * F.col("vx")
    border = [(F.col(f"bbox_{a}_min") == 0) | (F.col(f"bbox_{a}_max") == F.col(f"n{a}") - 1) for a in "zyx"]
    return cells.select(
        *CELL, "voxel_count", volume.alias("volume_um3"), equivalent_diameter(volume).alias("equivalent_diameter_um"),
        *((F.col(f"_sum_{a}") / n).alias(f"centroid_{a}") for a in "zyx"), *((F.col(f"_sum_{a}") / n * F.col(f"v{a}")).alias(f"centroid_{a}_um") for a in "zyx"),
        *(F.col(f"bbox_{a}_{m}") for a in "zyx" for m in ("min", "max")), (border[0] | border[1] | border[2]).alias("touch_border"),
    )


def adjacency(voxels: DataFrame) -> DataFrame:
    """How many faces labels a <= b share across each axis; a = b inside a cell.

    Neighbours come from ``lead`` along an axis, without a join. One shuffle by (vol_id, z) serves the y and x axes.
    """
    by_slice = voxels.select(*VOXEL, "label").repartition("vol_id", "z")

    def along(rows: DataFrame, axis: str) -> DataFrame:
        line = Window.partitionBy(*[c for c in VOXEL if c != axis]).orderBy(axis)
        pairs = rows.withColumns({"_next": F.lead("label").over(line), "_at": F.lead(axis).over(line)}).where(F.col("_at") == F.col(axis) + 1)
        return pairs.select("vol_id", F.least("label", "_next").alias("label_a"), F.greatest("label", "_next").alias("label_b"), F.lit(axis).alias("axis"))

    pairs = along(voxels.select(*VOXEL, "label"), "z").union(along(by_slice, "y")).union(along(by_slice, "x"))
    return pairs.groupBy("vol_id", "label_a", "label_b").agg(*(F.sum((F.col("axis") == a).cast("long")).alias(f"faces_{a}") for a in "zyx"))


def _area():
    return F.col("faces_z") * F.col("vy") * F.col("vx") + F.col("faces_y") * F.col("vz") * F.col("vx") + F.col("faces_x") * F.col("vz") * F.col("vy")


def surface_area(voxels: DataFrame, volumes: DataFrame, faces: DataFrame | None = None) -> DataFrame:
    """A4: area of the faces that a cell does not share with itself; the volume's border is exposed."""
    inner = (adjacency(voxels) if faces is None else faces).where("label_a = label_b").withColumnRenamed("label_a", "label").drop("label_b")
    cells = label_sizes(voxels).join(inner, CELL, "left").join(volumes.select("vol_id", "vz", "vy", "vx"), "vol_id")
    cells = cells.withColumns({f"faces_{a}": 2 * F.col("voxel_count") - 2 * F.coalesce(f"faces_{a}", F.lit(0)) for a in "zyx"})
    return cells.select(*CELL, _area().alias("surface_area_um2"))


def contact_edges(voxels: DataFrame, volumes: DataFrame, faces: DataFrame | None = None) -> DataFrame:
    """A5: area of the faces that two cells share, one row per touching pair a < b."""
    edges = (adjacency(voxels) if faces is None else faces).where("label_a < label_b").join(volumes.select("vol_id", "vz", "vy", "vx"), "vol_id")
    return edges.select("vol_id", "label_a", "label_b", _area().alias("contact_area_um2"))


def shape_features(cells: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Sphericity and compactness."""
    cells = cells.join(surfaces, CELL, "left")
    return cells.withColumns({"sphericity": sphericity(F.col("volume_um3"), F.col("surface_area_um2")), "compactness": compactness(F.col("volume_um3"), F.col("surface_area_um2"))})


def raw_at_label(voxels: DataFrame, raw: DataFrame) -> DataFrame:
    """The intensity of each labelled voxel."""
    return merge_join(voxels, raw, VOXEL)


def intensity_features(voxels: DataFrame, raw: DataFrame) -> DataFrame:
    """Mean, deviation, variation, extremes, sum, skewness and excess kurtosis of each cell's intensity, from power sums."""
    v = F.col("value").cast("double")
    sums = raw_at_label(voxels, raw).groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(v).alias("_1"), F.sum(v * v).alias("_2"), F.sum(v * v * v).alias("_3"), F.sum(v * v * v * v).alias("_4"),
        F.min(v).alias("min_intensity"), F.max(v).alias("max_intensity"),
    )
    m = F.col("_1") / F.col("_n")
    m2, m3, m4 = (F.col(f"_{k}") / F.col("_n") for k in (2, 3, 4))
    out = sums.withColumn("mean_intensity", m).withColumn("_var", F.greatest(m2 - m * m, F.lit(0.0))).withColumn("std_intensity", F.sqrt("_var"))
    return out.select(
        *CELL, "mean_intensity", "std_intensity", (F.col("std_intensity") / (F.abs("mean_intensity") + EPS)).alias("cv_intensity"), "min_intensity", "max_intensity",
        F.col("_1").alias("sum_intensity"),
        ((m3 - 3 * m * m2 + 2 * m * m * m) / (F.pow("std_intensity", F.lit(3.0)) + EPS)).alias("skewness_intensity"),
        ((m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m * m * m * m) / (F.col("_var") * F.col("_var") + EPS) - 3).alias("kurtosis_intensity"),
    )


#: Pairs of axes of the covariance matrix, diagonal first.
_PAIRS = ("zz", "yy", "xx", "zy", "zx", "yx")


def covariances(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """Sample covariances of each cell's coordinates in micrometres, from exact whole sums."""
    sums = voxels.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), *(F.sum(a).alias(f"s_{a}") for a in "zyx"), *(F.sum(F.col(p[0]) * F.col(p[1])).alias(f"s_{p}") for p in _PAIRS))
    sums = sums.join(volumes.select("vol_id", "vz", "vy", "vx"), "vol_id")
    cov = {p: (F.col("n") * F.col(f"s_{p}") - F.col(f"s_{p[0]}") * F.col(f"s_{p[1]}")) / (F.col("n") * (F.col("n") - 1)) * F.col(f"v{p[0]}") * F.col(f"v{p[1]}") for p in _PAIRS}
    return sums.select(*CELL, "n", *(F.when(F.col("n") >= 5, c).alias(f"cov_{p}") for p, c in cov.items()))


def pca_axes(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """Axes of each cell as 2 sqrt(5 eigenvalue), elongation and flatness; missing under 5 voxels. Exact for any size."""
    out = covariances(voxels, volumes)
    for name, sql in symmetric_eigenvalues(*(f"cov_{p}" for p in _PAIRS)).items():
        out = out.withColumn(name, F.expr(sql))
    axis = {name: 2 * F.sqrt(5 * F.col(f"eig_{k}")) for k, name in ((1, "axis_major_um"), (2, "axis_intermediate_um"), (3, "axis_minor_um"))}
    out = out.withColumns({k: F.when(F.col("n") >= 5, v) for k, v in axis.items()})
    ratio = F.col("axis_major_um") / (F.col("axis_minor_um") + EPS)
    return out.select(*CELL, *axis, ratio.alias("elongation"), ratio.alias("major_minor_ratio"), (F.col("axis_intermediate_um") / (F.col("axis_minor_um") + EPS)).alias("flatness"))


def principal_directions(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """The unit vector of each cell's major axis, its largest entry positive. NumPy solves batches of 3 x 3 matrices inside tasks."""
    import numpy as np
    import pandas as pd

    def solve(batches):
        for pdf in batches:
            m = np.empty((len(pdf), 3, 3))
            for i, a in enumerate("zyx"):
                for j, b in enumerate("zyx"):
                    m[:, i, j] = pdf[f"cov_{a}{b}" if f"{a}{b}" in _PAIRS else f"cov_{b}{a}"]
            v = np.linalg.eigh(m)[1][:, :, -1]
            v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None] if len(v) else v
            yield pd.DataFrame({"vol_id": pdf.vol_id, "label": pdf.label, **{f"orientation_{a}": v[:, i] for i, a in enumerate("zyx")}})

    whole = covariances(voxels, volumes).where("n >= 5")
    return whole.mapInPandas(solve, "vol_id string, label long, orientation_z double, orientation_y double, orientation_x double")


def relabel_sequential(voxels: DataFrame, keys: tuple[str, ...] = ("vol_id",)) -> DataFrame:
    """Labels 1..N in ascending order of the old ones. The window runs over the labels, never over voxels."""
    numbers = label_numbers(voxels, keys)
    return merge_join(voxels, numbers, [*keys, "label"]).drop("label").withColumnRenamed("new_label", "label").select(*voxels.columns)


def label_numbers(voxels: DataFrame, keys: tuple[str, ...] = ("vol_id",)) -> DataFrame:
    """The new number of each label."""
    return voxels.select(*keys, "label").where("label > 0").distinct().withColumn("new_label", F.row_number().over(Window.partitionBy(*keys).orderBy("label")).cast("long"))


def next_label_id(voxels: DataFrame) -> DataFrame:
    """The label after the largest, for each volume."""
    return voxels.groupBy("vol_id").agg((F.max("label") + 1).alias("next_label_id"))


def foreground_per_slice(voxels: DataFrame) -> DataFrame:
    """Foreground voxels and labels of each slice."""
    return voxels.groupBy("vol_id", "z").agg(F.count(F.lit(1)).alias("pixels"), F.countDistinct("label").alias("instances"))


def richest_slice(voxels: DataFrame) -> DataFrame:
    """Of each volume the slice with most foreground, the first of equal ones."""
    return foreground_per_slice(voxels).groupBy("vol_id").agg(F.max_by("z", F.struct("pixels", (-F.col("z")).alias("first"))).alias("z"), F.max("pixels").alias("pixels"))
