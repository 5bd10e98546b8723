"""Resampling, boundary faces, polygons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import stored
from .voxel import VOXEL


def _axis_map(volumes: DataFrame, axis: str, target: str, linear: bool) -> DataFrame:
    """(vol_id, to, source index, weight): corner-aligned coordinates of the target axis; linear gives two sources each."""
    v = volumes.select("vol_id", F.col(f"n{axis}").alias("n"), F.col(target).cast("long").alias("m")).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    v = v.withColumn("at", F.when(F.col("m") > 1, F.col("to") * (F.col("n") - 1) / (F.col("m") - 1)).otherwise(0.0))
    if not linear:
        return v.select("vol_id", "to", F.least(F.floor(F.col("at") + 0.5), F.col("n") - 1).alias(axis), F.lit(1.0).alias("w"))
    low = F.least(F.floor("at"), F.col("n") - 1)
    part = F.col("at") - F.floor("at")
    two = F.array(F.struct(low.alias("s"), (1 - part).alias("w")), F.struct(F.least(low + 1, F.col("n") - 1).alias("s"), part.alias("w")))
    return v.withColumn("_t", F.explode(two)).where("_t.w > 0").select("vol_id", "to", F.col("_t.s").alias(axis), F.col("_t.w").alias("w"))


def resize_nearest(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """Labels on a grid of tz, ty, tx voxels (columns of ``volumes``), nearest source, corners aligned."""
    out = voxels
    for a in "zyx":
        out = out.join(_axis_map(volumes, a, f"t{a}", False).drop("w"), ["vol_id", a]).drop(a).withColumnRenamed("to", a)
    return out.select(*voxels.columns)


def resize_linear(raw: DataFrame, volumes: DataFrame) -> DataFrame:
    """R2: values on a grid of tz, ty, tx voxels by linear interpolation, axis after axis."""
    out = raw.select(*VOXEL, F.col("value").cast("double").alias("value"))
    for a in "zyx":
        rest = [c for c in VOXEL if c != a]
        out = out.join(_axis_map(volumes, a, f"t{a}", True), ["vol_id", a]).groupBy(*rest, "to").agg(F.sum(F.col("value") * F.col("w")).alias("value")).withColumnRenamed("to", a)
    return out.select(*VOXEL, "value")


def target_shape(volumes: DataFrame, factor: Sequence[float]) -> DataFrame:
    """The shape that shrinking by the factors gives, at least 1; halves round to even."""
    if min(factor) <= 0:
        raise ValueError("factors must be positive")
    return volumes.withColumns({f"t{a}": F.greatest(F.bround(F.col(f"n{a}") / float(f)), F.lit(1)).cast("long") for a, f in zip("zyx", factor)})


def downsample_volume(raw: DataFrame, volumes: DataFrame, factor: Sequence[float]) -> DataFrame:
    """The volume shrunk by the factors; as it is if all are 1."""
    return raw if all(f == 1 for f in factor) else resize_linear(raw, target_shape(volumes, factor))


#: Corner offsets (z, y, x) of a voxel's face at each side of each axis, in order around it.
_FACES = {
    ("z", -1): [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)], ("z", 1): [(1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1)],
    ("y", -1): [(0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)], ("y", 1): [(0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0)],
    ("x", -1): [(0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0)], ("x", 1): [(0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)],
}


def exposed_faces(voxels: DataFrame) -> DataFrame:
    """(vol_id, label, z, y, x, axis, side) of the voxel faces behind which another label or nothing lies.

    Neighbours along y and x are in the same slice, so one shuffle serves both axes, and one more the third.
    """
    v, open_ = voxels.select(*VOXEL, "label"), []
    for a, dealt in (("y", "z"), ("x", "z"), ("z", "y")):
        if a != "x":
            v = v.withColumn("_at", F.xxhash64("vol_id", dealt)).repartition("_at")  # a key that stays where all rows are known to be of one volume
        line = Window.partitionBy("_at", "vol_id", dealt, *[c for c in "zyx" if c not in (a, dealt)]).orderBy(a)
        for side, f in ((-1, F.lag), (1, F.lead)):
            same = (f(a).over(line) == F.col(a) + side) & (f("label").over(line) == F.col("label"))
            v = v.withColumn(f"_{a}{side}", ~F.coalesce(same, F.lit(False)))
            open_.append(F.when(F.col(f"_{a}{side}"), F.struct(F.lit(a).alias("axis"), F.lit(side).alias("side"))))
    found = v.withColumn("_f", F.explode(F.filter(F.array(*open_), lambda f: f.isNotNull())))
    return found.select("vol_id", "label", "z", "y", "x", "_f.axis", "_f.side")


def surface_faces(voxels: DataFrame, z_ratio: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of each label's boundary: corners numbered from 0 in each label with coordinates X, Y, Z * z_ratio, and two triangles for each voxel face.

    A label's faces meet in one shuffle. Corners get their numbers there and return to their faces, without a join; the face at which a corner is seen first gives its row to the vertices.
    """
    corners = F.create_map(*(x for (a, s), c in _FACES.items() for x in (F.lit(f"{a}{s}"), F.array(*(F.struct(F.lit(i).alias("i"), *(F.lit(v).alias(n) for v, n in zip(p, "zyx"))) for i, p in enumerate(c))))))
    face = ["vol_id", "label", "z", "y", "x", "_s"]
    faces = exposed_faces(voxels).select(*face[:-1], F.concat("axis", F.col("side").cast("string")).alias("_s")).withColumn("_at", F.xxhash64("vol_id", "label")).repartition("_at")
    at = faces.withColumn("_c", F.explode(corners[F.col("_s")])).select("_at", *face, "_c.i", *((F.col(n) + F.col(f"_c.{n}")).alias(f"_{n}") for n in "zyx"))
    place = Window.partitionBy("_at", "vol_id", "label").orderBy("_z", "_y", "_x")
    at = at.withColumn("_v", (F.dense_rank().over(place) - 1).cast("long")).withColumn("_own", F.row_number().over(place) - F.rank().over(place) == 0)
    of = lambda c: [F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for i in range(4)]
    quads = stored(at.groupBy("_at", *face).agg(*of("_v"), *of("_own")).drop("_at"), "mesh-faces")
    own = F.filter(F.array(*(F.when(F.col(f"_own{i}"), F.struct(F.col(f"_v{i}").alias("vertex"), corners[F.col("_s")][i].alias("c"))) for i in range(4))), lambda p: p.isNotNull())
    seen = quads.select(*face[:-1], F.explode(own).alias("p"))
    vertices = seen.select("vol_id", "label", "p.vertex", (F.col("x") + F.col("p.c.x")).cast("double").alias("X"), (F.col("y") + F.col("p.c.y")).cast("double").alias("Y"), ((F.col("z") + F.col("p.c.z")) * z_ratio).alias("Z"))
    halves = F.array(*(F.struct(*(F.col(f"_v{i}").alias(n) for n, i in zip("abc", t))) for t in ((0, 1, 2), (0, 2, 3))))
    return vertices, quads.select("vol_id", "label", F.explode(halves).alias("t")).select("vol_id", "label", "t.a", "t.b", "t.c")


def smooth_polygons(vertices: DataFrame, samples: int = 16) -> DataFrame:
    """Closed Catmull-Rom curves through the polygons' vertices, ``samples`` points (at least 4) a segment; those of under three vertices as they are."""
    samples = max(4, samples)
    ring = Window.partitionBy("vol_id", "roi_id").orderBy("ord")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = vertices.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_i", F.row_number().over(ring) - 1)
    for c in ("y", "x"):
        v = v.withColumn(f"_{c}", F.collect_list(F.col(c).cast("double")).over(whole))
    v = v.withColumn("_k", F.explode(F.when(F.col("_n") < 3, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(samples - 1)))))
    t = F.col("_k") / samples

    def curve(c: str):
        p = [F.col(f"_{c}")[F.pmod(F.col("_i") + d, F.col("_n")).cast("int")] for d in (-1, 0, 1, 2)]
        return 0.5 * (2 * p[1] + (p[2] - p[0]) * t + (2 * p[0] - 5 * p[1] + 4 * p[2] - p[3]) * t * t + (3 * p[1] - p[0] - 3 * p[2] + p[3]) * t * t * t)

    out = v.select("vol_id", "roi_id", (F.col("_i") * samples + F.col("_k")).cast("long").alias("ord"), "z", *(F.when(F.col("_n") < 3, F.col(c).cast("double")).otherwise(curve(c)).alias(c) for c in ("y", "x")))
    same = (F.lag("y").over(ring) == F.col("y")) & (F.lag("x").over(ring) == F.col("x"))
    return out.withColumn("_same", F.coalesce(same, F.lit(False))).where("NOT _same").drop("_same")


def polygon_edges(vertices: DataFrame) -> DataFrame:
    """The sides of closed polygons of three finite vertices or more, with the slice they belong to: the rounded median of their z."""
    ring = Window.partitionBy("vol_id", "roi_id").orderBy("ord")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fine = vertices.where("y IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL AND NOT isnan(y) AND NOT isnan(x)")
    at = fine.groupBy("vol_id", "roi_id").agg(F.bround(F.percentile("z", F.lit(0.5))).cast("long").alias("slice"), F.count(F.lit(1)).alias("_n")).where("_n >= 3")
    e = fine.withColumns({"y2": F.coalesce(F.lead("y").over(ring), F.first("y").over(whole)), "x2": F.coalesce(F.lead("x").over(ring), F.first("x").over(whole))})
    return e.join(at, ["vol_id", "roi_id"]).select("vol_id", "roi_id", F.col("slice").alias("z"), F.col("y").cast("double").alias("y1"), F.col("x").cast("double").alias("x1"), F.col("y2").cast("double").alias("y2"), F.col("x2").cast("double").alias("x2"))


def points_in_polygons(vertices: DataFrame, volumes: DataFrame) -> DataFrame:
    """(vol_id, roi_id, z, y, x): the pixels of its slice whose centre lies inside a polygon, by even and odd crossings.

    Each side is met only by the rows that it crosses, and each crossing turns the pixels of its row to the right of it.
    """
    e = polygon_edges(vertices).join(volumes.select("vol_id", "nz", "ny", "nx"), "vol_id").where("y1 <> y2")
    e = e.withColumn("z", F.least(F.greatest("z", F.lit(0)), F.col("nz") - 1))
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.greatest(F.ceil(lo), F.lit(0)), F.least(F.ceil(hi) - 1, F.col("ny") - 1)
    hit = e.where(first <= last).withColumn("y", F.explode(F.sequence(first, last)))
    cross = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    hit = hit.withColumn("cross", cross)
    line = Window.partitionBy("vol_id", "roi_id", "z", "y").orderBy("cross")
    spans = hit.withColumn("_i", F.row_number().over(line)).withColumn("to", F.lead("cross").over(line)).where("_i % 2 = 1 AND to IS NOT NULL")
    a, b = F.greatest(F.floor("cross") + 1, F.lit(0)), F.least(F.floor("to"), F.col("nx") - 1)
    return spans.where(a <= b).withColumn("x", F.explode(F.sequence(a, b))).select("vol_id", "roi_id", "z", "y", "x")


def rasterize_polygons(vertices: DataFrame, volumes: DataFrame, smooth: bool = False) -> DataFrame:
    """(vol_id, z, y, x) of all pixels inside any polygon of a slice."""
    return points_in_polygons(smooth_polygons(vertices) if smooth else vertices, volumes).select(*VOXEL).distinct()
