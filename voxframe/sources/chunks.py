"""Volumes in chunks along a space-filling order, with a manifest of where each chunk lies.

Voxels are ordered by the Morton number of their chunk, so a file holds chunks that lie together. The manifest tells for each file and chunk what box its voxels
fill; a box, or the surroundings of many points, is then read from the files that it meets and no others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slices, rows and columns of a chunk, and voxels of a file.
CHUNK, FILE_ROWS = (1, 512, 512), 1 << 20
#: Bits of each coordinate of a chunk.
BITS = 20


def morton(z: Column, y: Column, x: Column) -> Column:
    """The bits of three numbers in turn, those of x lowest."""
    out = F.lit(0).cast("long")
    for place, c in enumerate((x, y, z)):
        c = c.cast("long")
        for bit in range(BITS):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c, bit).bitwiseAND(F.lit(1)), 3 * bit + place))
    return out


def write_chunks(rows: DataFrame, path: str, chunk: Sequence[int] = CHUNK, file_rows: int = FILE_ROWS) -> None:
    """The voxel table under ``path``/voxels in the order of its chunks, and ``path``/manifest."""
    number = morton(*(F.floor(F.col(a) / n) for a, n in zip("zyx", chunk)))
    ordered = rows.withColumn("chunk", number).repartitionByRange("vol_id", "chunk").sortWithinPartitions("vol_id", "chunk", "z", "y", "x")
    ordered.write.option("maxRecordsPerFile", file_rows).option("parquet.block.size", str(8 << 20)).parquet(f"{path}/voxels")
    written = rows.sparkSession.read.parquet(f"{path}/voxels")
    ends = [g(a).alias(f"{m}_{a}") for a in "zyx" for m, g in (("lo", F.min), ("hi", F.max))]
    written.groupBy(F.col("_metadata.file_path").alias("file"), "vol_id", "chunk").agg(*ends, F.count(F.lit(1)).alias("voxels")).coalesce(1).write.parquet(f"{path}/manifest")


def read_boxes(spark: SparkSession, path: str, boxes: DataFrame) -> DataFrame:
    """Rows of the voxel table in boxes (vol_id, box_id, lo_a, hi_a; half open), once for each box that a voxel is in.

    Only files with a chunk that meets a box are opened; of these, the row groups of the wanted chunks. The names of the files reach the driver.
    """
    wanted = spark.read.parquet(f"{path}/manifest").alias("m").join(boxes.alias("b"), "vol_id")
    wanted = wanted.where(" AND ".join(f"b.lo_{a} <= m.hi_{a} AND b.hi_{a} > m.lo_{a}" for a in "zyx")).select("file", "vol_id", "chunk", "box_id", *(F.col(f"b.{m}_{a}").alias(f"{m}_{a}") for a in "zyx" for m in ("lo", "hi")))
    files = [r.file for r in wanted.select("file").distinct().collect()]
    schema = spark.read.parquet(f"{path}/voxels").schema
    voxels = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    ends = wanted.agg(F.min("chunk"), F.max("chunk")).first()
    if files:  # row groups hold few chunks, so their least and greatest tell which to read
        voxels = voxels.where((F.col("chunk") >= ends[0]) & (F.col("chunk") <= ends[1]))
    found = voxels.join(wanted.drop("file").distinct(), ["vol_id", "chunk"]).where(" AND ".join(f"{a} >= lo_{a} AND {a} < hi_{a}" for a in "zyx"))
    return found.select("box_id", *(c for c in voxels.columns if c != "chunk"))


def read_box(spark: SparkSession, path: str, vol_id: str, low: Sequence[int], high: Sequence[int]) -> DataFrame:
    """P25: rows of the voxel table in one half-open box."""
    box = spark.createDataFrame([(vol_id, 0, *low, *high)], "vol_id string, box_id long, lo_z long, lo_y long, lo_x long, hi_z long, hi_y long, hi_x long")
    return read_boxes(spark, path, box).drop("box_id")


def crop_clicks(spark: SparkSession, path: str, volumes: DataFrame, clicks: DataFrame, patch: Sequence[int]) -> DataFrame:
    """The patches around clicks (see ``patches.crop_centered``), from the chunks that they meet."""
    from ..operators.patches import crop_centered

    at = clicks.join(volumes.select("vol_id", "nz", "ny", "nx"), "vol_id")
    ends = {}
    for a, p in zip("zyx", patch):  # mirrored at the ends, a patch needs no more than its own length from there
        ends[f"lo_{a}"] = F.greatest(F.least(F.col(f"c{a}") - p // 2, F.col(f"n{a}") - p), F.lit(0))
        ends[f"hi_{a}"] = F.least(F.greatest(F.col(f"c{a}") - p // 2 + p, F.lit(p)), F.col(f"n{a}"))
    boxes = at.select("vol_id", F.col("click_id").alias("box_id"), *(c.alias(n) for n, c in ends.items()))
    rows = read_boxes(spark, path, boxes).drop("box_id").distinct()
    return crop_centered(rows, volumes, clicks, patch)
