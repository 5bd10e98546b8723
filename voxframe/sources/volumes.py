"""Readers and writers of volumes, tables, logs and meshes."""

from __future__ import annotations

import io
import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scratch import shuffles_let_go, write_table
from .npy import read_npy

VOXEL_ROWS = "path string, z long, y long, x long, value double"


def _decode(batches):
    """Rows of each .npy file; singleton axes are dropped, a 2D array is one slice."""
    for pdf in batches:
        for path, content in zip(pdf.path, pdf.content):
            a = np.squeeze(np.load(io.BytesIO(content), allow_pickle=False))
            if a.ndim > 3:
                raise ValueError(f"{path}: expected three axes, got {a.ndim}")
            a = a.reshape((1,) * (3 - a.ndim) + a.shape)
            for z in range(a.shape[0]):  # a slice at a time
                y, x = np.indices(a.shape[1:])
                yield pd.DataFrame({"path": path, "z": z, "y": y.ravel(), "x": x.ravel(), "value": a[z].ravel().astype(float)})


def read_npy_stack(spark: SparkSession, path: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """Voxel rows of .npy files, one task per file; (path, z, y, x, value)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return decode_npy(files.select("path", "content"))


def decode_npy(files: DataFrame) -> DataFrame:
    """Voxel rows of (path, content) with the bytes of .npy files."""
    return files.select("path", "content").mapInPandas(_decode, VOXEL_ROWS)


def encode_npy(rows: DataFrame, value: str = "value") -> DataFrame:
    """(path, content), the bytes of an .npy file for each slice, voxels without a row 0; a slice is the most that a task holds."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1))
        a[pdf.y, pdf.x] = pdf[value]
        out = io.BytesIO()
        np.save(out, a)
        return pd.DataFrame({"path": [f"{key[0]}/{key[1]}"], "content": [out.getvalue()]})

    return rows.select("vol_id", "z", "y", "x", value).groupBy("vol_id", "z").applyInPandas(pack, "path string, content binary")


def read_time_series(spark: SparkSession, folder: str) -> DataFrame:
    """All .npy files of a folder, in the order of their names, as frames t; (t, z, y, x, value). An empty folder has no rows."""
    return read_npy(spark, folder).select("t", "z", "y", "x", "value")


def read_volume(spark: SparkSession, path: str, z: tuple[int, int] | None = None, volumes: DataFrame | None = None) -> DataFrame:
    """S3: a voxel table from Parquet, or from .npy by the suffix; slices can be chosen, and others are not read.

    With ``volumes`` (vol_id, nz, ny, nx), a voxel outside its volume, or of none, is an error; the voxels are looked through once for that.
    """
    if path.endswith(".npy"):
        return read_npy(spark, path, z).drop("t").withColumnRenamed("path", "vol_id")
    rows = spark.read.parquet(path)
    rows = rows if z is None else rows.where((F.col("z") >= z[0]) & (F.col("z") < z[1]))
    if volumes is not None:
        at = rows.join(volumes.select("vol_id", "nz", "ny", "nx"), "vol_id", "left")
        bad = at.where(" OR ".join(f"n{a} IS NULL OR {a} IS NULL OR {a} < 0 OR {a} >= n{a}" for a in "zyx")).limit(1).collect()
        if bad:
            raise ValueError(f"a voxel lies outside its volume: {bad[0].asDict()}")
    return rows


def write_volume(rows: DataFrame, path: str, slices_per_chunk: int = 16) -> None:
    """A voxel table as Parquet, a folder for each volume and chunk of slices."""
    rows.withColumn("z_chunk", F.expr(f"z div {slices_per_chunk}")).write.partitionBy("vol_id", "z_chunk").parquet(path)


def empty_label(spark: SparkSession, volumes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A label volume without labels, and its metadata with 1 as the next label."""
    return spark.createDataFrame([], "vol_id string, z long, y long, x long, label long"), volumes.withColumn("next_label_id", F.lit(1).cast("long"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]+)?$", 1)


def common_stems(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Names that both sides have."""
    return images.select(stem(F.col("path")).alias("stem")).intersect(labels.select(stem(F.col("path")).alias("stem")))


def pair_files(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(stem, image, label) of files with the same name, in order. An error if there are none."""
    i = images.select(stem(F.col("path")).alias("stem"), F.col("path").alias("image"))
    out = i.join(labels.select(stem(F.col("path")).alias("stem"), F.col("path").alias("label")), "stem")
    if not out.limit(1).count():
        raise ValueError("no image has a label file of the same name")
    return out.orderBy("stem")


def training_records(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with image_id, the image's place among all images by name, from 0; unmatched images leave gaps."""
    i = images.select(stem(F.col("path")).alias("stem"), F.col("path").alias("image")).withColumn("image_id", (F.row_number().over(Window.orderBy("image")) - 1).cast("long"))  # one row per file
    return i.join(labels.select(stem(F.col("path")).alias("stem"), F.col("path").alias("label")), "stem").select("image_id", "image", "label")


def distinct_files(*tables: DataFrame) -> DataFrame:
    """The different paths of many listings."""
    out = tables[0].select("path")
    for t in tables[1:]:
        out = out.union(t.select("path"))
    return out.distinct()


def batch_plan(inputs: DataFrame, outputs: DataFrame, skip_existing: bool = True) -> DataFrame:
    """(path, status): ``skipped`` where an output of the same name exists, else ``todo``."""
    done = outputs.select(stem(F.col("path")).alias("stem"), F.lit(True).alias("_done")).distinct()
    out = inputs.select("path", stem(F.col("path")).alias("stem")).distinct().join(done, "stem", "left")
    return out.select("path", F.when(F.col("_done") & F.lit(skip_existing), "skipped").otherwise("todo").alias("status"))


def batch_summary(runs: DataFrame) -> DataFrame:
    """Number of files by status."""
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


#: Names of each task's tables.
TASK_TABLES = {
    "basic_info": ("features", "summary"), "neighborhood": ("features", "summary"), "contact": ("features", "summary", "edges"), "clustering": ("features", "summary"),
    "local_comparison": ("features", "summary"), "morphology": ("features",), "intensity": ("features",), "region": ("features", "regions"), "anomaly": ("features",),
}


def write_task_csv(tables: DataFrame | Sequence[DataFrame], folder: str, task: str) -> list[str]:
    """A task's tables as CSV with a header, each under the task's name and its own."""
    tables = [tables] if isinstance(tables, DataFrame) else list(tables)
    paths = [f"{folder}/{task}_{what}" for what in TASK_TABLES[task]]
    for df, path in zip(tables, paths):
        df.write.option("header", True).csv(path)
    return paths[: len(tables)]


def parameters(spark: SparkSession, config: dict, volumes: DataFrame) -> DataFrame:
    """(vol_id, parameters): the run's configuration, values as they are, and derived facts of each volume, as JSON."""
    facts = F.to_json(F.struct(F.array("nz", "ny", "nx").alias("label_shape"), F.array("vz", "vy", "vx").alias("voxel_size_um"), (F.col("vz") * F.col("vy") * F.col("vx")).alias("voxel_volume_um3")))
    return volumes.select("vol_id", F.concat(F.lit('{"config":' + json.dumps(config, sort_keys=True, default=list) + ',"derived":'), facts, F.lit("}")).alias("parameters"))


def write_parameters(spark: SparkSession, config: dict, volumes: DataFrame, path: str) -> None:
    """The parameters of each volume as a line of JSON text."""
    parameters(spark, config, volumes).select("parameters").write.text(path)


def append_log(entries: DataFrame, path: str) -> None:
    """Edits added to the log's table."""
    entries.write.mode("append").parquet(path)


def save_mesh(vertices: DataFrame, faces: DataFrame, path: str, z_ratio: float = 1.0) -> None:
    """Vertices, faces and counts of a mesh."""
    vertices, faces = (write_table(rows, f"{path}/{name}") for rows, name in ((vertices, "vertices"), (faces, "faces")))
    counts = vertices.groupBy("vol_id", "label").agg(F.count(F.lit(1)).alias("n_vertices")).join(faces.groupBy("vol_id", "label").agg(F.count(F.lit(1)).alias("n_faces")), ["vol_id", "label"], "left")
    counts.withColumn("z_ratio", F.lit(z_ratio)).write.parquet(f"{path}/meta")


def load_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{p}") for p in ("vertices", "faces", "meta"))


def write_training_patches(images: DataFrame, labels: DataFrame, path: str, folders: bool = False) -> None:
    """Image and label rows of the patches; a patch's rows lie together in one file, in the order of the names.

    With ``folders`` a patch has a folder of its own. For many patches these take more time to make and to list than their rows.
    """
    for rows, name in ((images, "images"), (labels, "labels")):
        with shuffles_let_go(rows.sparkSession):
            out = rows.repartition("vol_id", "patch_name").sortWithinPartitions("vol_id", "patch_name").write
            (out.partitionBy("patch_name") if folders else out).parquet(f"{path}/{name}")


def sample_volume(spark: SparkSession, shape: Sequence[int] = (16, 64, 64), cells: int = 20, radius: int = 5, seed: int = 0) -> DataFrame:
    """A volume of balls around pseudo-random centres; of balls that overlap the first label counts."""
    at = lambda a, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(a), "label"), F.lit(n))
    c = spark.range(1, cells + 1).withColumnRenamed("id", "label").withColumns({f"c{a}": at(a, n) for a, n in zip("zyx", shape)})
    for a in "zyx":
        c = c.withColumn(a, F.explode(F.sequence(F.col(f"c{a}") - radius, F.col(f"c{a}") + radius)))
    inside = " + ".join(f"({a}-c{a})*({a}-c{a})" for a in "zyx") + f" <= {radius * radius} AND " + " AND ".join(f"{a} >= 0 AND {a} < {n}" for a, n in zip("zyx", shape))
    return c.where(inside).groupBy("z", "y", "x").agg(F.min("label").alias("label")).select(F.lit("sample").alias("vol_id"), "z", "y", "x", "label")


def sample_time_series(volume: DataFrame, shape: Sequence[int], frames: int = 5) -> DataFrame:
    """Frames t of a volume, each rolled by 2 t in y and x."""
    out = volume.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))
    return out.withColumns({a: F.pmod(F.col(a) + 2 * F.col("t"), F.lit(n)) for a, n in zip("yx", shape[1:])})
