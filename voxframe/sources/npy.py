"""A data source for .npy volumes: one partition per slab of a file, read by its place in the file.

Files lie in a folder that the driver and all executors see under the same path. (``volumes.read_npy_stack`` reads whole files
from any store that Spark can read, one task per file.)
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from glob import glob
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "path string, t long, z long, y long, x long, value double"
#: Bytes of an array that one partition reads.
SLAB = 1 << 26
#: Values that a task holds when a file is written.
PIECE = 1 << 20


def local_path(path: str) -> str:
    """A plain path of a mounted folder or file."""
    scheme, _, rest = path.partition(":")
    if rest.startswith("/") and len(scheme) > 1:
        if scheme != "file":
            raise ValueError(f"{path}: this source reads mounted folders; for other stores see read_npy_stack")
        return "/" + rest.lstrip("/")
    return path


def files_of(path: str, recursive: bool) -> list[str]:
    """The .npy files of a path, in the order of their names."""
    own = local_path(path)
    if os.path.isdir(own):
        return sorted(glob(f"{glob_safe(own)}/**/*.npy" if recursive else f"{glob_safe(own)}/*.npy", recursive=recursive))
    return sorted(glob(own)) if "*" in own else [own]


def glob_safe(path: str) -> str:
    return "".join(f"[{c}]" if c in "*?[" else c for c in path)


def opened(path: str) -> np.ndarray:
    """The array of a file in place, with three axes; ones of length 1 are dropped first, and a plane is one slice. Volumes of more axes are an error."""
    a = np.load(path, mmap_mode="r", allow_pickle=False)
    if not (np.issubdtype(a.dtype, np.number) or a.dtype == bool) or np.issubdtype(a.dtype, np.complexfloating):
        raise ValueError(f"{path}: values of type {a.dtype} are no numbers of an image")
    shape = tuple(n for n in a.shape if n != 1)
    if len(shape) > 3:
        raise ValueError(f"{path}: expected three axes, got {len(shape)}")
    return np.squeeze(a).reshape((1,) * (3 - len(shape)) + shape)


@dataclass
class Slab(InputPartition):
    path: str
    t: int
    first: int
    last: int


class NpyReader(DataSourceReader):
    """Slabs of slices, cut to the slices and frames that filters or options ask for."""

    def __init__(self, options: dict[str, str]):
        self.files = [f for p in options["path"].split(",") for f in files_of(p, options.get("recursive", "false") == "true")]
        self.slab = int(options.get("slab", SLAB))
        self.bounds = {c: [int(options.get(f"{c}_from", 0)), int(options.get(f"{c}_to", 1 << 62))] for c in "tz"}

    def partitions(self) -> list[Slab]:
        out = []
        for t, path in enumerate(self.files):
            if self.bounds["t"][0] <= t < self.bounds["t"][1]:
                a = opened(path)
                step = max(1, self.slab // max(1, a[:1].nbytes))
                low, high = max(0, self.bounds["z"][0]), min(len(a), self.bounds["z"][1])
                out += [Slab(path, t, z, min(z + step, high)) for z in range(low, high, step)]
        return out

    def read(self, part: Slab | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there are no slabs
            return
        a = opened(part.path)
        rows = max(1, (1 << 20) // max(1, a.shape[2]))  # rows of a slice in one batch
        for z in range(part.first, part.last):
            for y in range(0, a.shape[1], rows):
                some = np.ascontiguousarray(a[z, y : y + rows]).astype(float)
                n, (at, x) = some.size, np.indices(some.shape).reshape(2, -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.path] * n), pa.array(np.full(n, part.t)), pa.array(np.full(n, z)), pa.array(at + y), pa.array(x), pa.array(some.ravel())], names=["path", "t", "z", "y", "x", "value"]
                )


class PushingReader(NpyReader):
    """The same, for sessions that push filters down to Python sources; others refuse a reader that takes filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = getattr(f, "attribute", (None,))
            if name not in (("t",), ("z",)):
                yield f
                continue
            own = self.bounds[name[0]]
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                own[0] = max(own[0], f.value + isinstance(f, GreaterThan))
            if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                own[1] = min(own[1], f.value + (not isinstance(f, LessThan)))
            if not isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo, LessThan, LessThanOrEqual)):
                yield f


class NpySource(DataSource):
    """Format ``npy_volume``. Options: ``recursive``, ``slab`` (bytes of a partition), ``z_from``, ``z_to``, ``t_from``, ``t_to`` (half open)."""

    @classmethod
    def name(cls) -> str:
        return "npy_volume"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return (PushingReader if self.options.get("push") == "true" else NpyReader)(self.options)


def read_npy(spark: SparkSession, path: str, z: tuple[int, int] | None = None, t: tuple[int, int] | None = None, slab: int = SLAB, recursive: bool = False) -> DataFrame:
    """Voxel rows (path, t, z, y, x, value) of a file, or of a folder's files in the order of their names, which are frames t.

    ``z`` and ``t`` choose slices and frames, and nothing else is read. Where the session pushes filters down to such sources
    (``spark.sql.python.filterPushdown.enabled``), ranges of z and t in ``where`` do the same. A folder without files has no rows.
    """
    spark.dataSource.register(NpySource)
    reader = spark.read.format("npy_volume").option("slab", str(slab)).option("recursive", str(recursive).lower())
    reader = reader.option("push", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for c, ends in (("z", z), ("t", t)):
        if ends is not None:
            reader = reader.option(f"{c}_from", str(ends[0])).option(f"{c}_to", str(ends[1]))
    return reader.load(path)


def write_npy(rows: DataFrame, volumes: DataFrame, folder: str, value: str = "value", slices: int = 16) -> DataFrame:
    """.npy files of so many slices each, voxels without a row 0; (path, vol_id, z), one row per file.

    A task holds ``PIECE`` values at most, whatever the file's size: pieces are written beside the file and then put together. A file is put in
    place when it is whole, so a task that runs again does no harm. The table of volumes gives the extents; a voxel outside is an error.
    """
    own, piece, run = local_path(folder), PIECE, uuid4().hex
    name = lambda vol, chunk: f"{own}/{vol}/z{chunk * slices:06d}.npy"

    def put(path: str, write) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid4().hex}"
        with open(part, "wb") as f:
            write(f)
        os.replace(part, path)

    def save(table: pa.Table) -> pa.Table:
        first = table.select(["vol_id", "nz", "ny", "nx", "chunk", "piece"]).slice(0, 1)
        key, a = first.to_pylist()[0], np.zeros(piece)
        a[table.column("at").to_numpy()] = table.column(value).to_numpy()
        path = f"{name(key['vol_id'], key['chunk'])}.{run}/{key['piece']}"
        put(path, lambda f: f.write(a.tobytes()))
        return first.append_column("part", pa.array([path]))

    def join(table: pa.Table) -> pa.Table:
        key = table.slice(0, 1).to_pylist()[0]
        shape = (min(slices, key["nz"] - key["chunk"] * slices), key["ny"], key["nx"])
        path, total = name(key["vol_id"], key["chunk"]), shape[0] * shape[1] * shape[2]
        parts = dict(zip(table.column("piece").to_pylist(), table.column("part").to_pylist()))

        def write(f) -> None:
            np.lib.format.write_array_header_1_0(f, {"descr": np.lib.format.dtype_to_descr(np.dtype(float)), "fortran_order": False, "shape": shape})
            for i in range(-(-total // piece)):
                n = 8 * min(piece, total - i * piece)
                if i in parts:
                    with open(parts[i], "rb") as part:
                        f.write(part.read(n))
                else:
                    f.write(bytes(n))

        # where an earlier attempt has put the file in place, pieces may be gone
        if all(map(os.path.exists, parts.values())) or not os.path.exists(path):
            put(path, write)
        for part in parts.values():
            if os.path.exists(part):
                os.remove(part)
        if os.path.isdir(f"{path}.{run}") and not os.listdir(f"{path}.{run}"):
            os.rmdir(f"{path}.{run}")
        return pa.table({"path": [path], "vol_id": [key["vol_id"]], "z": [key["chunk"] * slices]})

    at = rows.join(volumes.select("vol_id", "nz", "ny", "nx"), "vol_id").withColumn("chunk", F.expr(f"z div {slices}"))
    inside = F.expr(" AND ".join(f"{a} >= 0 AND {a} < n{a}" for a in "zyx"))
    place = F.expr(f"((z - chunk * {slices}) * ny + y) * nx + x")
    at = at.withColumn("at", F.when(inside, place).otherwise(F.raise_error(F.lit("a voxel lies outside its volume")).cast("long")))
    keys = ["vol_id", *(F.col(f"n{a}").cast("long").alias(f"n{a}") for a in "zyx"), F.col("chunk").cast("long").alias("chunk")]
    at = at.select(*keys, F.expr(f"at div {piece}").alias("piece"), F.expr(f"at % {piece}").alias("at"), F.col(value).cast("double").alias(value))
    parts = at.groupBy("vol_id", "nz", "ny", "nx", "chunk", "piece").applyInArrow(save, "vol_id string, nz long, ny long, nx long, chunk long, piece long, part string")
    return parts.groupBy("vol_id", "chunk").applyInArrow(join, "path string, vol_id string, z long")
