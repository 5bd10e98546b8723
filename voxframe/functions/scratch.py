"""Intermediate tables in the folder that ``spark.checkpoint.dir`` names.

A written table cuts the lineage and survives lost executors. While one is written, Spark is told to let the shuffle
files of that job go when it ends, as nothing reads them again.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a local session gets one of its own; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="voxframe-"))
        base = spark.sparkContext.getCheckpointDir()
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query that runs here go when the query ends."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def write_table(df: DataFrame, path: str) -> DataFrame:
    with shuffles_let_go(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder."""
    return write_table(df, new_path(df.sparkSession, name))


class Tables:
    """Intermediate tables of one piece of work, each of which may be let go before the others."""

    def __init__(self, spark: SparkSession, prefix: str):
        self.spark, self.prefix, self.paths = spark, prefix, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = new_path(self.spark, f"{self.prefix}-{name}")
        return write_table(df, self.paths[name])

    def drop(self, *names: str) -> None:
        """Put an empty table in the place of each; DataFrames that read one must not be used again."""
        for name in names:
            self.spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(self.paths.pop(name))
