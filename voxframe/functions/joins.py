"""Joins of tables that follow the voxels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def merge_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join by sorting, which can spill, whatever size Spark expects of the sides.

    It knows nothing of what ``explode`` adds, and takes a Parquet file's packed size for that of its rows, so it would send voxels through the driver to every executor.
    """
    return left.hint("merge").join(right.hint("merge"), list(on), how)
