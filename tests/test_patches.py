"""Percentiles by refined ranges."""

import numpy as np
from pyspark.sql import functions as F

from voxframe.operators import patches


def test_percentiles_with_values_far_out(spark):
    rng = np.random.default_rng(1)
    rows = {
        "far": np.concatenate([rng.normal(size=3000), [1e9, -1e300]]), "steps": np.concatenate([10.0 ** -np.arange(300), np.zeros(50)]), "equal": np.full(40, 3.5), "few": np.array([1.0, 2.0]),
        "one": np.array([7.0]), "repeated": np.repeat(rng.normal(size=500), 7), "nearly": 1 + np.arange(400) * 2.0**-52,
    }
    d = spark.createDataFrame([(v, float(x)) for v, xs in rows.items() for x in xs] + [("far", None)], "vol_id string, value double").repartition(3)
    points = {"a": 0.01, "b": 0.5, "c": 0.999}
    for most in (20, 200_000):
        got = {r.vol_id: r for r in patches.exact_percentiles(d, points, "value", most).collect()}
        for v, xs in rows.items():
            assert [got[v][p] for p in points] == np.quantile(xs, list(points.values())).tolist() or np.allclose([got[v][p] for p in points], np.quantile(xs, list(points.values())), rtol=1e-15, atol=0), v
            assert (got[v].lowest, got[v].highest) == (xs.min(), xs.max())


def test_ranges_are_bounded(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=20_000), [1e9, 1e12, -1e15]])
    counts = spark.createDataFrame([("v", float(x), 1) for x in values], "vol_id string, _v double, _n long")
    ends = counts.groupBy("vol_id").agg(F.min("_v").alias("lowest"), F.max("_v").alias("highest"), F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("kinds"))
    asked = spark.createDataFrame([("v", 200), ("v", 10_000), ("v", 19_990)], "vol_id string, place long")
    found = patches.percentile_ranges(counts, asked, ends, 100).collect()
    assert max(r.kinds for r in found) <= 100 and len(found) <= 3
    ordered = np.sort(values)
    assert all(ordered[r.base] == r.lo for r in found)


def test_empty(spark):
    assert patches.exact_percentiles(spark.createDataFrame([], "vol_id string, value double"), {"a": 0.5}, "value").count() == 0
