"""Volumes in files: slabs of .npy files, chunks with a manifest, extents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.sources import chunks, npy, volumes

RAW = "vol_id string, z long, y long, x long, value double"


def rows_of(a, vol="v"):
    return [(vol, *map(int, at), float(a[at])) for at in np.ndindex(a.shape)]


def test_slabs_of_a_file(spark, tmp_path):
    rng = np.random.default_rng(1)
    arrays = {"b": rng.integers(0, 9, (11, 4, 5)), "a": rng.normal(size=(1, 6, 1, 7)).astype(np.float32), "c": np.asfortranarray(rng.normal(size=(3, 4, 5)))}
    for name, a in arrays.items():
        np.save(tmp_path / f"{name}.npy", a)
    got = npy.read_npy(spark, f"file://{tmp_path}", slab=3 * 4 * 5 * 8)
    assert got.rdd.getNumPartitions() == 1 + 4 + 1
    want = {(t, z, y, x, float(v)) for t, n in enumerate(sorted(arrays)) for a in [np.squeeze(arrays[n])] for a in [a.reshape((1,) * (3 - a.ndim) + a.shape)] for (z, y, x), v in np.ndenumerate(a)}
    assert {(r.t, r.z, r.y, r.x, r.value) for r in got.collect()} == want
    some = npy.read_npy(spark, str(tmp_path / "b.npy"), z=(2, 5), slab=4 * 5 * 8)
    assert some.rdd.getNumPartitions() == 3 and {r.z for r in some.collect()} == {2, 3, 4}
    assert npy.read_npy(spark, str(tmp_path), t=(1, 2)).select("path").distinct().count() == 1
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = npy.read_npy(spark, str(tmp_path / "b.npy"), slab=4 * 5 * 8).where("z >= 3 AND z < 5 AND y > 1")
        assert {(r.z, r.y) for r in pushed.collect()} == {(z, y) for z in (3, 4) for y in (2, 3)} and pushed.rdd.getNumPartitions() == 2
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_files_that_are_no_volumes(spark, tmp_path):
    np.save(tmp_path / "four.npy", np.zeros((2, 2, 2, 2)))
    np.save(tmp_path / "text.npy", np.array(["a"]))
    for name in ("four", "text"):
        with pytest.raises(Exception, match="axes|numbers"):
            npy.read_npy(spark, str(tmp_path / f"{name}.npy")).count()
    with pytest.raises(ValueError, match="mounted"):
        npy.local_path("viewfs://store/in/a.npy")
    (tmp_path / "empty").mkdir()
    assert npy.read_npy(spark, str(tmp_path / "empty")).count() == 0 and volumes.read_time_series(spark, str(tmp_path / "empty")).columns == ["t", "z", "y", "x", "value"]


def test_written_files_come_back(spark, tmp_path):
    a = np.random.default_rng(2).integers(0, 5, (7, 3, 4)).astype(float)
    extents = spark.createDataFrame([("v", 7, 3, 4)], "vol_id string, nz long, ny long, nx long")
    rows = spark.createDataFrame([r for r in rows_of(a) if r[4]], RAW)
    for _ in range(2):  # again, as a task that runs again
        assert npy.write_npy(rows, extents, str(tmp_path), slices=3).count() == 3
    back = npy.read_npy(spark, f"{tmp_path}/v")
    assert {(r.t * 3 + r.z, r.y, r.x): r.value for r in back.collect()} == {tuple(map(int, k)): float(v) for k, v in np.ndenumerate(a)}


def test_morton_numbers(spark):
    rows = [(0, 0, 0), (0, 0, 1), (0, 1, 0), (1, 0, 0), (3, 5, 7), (1000, 2000, 3000)]
    plain = lambda z, y, x: sum(((c >> b) & 1) << (3 * b + k) for b in range(20) for k, c in enumerate((x, y, z)))
    d = spark.createDataFrame(rows, "z long, y long, x long").select("z", "y", "x", chunks.morton(F.col("z"), F.col("y"), F.col("x")).alias("m"))
    assert all(r.m == plain(r.z, r.y, r.x) for r in d.collect())


def test_a_box_opens_few_files(spark, tmp_path):
    a = np.arange(16 * 32 * 32).reshape(16, 32, 32)
    path = str(tmp_path / "store")
    chunks.write_chunks(spark.createDataFrame(rows_of(a), RAW), path, (4, 8, 8), 600)
    files = spark.read.parquet(f"{path}/manifest").select("file").distinct().count()
    got = chunks.read_box(spark, path, "v", (2, 3, 4), (5, 9, 12))
    assert {(r.z, r.y, r.x): r.value for r in got.collect()} == {(z, y, x): float(a[z, y, x]) for z in range(2, 5) for y in range(3, 9) for x in range(4, 12)}
    meet = spark.read.parquet(f"{path}/manifest").where("lo_z < 5 AND hi_z >= 2 AND lo_y < 9 AND hi_y >= 3 AND lo_x < 12 AND hi_x >= 4")
    opened = meet.select("file").distinct().count()
    assert files > 20 and opened < files / 3 and len(got.inputFiles()) == opened + 1  # and the manifest
    assert chunks.read_box(spark, path, "v", (90, 0, 0), (99, 9, 9)).count() == 0 and chunks.read_box(spark, path, "w", (0, 0, 0), (9, 9, 9)).count() == 0
    extents = spark.createDataFrame([("v", 16, 32, 32)], "vol_id string, nz long, ny long, nx long")
    from voxframe.operators import patches

    clicks = spark.createDataFrame([("v", 1, 0, 0, 0), ("v", 2, 15, 31, 30), ("v", 3, 8, 16, 16)], "vol_id string, click_id long, cz long, cy long, cx long")
    whole = patches.crop_centered(spark.createDataFrame(rows_of(a), RAW), extents, clicks, (4, 6, 6))
    assert sorted(map(tuple, chunks.crop_clicks(spark, path, extents, clicks, (4, 6, 6)).collect())) == sorted(map(tuple, whole.collect()))


def test_extents_of_a_volume(spark, tmp_path):
    path = str(tmp_path / "volume")
    volumes.write_volume(spark.createDataFrame([("v", 0, 0, 0, 1.0), ("v", 3, 2, 1, 2.0)], RAW), path)
    good, small = (spark.createDataFrame([("v", n, 3, 2)], "vol_id string, nz long, ny long, nx long") for n in (4, 3))
    assert volumes.read_volume(spark, path, volumes=good).count() == 2
    with pytest.raises(ValueError, match="outside"):
        volumes.read_volume(spark, path, volumes=small)
    np.save(tmp_path / "a.npy", np.ones((2, 2, 2)))
    assert volumes.read_volume(spark, str(tmp_path / "a.npy"), z=(0, 1)).count() == 4


def test_sample_volume(spark):
    got = volumes.sample_volume(spark, (8, 20, 20), 5, 3)
    assert 1 <= got.select("label").distinct().count() <= 5 and got.where("z >= 8 OR y >= 20 OR x >= 20 OR z < 0").count() == 0
    moved = volumes.sample_time_series(got, (8, 20, 20), 3)
    assert moved.count() == 3 * got.count() and moved.where("y >= 20 OR x >= 20").count() == 0


def test_files_are_written_in_pieces(spark, tmp_path, monkeypatch):
    """a file's voxels were all in one task."""
    monkeypatch.setattr(npy, "PIECE", 7)
    a = np.random.default_rng(3).integers(1, 9, (5, 4, 6)).astype(float)
    a[2:4] = 0
    rows = spark.createDataFrame([("v", *map(int, p), float(a[tuple(p)])) for p in np.argwhere(a)], "vol_id string, z long, y long, x long, value double")
    extents = spark.createDataFrame([("v", 5, 4, 6)], "vol_id string, nz long, ny long, nx long")
    found = npy.write_npy(rows, extents, str(tmp_path), slices=1 << 20)
    assert "piece" in found._jdf.queryExecution().executedPlan().toString()
    for _ in range(2):  # also where the files are there already
        assert [(r.path, r.vol_id, r.z) for r in found.collect()] == [(f"{tmp_path}/v/z000000.npy", "v", 0)]
        assert np.array_equal(np.load(f"{tmp_path}/v/z000000.npy"), a) and [p.name for p in (tmp_path / "v").iterdir()] == ["z000000.npy"]
    with pytest.raises(Exception, match="outside its volume"):
        npy.write_npy(rows.withColumn("x", rows.x + 1), extents, str(tmp_path)).collect()
