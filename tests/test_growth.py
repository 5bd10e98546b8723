"""What keeps the queries on voxels within memory as their tables grow."""

import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.llm import quality, suffix_dedup
from voxframe.operators import components, geometry, metric, segment
from voxframe.plans.queries import queries
from voxframe.sources import fixtures as fx
from voxframe.sources import volumes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    """Two thousand cells in one file."""
    folder = str(tmp_path_factory.mktemp("cells"))
    spark.range(2000).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    return folder


@pytest.mark.parametrize("table", ["query_all", "label_vox", "raw_vox"])
def test_voxels_are_made_in_as_many_tasks_as_there_are_cells_for(spark, cells, table):
    plan = getattr(fx, table)(spark, cells)._jdf.queryExecution().executedPlan().toString()
    made = {int(n) for n in re.findall(r"(?:hash|RoundRobin)[pP]artitioning\([^)]*?(\d+)\), REPARTITION_BY_NUM", plan)}
    assert made == {4}
    assert fx.query_all(spark, cells).select(F.spark_partition_id().alias("p")).distinct().count() > 1


# F1 to F24, by the step that they share
@pytest.mark.parametrize("name", [
    "apply_edit_log", "cell_intensity", "contact_continuity", "crop_centered", "dice_matrix", "filter_instances", "mask_costs", "minmax_normalize", "percentile_normalize", "resize_linear",
])
def test_no_table_of_voxels_is_sent_to_every_executor(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"Broadcast\w+Join \[([^\]]*)\]", plan)
    assert not [keys for keys in joins if {"z", "y", "x"} <= set(re.findall(r"\b([zyx])#", keys)) or "label_id" in keys]
    assert "SortMergeJoin" in plan


def test_contacts_of_many_patches_are_not_one_block(spark, monkeypatch):
    """F32: faces of all patches lie at the same place."""
    local = components._local

    def small(keys, steps):
        found = local(keys, steps)

        def run(block):
            assert block.num_rows <= 4 * 16
            return found(block)

        return run

    pixels = spark.range(40 * 16).selectExpr("'v' AS vol_id", "id div 16 AS patch_id", "0L AS z", "(id % 16) div 4 AS y", "id % 4 + (id % 16) div 8 * 2 AS x")
    whole = components.contact_continuity(pixels, ["vol_id", "patch_id"]).collect()
    monkeypatch.setattr(components, "_local", small)
    parted = components.contact_continuity(pixels, ["vol_id", "patch_id"], ["vol_id", F.floor(F.col("patch_id") / 4)]).collect()
    assert len(whole) == 40 and sorted(whole) == sorted(parted)


def test_costs_of_all_pairs_are_made_in_many_tasks(spark):
    """F15"""
    masks = spark.range(60).selectExpr("'v' AS vol_id", "id AS query_id", "id AS z", "0L AS y", "0L AS x", "0.5D AS prob")
    found = segment.mask_cost_matrix(masks, masks.selectExpr("vol_id", "z", "y", "x", "query_id AS label"), 100)
    assert found.count() == 3600 and "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_a_shard_of_bytes_takes_some_forty_times_its_bytes():
    """op5: it took 90 times as much."""
    draw = np.random.default_rng(0)
    sizes = draw.integers(50, 76, 8000)
    units = draw.integers(97, 105, sizes.sum()).astype(np.uint8)
    units[len(units) // 2 : len(units) // 2 * 2] = units[: len(units) // 2]
    tracemalloc.start()
    suffix_dedup.suffix_windows(units, sizes, np.arange(len(sizes)), 50)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50 * len(units)


def test_a_block_meets_all_that_ask_it_at_once(spark, monkeypatch):
    """blocks met in pairs, a group for each, and a block's cells were sent to each block that asked."""
    monkeypatch.setattr(metric, "ASKING", 2)
    points = spark.range(600).selectExpr("'v' AS vol_id", "id AS label", "pmod(xxhash64(id), 97) / 1.0D AS a", "pmod(xxhash64(id, 1), 89) / 1.0D AS b")
    near = metric.nearest_in_matrix(points, ["a", "b"], 4, block=16)
    assert re.search(r"FlatMapCoGroupsInPandas \[vol_id#\d+, other#\d+L?, piece#\d+\]", near._jdf.queryExecution().executedPlan().toString())
    at = {r.label: (r.a, r.b) for r in points.collect()}
    found = {}
    for r in near.collect():
        found.setdefault(r.label, []).append((r.rank, r.distance, r.other))
    for i, (a, b) in at.items():
        brute = sorted((float(np.sqrt((a - c) ** 2 + (b - d) ** 2)), j) for j, (c, d) in at.items() if j != i)[:4]
        assert [x[1:] for x in sorted(found[i])] == brute


def test_scores_of_a_batch_are_made_a_thousand_rows_at_a_time():
    """pipeline: all features of a batch were at hand at once."""
    model = quality.Model(np.zeros(quality.N_STATS), np.ones(quality.N_STATS), 256, 0.03, 11)
    model.weights = np.random.default_rng(1).normal(size=len(model.weights))
    stats = np.random.default_rng(0).normal(size=(10000, quality.N_STATS))
    tracemalloc.start()
    found = model.raw(stats)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2e7
    assert np.allclose(found, model.phi(stats) @ model.weights) and model.raw(stats[:0]).shape == (0,)


def test_all_pairs_are_not_shuffled(spark):
    """pairs were made first and then dealt and sorted by both names, to join what the two have in common."""
    masks = spark.range(60).selectExpr("concat('v', id % 2) AS vol_id", "id AS query_id", "id AS z", "0L AS y", "0L AS x", "0.5D AS prob")
    found = segment.mask_cost_matrix(masks, masks.selectExpr("vol_id", "z", "y", "x", "query_id AS label"), 100)
    steps = re.findall(r"(SortMergeJoin \[\w+|Exchange|Sort |BroadcastNestedLoopJoin|CartesianProduct)", found._jdf.queryExecution().executedPlan().toString())
    assert steps[0] == "SortMergeJoin [_tile"
    rows = found.collect()
    assert len(rows) == 1800 and all((r.query_id - r.label) % 2 == 0 for r in rows)
    assert {r.query_id for r in rows if r.dice_cost == 1 - 2 / 2.5} == set(range(60)) == {r.label for r in rows if r.dice_cost == 1 - 2 / 2.5}


def test_points_are_made_once(spark):
    """the points that neighbours are found among were made again, from all voxels, for each step."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    points = spark.range(600).selectExpr("'v' AS vol_id", "id AS label", "pmod(xxhash64(id), 97) / 1.0D AS a", "pmod(xxhash64(id, 1), 89) / 1.0D AS b").repartition(3)
    near = metric.nearest_in_matrix(points.mapInArrow(count, points.schema), ["a", "b"], 4, block=50)
    assert near.count() == 2400 and made.value == 600


@pytest.mark.parametrize("folders", [False, True])
def test_files_of_patches(spark, tmp_path, folders):
    """each task wrote a file for each of its patches, each in a folder."""
    rows = spark.range(4000).selectExpr("'v' AS vol_id", "concat('p', id % 40) AS patch_name", "id AS z", "id AS label").repartition(4)
    volumes.write_training_patches(rows, rows, str(tmp_path), folders)
    for name in ("images", "labels"):
        found = spark.read.parquet(f"{tmp_path}/{name}").withColumn("file", F.input_file_name())
        assert found.count() == 4000 and found.select("patch_name", "file").distinct().count() == 40
        assert folders or found.select("file").distinct().count() <= 4


def test_a_mesh_needs_few_shuffles(spark, monkeypatch):
    """voxels were dealt for each side of each axis, and triangles joined three times with the vertices, for each table and for the counts."""
    plans, keep = [], geometry.stored
    monkeypatch.setattr(geometry, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    cube = spark.range(8).selectExpr("'v' AS vol_id", "id div 4 AS z", "id div 2 % 2 AS y", "id % 2 AS x", "IF(id = 7, 2L, 1L) AS label")
    vertices, faces = geometry.surface_faces(cube, 4.0)
    assert len(plans) == 1 and len(re.findall(r"Exchange hashpartitioning", plans[0])) == 3 and "Join" not in plans[0]
    place = {(r.label, r.vertex): (r.X, r.Y, r.Z) for r in vertices.collect()}
    for label, voxels in ((1, [(z, y, x) for z in (0, 1) for y in (0, 1) for x in (0, 1)][:7]), (2, [(1, 1, 1)])):
        corners = sorted({(z + c, y + b, x + a) for z, y, x in voxels for a in (0, 1) for b in (0, 1) for c in (0, 1)})
        assert [place[label, i] for i in range(len(corners))] == [(x, y, 4.0 * z) for z, y, x in corners]
    assert faces.where("label = 2").count() == 12 and faces.where("label = 1").count() == 48
    assert all((r.label, i) in place for r in faces.collect() for i in (r.a, r.b, r.c))
