"""Connected components: of graphs, and of voxels in blocks of their volume.

A block's components are found in one task; links over the faces of blocks make a graph, which is contracted in rounds. Rounds
are written to the shared folder, so that lost executors cost one round.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import merge_join
from ..functions.scratch import Tables, stored

#: Slices, rows and columns of the blocks in which components are found at first.
SHAPE = (32, 128, 128)


def graph_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component), the smallest id of each connected part; nodes without an edge are absent.

    Large-star and small-star steps in turn: a node's neighbours are never gathered, only their least is taken.
    """
    work, turn = Tables(edges.sparkSession, "links"), 0
    links = work.keep(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(), "0")
    if not links.limit(1).count():
        return links.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    while True:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = work.keep(merge_join(both.where("v > u"), least, ["u"]).select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct(), "large")
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = merge_join(large, down, ["hi"]).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(down.select("hi", "m")).where("hi <> lo").distinct()
        small = work.keep(small, str(turn + 1))
        work.drop("large", str(turn))
        links, turn = small, turn + 1
        # stars: every node but a centre has one link, and that leads to a centre
        ends = links.select(F.col("hi").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("lo", F.lit(0), F.lit(1)))
        if not ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").limit(1).count():
            break
    nodes = links.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("id"), "component").distinct())


def _local(keys: Sequence[str], steps: Sequence[tuple[int, int, int]]):
    """Components of a block's voxels: each gets the name of its component's first voxel in z, y, x order."""

    def run(block: pa.Table) -> pa.Table:
        z, y, x = (block.column(a).to_numpy().astype(np.int64) for a in "zyx")
        which = np.zeros(len(z), np.int64)
        for k in keys:  # rows with equal keys have equal numbers
            code = block.column(k).combine_chunks().dictionary_encode()
            code = code.combine_chunks().indices if isinstance(code, pa.ChunkedArray) else code.indices
            _, which = np.unique(which * (len(z) + 1) + code.to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
        low = [int(a.min()) - 1 for a in (z, y, x)]
        wide = [int(a.max()) - lo + 2 for a, lo in zip((z, y, x), low)]
        place = lambda dz, dy, dx: ((which * wide[0] + z - low[0] + dz) * wide[1] + y - low[1] + dy) * wide[2] + x - low[2] + dx
        own = place(0, 0, 0)
        order = np.argsort(own, kind="stable")
        own = own[order]
        a, b = [], []
        for step in steps:
            there = place(*step)[order]
            at = np.minimum(np.searchsorted(own, there), len(own) - 1)
            hit = own[at] == there
            a.append(np.flatnonzero(hit)), b.append(at[hit])
        root = joined(len(own), np.concatenate(a), np.concatenate(b))
        name = ((z << 42) + (y << 21) + x)[order]
        out = block.take(pa.array(order)).select([*keys, *[c for c in "zyx" if c not in keys]])
        return out.append_column("_local", pa.array(name[root]))

    return run


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n numbers that are linked by pairs, the least of each number's part: links are pulled to the least ends, and paths halved, until nothing changes."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        a, b = a[apart], b[apart]
    return root


def voxel_components(voxels: DataFrame, keys: Sequence[str], steps: Sequence[tuple[int, int]], reach: int = 0, shape: Sequence[int] = SHAPE, apart: Sequence[Column | str] = ()) -> DataFrame:
    """(keys, z, y, x, component): components of the voxels with equal keys that touch along x, or at the given steps of (z, y) up to ``reach`` columns apart.

    ``component`` is the name of its first voxel in z, y, x order. The first key tells volumes apart, or else ``apart`` does, which must follow from the keys:
    without it, all that lies at one place under different keys is in one block. Components are found inside blocks of ``shape`` first, a block in a task; only
    links over the faces of blocks make a graph for rounds of contraction.
    """
    keys, extra = list(keys), [c for c in "zyx" if c not in keys]
    all_steps = [(0, 0, 1), *((dz, dy, dx) for dz, dy in steps for dx in range(-reach, reach + 1))]
    cut = [F.floor(F.col(a) / n).alias(f"_b{a}") for a, n in zip("zyx", shape)]
    rows = voxels.select(*keys, *extra).distinct()
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", _local long"
    of = [(F.col(c) if isinstance(c, str) else c).alias(f"_of{i}") for i, c in enumerate(apart or keys[:1])]
    found = stored(rows.groupBy(*of, *cut).applyInArrow(_local(keys, all_steps), schema), "block-components")
    # voxels at a face may touch others beyond it
    edge = F.lit(False)
    for a, n, far in zip("zyx", shape, (max((abs(s[0]) for s in all_steps), default=0), max(abs(s[1]) for s in all_steps), max(abs(s[2]) for s in all_steps))):
        if far:
            edge = edge | (F.pmod(F.col(a), F.lit(n)) < far) | (F.pmod(F.col(a), F.lit(n)) >= n - far)
    faces = found.where(edge)
    move = F.explode(F.array(*(F.struct(*(F.lit(d).alias(f"d{a}") for a, d in zip("zyx", s))) for s in all_steps)))
    same = [c for c in keys if c not in "zyx"]
    from_ = faces.select(*keys, *extra, F.col("_local").alias("_a"), move.alias("_s")).withColumns({f"_t{a}": F.col(a) + F.col(f"_s.d{a}") for a in "zyx"})
    # a step that stays in its block is known there
    beyond = F.lit(False)
    for a, n in zip("zyx", shape):
        beyond = beyond | (F.floor(F.col(a) / n) != F.floor(F.col(f"_t{a}") / n))
    from_ = from_.where(beyond).select(*same, *(F.col(f"_t{a}").alias(a) for a in "zyx"), "_a")
    meet = merge_join(from_, faces.select(*same, *"zyx", F.col("_local").alias("_c")), [*same, *"zyx"])
    node = lambda c: F.struct(*same, F.col(c).alias("run"))
    links = meet.select(node("_a").alias("a"), node("_c").alias("b")).distinct()
    names = graph_components(links)
    label = names.select("id.*", F.col("component.run").alias("component")).withColumnRenamed("run", "_local")
    return merge_join(found, label, [*same, "_local"], "left").select(*keys, *extra, F.coalesce("component", "_local").alias("component"))


def slice_components(voxels: DataFrame) -> DataFrame:
    """G1: components of equal label in each slice by four neighbours."""
    rows = voxels.withColumn("slice", F.col("z"))
    return voxel_components(rows, ["vol_id", "label", "slice"], [(0, 1)]).drop("slice")


def drop_small_slices(voxels: DataFrame, min_area: int) -> DataFrame:
    """G1: the voxels whose component in their slice has at least ``min_area`` pixels."""
    found = slice_components(voxels)
    sizes = found.groupBy("vol_id", "label", "z", "component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_area)
    return merge_join(found, sizes, ["vol_id", "label", "z", "component"], "left_semi").select("vol_id", "z", "y", "x", "label")


def solid_components(voxels: DataFrame, keys: Sequence[str] = ("vol_id", "label")) -> DataFrame:
    """Components of equal keys in space by six neighbours."""
    return voxel_components(voxels, list(keys), [(1, 0), (0, 1)])


def split_disconnected(voxels: DataFrame) -> DataFrame:
    """Each separate piece gets a label of its own; a label's first piece keeps it, others follow the largest label, in order of label and place."""
    found = stored(solid_components(voxels), "pieces")
    pieces = found.select("vol_id", "label", "component").distinct()
    first = F.row_number().over(Window.partitionBy("vol_id", "label").orderBy("component"))
    pieces = pieces.withColumn("_n", first)
    more = pieces.where("_n > 1").withColumn("_k", F.row_number().over(Window.partitionBy("vol_id").orderBy("label", "component")))
    top = voxels.groupBy("vol_id").agg(F.max("label").alias("_top"))
    named = more.join(top, "vol_id").select("vol_id", "label", "component", (F.col("_top") + F.col("_k")).alias("_new"))
    out = merge_join(found, named, ["vol_id", "label", "component"], "left")
    return out.select("vol_id", "z", "y", "x", F.coalesce("_new", "label").alias("label"))


def contact_continuity(contacts: DataFrame, keys: Sequence[str], apart: Sequence[Column | str] = ()) -> DataFrame:
    """Contact pixels (keys, z, y, x) in all, in the largest part by eight neighbours of their plane, and the ratio of the two.

    The plane's coordinates are expected in y and x. ``apart``: as of ``voxel_components``.
    """
    found = voxel_components(contacts, list(keys), [(0, 1)], reach=1, apart=apart)
    parts = found.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("_n"))
    out = parts.groupBy(*keys).agg(F.sum("_n").alias("contact_total"), F.max("_n").alias("contact_largest"))
    return out.withColumn("contact_ratio", F.col("contact_largest") / (F.col("contact_total") + 1e-6))


def clicked_component(voxels: DataFrame, clicks: DataFrame, min_voxels: int = 20) -> DataFrame:
    """The voxels of the piece that each click (vol_id, click_id, z, y, x) lies in; clicks outside, or in too small a piece, have none."""
    found = stored(solid_components(voxels), "pieces")
    hit = merge_join(clicks, found, ["vol_id", "z", "y", "x"]).select("vol_id", "click_id", "label", "component")
    out = merge_join(hit, found, ["vol_id", "label", "component"])
    large = out.groupBy("vol_id", "click_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_voxels)
    return out.join(large, ["vol_id", "click_id"], "left_semi").select("vol_id", "click_id", "z", "y", "x", "label")
