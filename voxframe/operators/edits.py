"""Label edits: each takes a label volume and returns the next one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import merge_join
from .voxel import VOXEL


def _within(center: int | None, window: int | None, closed: bool) -> str:
    if window is None or center is None:
        return "true"
    return f"z >= {center - window} AND z {'<=' if closed else '<'} {center + window}"


def add_roi(voxels: DataFrame, pixels: DataFrame, label: int) -> DataFrame:
    """The label on all pixels (vol_id, z, y, x) of the region, over others."""
    new = pixels.select(*VOXEL).distinct().withColumn("label", F.lit(label).cast("long"))
    return voxels.select(*VOXEL, "label").join(new.select(*VOXEL), VOXEL, "left_anti").unionByName(new)


def subtract_roi(voxels: DataFrame, pixels: DataFrame, label: int) -> DataFrame:
    """The region's pixels of this label cleared."""
    gone = pixels.select(*VOXEL).distinct().withColumn("label", F.lit(label).cast("long"))
    return voxels.join(gone, [*VOXEL, "label"], "left_anti")


def new_label(voxels: DataFrame, pixels: DataFrame) -> DataFrame:
    """The region's pixels, on any slices, as a label of their own after each volume's largest."""
    top = voxels.groupBy("vol_id").agg((F.max("label") + 1).alias("label"))
    new = pixels.select(*VOXEL).distinct().join(top, "vol_id", "left").select(*VOXEL, F.coalesce("label", F.lit(1)).cast("long").alias("label"))
    return voxels.select(*VOXEL, "label").join(new.select(*VOXEL), VOXEL, "left_anti").unionByName(new)


def change_label(voxels: DataFrame, old: int, new: int, z: int) -> DataFrame:
    """Another label on one slice, 1 to 65535."""
    if not 1 <= new <= 65535:
        raise ValueError("the new label must lie in 1..65535")
    return voxels.withColumn("label", F.when((F.col("z") == z) & (F.col("label") == old), F.lit(new).cast("long")).otherwise(F.col("label")))


def delete_on_slice(voxels: DataFrame, label: int, z: int) -> DataFrame:
    """E5: one label cleared on one slice."""
    return voxels.where(~((F.col("label") == label) & (F.col("z") == z)))


def delete_near(voxels: DataFrame, label: int, z: int, z_window: int | None = 25) -> DataFrame:
    """One label cleared on the slices from z - window to before z + window; on all without a window."""
    return voxels.where(~((F.col("label") == label) & F.expr(_within(z, z_window, False))))


def delete_inside_roi(voxels: DataFrame, pixels: DataFrame, z_window: int | None = 25) -> DataFrame:
    """All labels under the region cleared, up to the window's slices from it, its ends included."""
    hit = voxels.join(pixels.select(*VOXEL).distinct(), VOXEL, "left_semi").select("vol_id", "label", F.col("z").alias("_z")).distinct()
    cond = ["vol_id", "label"]
    if z_window is None:
        return voxels.join(hit.select(*cond).distinct(), cond, "left_anti")
    spans = hit.withColumn("z", F.explode(F.sequence(F.col("_z") - z_window, F.col("_z") + z_window))).select(*cond, "z").distinct()
    return voxels.join(spans, [*cond, "z"], "left_anti")


def protect_others(mask: DataFrame, voxels: DataFrame, label: int) -> DataFrame:
    """The mask's pixels that are background or of this label."""
    taken = voxels.where(F.col("label") != label).select(*VOXEL)
    return mask.join(taken, VOXEL, "left_anti")


def replace_cell(voxels: DataFrame, mask: DataFrame, label: int, box: tuple[Sequence[int], Sequence[int]]) -> DataFrame:
    """The cell inside a half-open box replaced by a new mask, other cells kept."""
    inside = F.expr(" AND ".join(f"{a} >= {lo} AND {a} < {hi}" for a, lo, hi in zip("zyx", *box)))
    rest = voxels.select(*VOXEL, "label").where(~((F.col("label") == label) & inside))
    new = protect_others(mask.select(*VOXEL).distinct().where(inside), voxels, label).withColumn("label", F.lit(label).cast("long"))
    return rest.join(new.select(*VOXEL), VOXEL, "left_anti").unionByName(new)


def edit_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each label's voxels before and after."""
    count = lambda v, name: v.groupBy("vol_id", "label").agg(F.count(F.lit(1)).alias(name))
    both = count(before, "old_voxels").join(count(after, "new_voxels"), ["vol_id", "label"], "full")
    return both.select("vol_id", "label", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("old_voxels", "new_voxels")))


def apply_edit_log(voxels: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (vol_id, seq, z, y, x, label) replayed: the last one of a voxel counts, label 0 clears it."""
    last = edits.groupBy(*VOXEL).agg(F.max_by("label", "seq").alias("label"))
    return merge_join(voxels.select(*VOXEL, "label"), last.select(*VOXEL), VOXEL, "left_anti").unionByName(last.where("label > 0"))


#: Edits that undo can take back.
UNDO_DEPTH = 20


def active_edits(log: DataFrame, undo: str = "undo", keys: Sequence[str] = ("layer_name",), depth: int = UNDO_DEPTH) -> DataFrame:
    """The log without undone edits: an entry ``undo`` takes back the newest edit of its layer that can still be taken back, if any.

    A layer remembers its last ``depth`` edits; one that as many later ones stand upon is forgotten and stays. The number of edits in force rises with each edit and falls with
    each undo, not below 0. Of the entries that reach an edit's level, the undo that leaves it and the edit that comes ``depth`` above it, the first decides.
    """
    line = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("operation") == undo, -1).otherwise(1)
    out = log.withColumn("_sum", F.sum(step).over(line))
    out = out.withColumn("_level", F.col("_sum") - F.least(F.min("_sum").over(line), F.lit(0)))
    # an undo belongs to the level that it leaves, an edit to its own and, as a mark, to the one that it pushes out
    marks = F.when(F.col("operation") == undo, F.array(F.struct((F.col("_level") + 1).alias("at"), F.lit(0).alias("kind")))).otherwise(
        F.array(F.struct(F.col("_level").alias("at"), F.lit(1).alias("kind")), F.struct((F.col("_level") - depth).alias("at"), F.lit(2).alias("kind")))
    )
    out = out.withColumn("_m", F.explode(marks)).select(*log.columns, "_m.*").where("at > 0")
    then = F.lead("kind").over(Window.partitionBy(*keys, "at").orderBy("seq", "kind"))
    return out.withColumn("_then", then).where("kind = 1 AND (_then IS NULL OR _then <> 0)").select(*log.columns)


def latest_edits(log: DataFrame, keys: Sequence[str] = ("layer_name",), depth: int = UNDO_DEPTH) -> DataFrame:
    """The newest edits that undo can take back, the newest with place 1."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq")))
    return log.withColumn("place", place).where(F.col("place") <= depth)


def edit_audit(log: DataFrame) -> DataFrame:
    """Edits of each operation, and the labels and slices they concern."""
    return log.groupBy("operation").agg(F.count(F.lit(1)).alias("edits"), F.countDistinct("label_id").alias("labels"), F.countDistinct("z_index").alias("slices"), F.max("ts").alias("last_ts"))


def z_run_bbox(voxels: DataFrame, starts: DataFrame, max_empty_gap: int = 1, reach: int | None = None) -> DataFrame:
    """The box of each label (vol_id, label, start_z) over the slices around its start, up to a gap of more than ``max_empty_gap`` empty slices.

    With ``reach``, slices farther from the start than that are not looked at, as for a click.
    """
    near = voxels.join(starts, ["vol_id", "label"])
    per = (near if reach is None else near.where(F.abs(F.col("z") - F.col("start_z")) <= reach)).groupBy("vol_id", "label", "start_z", "z").agg(*(g(a).alias(f"{m}_{a}") for a in "yx" for m, g in (("lo", F.min), ("hi", F.max))))
    line = Window.partitionBy("vol_id", "label", "start_z").orderBy("z")
    gap = (F.col("z") - F.lag("z").over(line) - 1 > max_empty_gap).cast("int")
    per = per.withColumn("_g", F.coalesce(gap, F.lit(0))).withColumn("_i", F.sum("_g").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    own = per.where("z = start_z").select("vol_id", "label", "start_z", "_i")
    out = per.join(own, ["vol_id", "label", "start_z", "_i"]).groupBy("vol_id", "label", "start_z")
    return out.agg(F.min("z").alias("lo_z"), F.max("z").alias("hi_z"), F.min("lo_y").alias("lo_y"), F.max("hi_y").alias("hi_y"), F.min("lo_x").alias("lo_x"), F.max("hi_x").alias("hi_x"))
