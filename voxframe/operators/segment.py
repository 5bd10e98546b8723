"""From query masks to instances: scores, overlaps, conflicts, the winner of each voxel, matching, cleaning, stitching.

A model's output is the table query_vox: (patch_id, query_id, score, z, y, x, prob), with overlapping queries.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import merge_join
from ..functions.scratch import stored
from .components import contact_continuity, drop_small_slices, graph_components, split_disconnected, voxel_components
from .patches import voxels_in_patches
from .voxel import CELL, VOXEL, relabel_sequential

QUERY = ["patch_id", "query_id"]
PIXEL = ["patch_id", "z", "y", "x"]
GROUP = ["patch_id", "z", "component", "group"]


def logits_to_prob(queries: DataFrame, column: str = "logit") -> DataFrame:
    """P20: a patch's values through the logistic function if any lies outside 0..1."""
    ends = queries.groupBy("patch_id").agg(((F.min(column) < 0) | (F.max(column) > 1)).alias("_raw"))
    v = F.col(column)
    return queries.join(ends, "patch_id").withColumn("prob", F.when(F.col("_raw"), 1 / (1 + F.exp(-v))).otherwise(v)).drop("_raw")


def mask_quality(queries: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Area and mean probability of each query's mask above the threshold."""
    inside = F.col("prob") > threshold
    return queries.groupBy(*QUERY).agg(
        F.max("score").alias("score"), F.sum(inside.cast("long")).alias("area"),
        (F.sum(F.when(inside, F.col("prob")).otherwise(0.0)) / (F.sum(inside.cast("long")) + 1e-6)).alias("quality"),
    )


def topk_queries(queries: DataFrame, k: int = 300, min_score: float = 0.5, threshold: float = 0.5) -> DataFrame:
    """Score times quality, above the least score, the k best of each patch."""
    q = mask_quality(queries, threshold).withColumn("final_score", F.col("score") * F.col("quality")).where(F.col("final_score") > min_score)
    place = F.row_number().over(Window.partitionBy("patch_id").orderBy(F.desc("final_score"), "query_id"))
    return q.withColumn("rank", place).where(F.col("rank") <= k)


def class_topk(logits: DataFrame, k: int = 100) -> DataFrame:
    """(patch_id, query_id, class, score): softmax over each query's classes, of which the last means no object, and the k best pairs of each patch."""
    peak = Window.partitionBy(*QUERY)
    e = logits.withColumns({"_e": F.exp(F.col("logit") - F.max("logit").over(peak)), "_last": F.max("class").over(peak)})
    e = e.withColumn("score", F.col("_e") / F.sum("_e").over(peak)).where(F.col("class") < F.col("_last"))
    place = F.row_number().over(Window.partitionBy("patch_id").orderBy(F.desc("score"), "query_id", "class"))
    return e.withColumn("rank", place).where(F.col("rank") <= k).select(*QUERY, "class", "score", "rank")


def masks(queries: DataFrame, threshold: float = 0.5) -> DataFrame:
    return queries.where(F.col("prob") > threshold)


#: Patches whose contacts on a face are looked at together.
FACES = 64
#: Columns of a row of pixels that one bucket of runs spans.
SPAN = 64


def row_runs(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, y, lo, hi): pixels of equal keys that follow each other in a row, each pixel once."""
    line = Window.partitionBy(*keys, "y").orderBy("x")
    island = pixels.select(*keys, "y", "x").distinct().withColumn("_i", F.col("x") - F.row_number().over(line))
    return island.groupBy(*keys, "y", "_i").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).drop("_i")


def run_overlap(left: DataFrame, right: DataFrame, on: Sequence[str], keys: Sequence[str], only: str = "true") -> DataFrame:
    """(keys, overlap): pixels that runs of both sides have in common in rows with equal ``on``; runs meet in buckets of columns, and an overlap counts where it begins."""
    cut = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / SPAN), F.floor(F.col(hi) / SPAN)))
    mine = left.withColumn("_b", cut("lo", "hi"))
    theirs = right.withColumnsRenamed({"lo": "_lo", "hi": "_hi"}).withColumn("_b", cut("_lo", "_hi"))
    begin, end = F.greatest("lo", "_lo"), F.least("hi", "_hi")
    met = merge_join(mine, theirs, [*on, "y", "_b"]).where((begin <= end) & (F.floor(begin / SPAN) == F.col("_b")) & F.expr(only))
    return met.groupBy(*keys).agg(F.sum(end - begin + 1).alias("overlap"))


def mask_pair_overlap(queries: DataFrame, threshold: float = 0.5, min_overlap: int = 20) -> DataFrame:
    """Pixels, share of the smaller mask (iom) and of the union (iou) that two queries' masks have in common in a slice. Runs of pixels meet, not pixels."""
    runs = stored(row_runs(masks(queries, threshold), ["patch_id", "z", "query_id"]), "mask-runs")
    areas = runs.groupBy("patch_id", "z", "query_id").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("_area"))
    side = lambda s: runs.withColumnRenamed("query_id", f"query_{s}")
    both = run_overlap(side("a"), side("b"), ["patch_id", "z"], ["patch_id", "z", "query_a", "query_b"], "query_a < query_b").where(F.col("overlap") >= min_overlap)
    for s in "ab":
        both = both.join(areas.select("patch_id", "z", F.col("query_id").alias(f"query_{s}"), F.col("_area").alias(f"area_{s}")), ["patch_id", "z", f"query_{s}"])
    i, a, b = F.col("overlap"), F.col("area_a"), F.col("area_b")
    return both.select("patch_id", "z", "query_a", "query_b", "overlap", (i / (F.least(a, b) + 1e-6)).alias("iom"), (i / (a + b - i + 1e-6)).alias("iou"))


def merge_groups(overlaps: DataFrame, iom: float = 0.8, iou: float = 0.5, keys: Sequence[str] = ("patch_id", "z")) -> DataFrame:
    """(keys, query_id, group): queries that overlap enough, directly or by way of others, in a slice or what else the keys tell apart."""
    e = overlaps.where((F.col("iom") > iom) | (F.col("iou") > iou))
    node = lambda q: F.struct(*keys, F.col(q).alias("query_id"))
    found = graph_components(e.select(node("query_a").alias("a"), node("query_b").alias("b")))
    return found.select(*(f"id.{k}" for k in keys), "id.query_id", F.col("component.query_id").alias("group"))


def conflict_components(queries: DataFrame, threshold: float = 0.5, min_pixels: int = 20) -> DataFrame:
    """Parts of each slice that several masks claim, by four neighbours, of at least ``min_pixels``."""
    claimed = masks(queries, threshold).groupBy(*PIXEL).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn("slice", F.col("z"))
    found = voxel_components(claimed, ["patch_id", "slice"], [(0, 1)]).drop("slice")
    large = found.groupBy("patch_id", "z", "component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_pixels)
    return merge_join(found, large, ["patch_id", "z", "component"], "left_semi")


def adjacent_slice_iou(merged: DataFrame, queries: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(patch_id, z, component, group, query_id, iou): a merged slice against each of its queries' masks one slice above and below, the better of the two."""
    m = stored(row_runs(masks(queries, threshold), ["patch_id", "z", "query_id"]), "mask-runs")
    own = stored(row_runs(merged, GROUP), "merged-runs")
    area = own.groupBy(*GROUP).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("_a"))
    members = merged.select(*GROUP, "query_id").distinct()
    out = None
    for d in (-1, 1):
        there = m.withColumn("z", F.col("z") - d)
        size = there.groupBy("patch_id", "z", "query_id").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("_b"))
        hit = run_overlap(own, there, ["patch_id", "z"], [*GROUP, "query_id"]).withColumnRenamed("overlap", "_i")
        one = members.join(size, ["patch_id", "z", "query_id"], "left").join(hit, [*GROUP, "query_id"], "left").join(area, GROUP)
        i = F.coalesce("_i", F.lit(0))
        one = one.select(*GROUP, "query_id", (i / (F.col("_a") + F.coalesce("_b", F.lit(0)) - i + 1e-6)).alias("iou"))
        out = one if out is None else out.union(one)
    return out.groupBy(*GROUP, "query_id").agg(F.max("iou").alias("iou"))


def resolve_conflicts(queries: DataFrame, threshold: float = 0.5, min_pixels: int = 20, min_voxels: int = 20, scores: DataFrame | None = None, iom: float = 0.8, iou: float = 0.5) -> DataFrame:
    """Of the masks that meet in one conflict (G4) and belong together (G5), the one most like its neighbouring slices gets their union
    at the greatest probability; the others lose it there. Ties go to the better ``final_score`` of ``scores`` (patch_id, query_id, final_score), or else the query's score.

    Unions of under ``min_voxels`` pixels are left as they are. All conflicts are judged on the state before.
    """
    m = masks(queries, threshold)
    conflicts = conflict_components(queries, threshold, min_pixels)
    part = merge_join(m, conflicts, PIXEL).select("patch_id", "z", "component", "query_id").distinct()
    pairs = mask_pair_overlap(queries, threshold, min_pixels)
    for side in ("query_a", "query_b"):
        pairs = pairs.join(part.withColumnRenamed("query_id", side), ["patch_id", "z", *(["component"] if "component" in pairs.columns else []), side])
    groups = merge_groups(pairs, iom, iou, ("patch_id", "z", "component"))
    merged = merge_join(m, groups, ["patch_id", "z", "query_id"]).select(*PIXEL, "component", "group", "query_id", "score", "prob")
    merged = stored(merged, "merged")
    large = merged.groupBy(*GROUP).agg(F.countDistinct("y", "x").alias("_n")).where(F.col("_n") >= min_voxels)
    merged = merge_join(merged, large, GROUP, "left_semi")
    like = adjacent_slice_iou(merged, queries, threshold)
    score = merged.select("patch_id", "query_id", "score").distinct()
    score = score.withColumn("final_score", F.col("score")) if scores is None else score.join(scores.select(*QUERY, "final_score"), QUERY)
    rank = F.struct(F.round("iou", 6), "final_score", (-F.col("query_id")).alias("q"))
    owner = like.join(score, QUERY).groupBy(*GROUP).agg(F.max_by(F.struct("query_id", "score"), rank).alias("o"))
    members = merged.select(*GROUP, "query_id").distinct()
    # a query's own probability counts wherever it has one, also below the threshold
    union = merge_join(merge_join(merged.select(*PIXEL, "component", "group").distinct(), members, GROUP), queries.select(*PIXEL, "query_id", "prob"), [*PIXEL, "query_id"])
    union = stored(union.select(*PIXEL, "component", "group", "query_id", "prob"), "unions")
    won = merge_join(union.groupBy(*PIXEL, "component", "group").agg(F.max("prob").alias("prob")), owner, GROUP)
    won = won.groupBy("patch_id", F.col("o.query_id").alias("query_id"), F.col("o.score").alias("score"), "z", "y", "x").agg(F.max("prob").alias("prob"))
    rest = merge_join(queries, union.select(*PIXEL, "query_id").distinct(), [*PIXEL, "query_id"], "left_anti")
    rest = merge_join(rest, won.select(*PIXEL, "query_id"), [*PIXEL, "query_id"], "left_anti")
    return rest.select("patch_id", "query_id", "score", "z", "y", "x", "prob").unionByName(won)


def voxel_argmax(queries: DataFrame, threshold: float = 0.5, min_voxels: int = 20, min_score: float = 0.5, k: int = 300, scores: DataFrame | None = None) -> DataFrame:
    """The query with the greatest probability times score owns a voxel, if its probability there is above the threshold;
    instances of too few voxels go, the others are numbered from the best score down. ``scores`` are those of W6, if they are known."""
    best = topk_queries(queries, k, min_score, threshold) if scores is None else scores
    best = best.select(*QUERY, "final_score", F.col("rank").cast("long").alias("rank"))
    q = merge_join(queries, best, QUERY)
    won = q.groupBy(*PIXEL).agg(F.max_by(F.struct("query_id", "prob", "final_score", "rank"), F.struct((F.col("prob") * F.col("final_score")).alias("w"), (-F.col("rank")).alias("r"))).alias("w"))
    own = won.select(*PIXEL, "w.*").where(F.col("prob") > threshold)
    kept = own.groupBy("patch_id", "query_id", "rank").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_voxels)
    numbered = kept.select(*QUERY, F.row_number().over(Window.partitionBy("patch_id").orderBy("rank")).cast("long").alias("label"))
    return merge_join(own, numbered, QUERY).select(*PIXEL, "label", "query_id", F.col("final_score").alias("confidence"))


def drop_full_foreground(instances: DataFrame, patch_voxels: int, share: float = 0.98) -> DataFrame:
    """Patches that one single instance covers almost whole are cleared."""
    full = instances.groupBy("patch_id").agg(F.countDistinct("label").alias("_l"), F.count(F.lit(1)).alias("_n")).where((F.col("_l") == 1) & (F.col("_n") > share * patch_voxels))
    return instances.join(full, "patch_id", "left_anti")


def postprocess_patch(queries: DataFrame, patch_voxels: int, threshold: float = 0.5, min_score: float = 0.5, k: int = 300, min_voxels: int = 20) -> DataFrame:
    """Best queries, conflicts resolved, one owner per voxel, full patches cleared."""
    best = stored(topk_queries(queries, k, min_score, threshold).select(*QUERY, "final_score", "rank"), "best")
    chosen = stored(merge_join(queries, best, QUERY, "left_semi"), "queries")
    return drop_full_foreground(voxel_argmax(resolve_conflicts(chosen, threshold, min_voxels=min_voxels, scores=best), threshold, min_voxels, min_score, k, best), patch_voxels)


#: Tiles of all pairs for each partition of a shuffle.
TILES = 16


def every_pair(left: DataFrame, right: DataFrame, common: DataFrame, one: str, other: str, sums: Sequence[str]) -> DataFrame:
    """All pairs of ``left`` (vol_id, ``one``, ...) and ``right`` (vol_id, ``other``, ...) of a volume, with the ``sums`` of ``common`` (vol_id, ``one``, ``other``, sums), 0 where it has no row.

    Pairs are made tile by tile, of a share of either side, and are never shuffled or sorted: what two names have in common travels with the first, as a map of the tile's other names.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = int(np.ceil(np.sqrt(TILES * parts)))
    share = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    met = common.where(F.col(other).isNotNull()).groupBy("vol_id", one, share(other).alias("_b")).agg(F.map_from_entries(F.collect_list(F.struct(F.col(other), F.struct(*sums)))).alias("_common"))
    # one key, so that it stays whole where all rows are known to be of one volume, and no other exchange follows
    tile = lambda a, b: F.concat(F.col("vol_id").cast("string"), F.lit("/"), a, F.lit("/"), b)
    mine = merge_join(left.withColumn("_b", every), met, ["vol_id", one, "_b"], "left").withColumn("_tile", tile(share(one), F.col("_b")))
    theirs = right.withColumn("_a", every).withColumn("_tile", tile(F.col("_a"), share(other))).drop("vol_id")
    # sides are few rows and would be dealt over few tasks, but their pairs are many
    pairs = merge_join(mine.repartition(parts, "_tile"), theirs.repartition(parts, "_tile"), ["_tile"])
    pairs = pairs.withColumn("_common", F.col("_common")[F.col(other)])
    return pairs.select(*left.columns, *(c for c in right.columns if c != "vol_id"), *(F.coalesce(F.col(f"_common.{c}"), F.lit(0)).alias(c) for c in sums))


def _sizes(voxels: DataFrame, name: str) -> DataFrame:
    return voxels.groupBy(*CELL).agg(F.count(F.lit(1)).alias(f"{name}_size")).withColumnRenamed("label", name)


def touching_labels(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(vol_id, pred, truth, overlap): common voxels of each predicted and true label that have any."""
    both = merge_join(pred.select(*VOXEL, F.col("label").alias("pred")), truth.select(*VOXEL, F.col("label").alias("truth")), VOXEL)
    return both.groupBy("vol_id", "pred", "truth").agg(F.count(F.lit(1)).alias("overlap"))


def overlap_matrix(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Common voxels of every predicted with every true label of its volume, 0 included, with both sizes."""
    return every_pair(_sizes(pred, "pred"), _sizes(truth, "truth"), touching_labels(pred, truth), "pred", "truth", ["overlap"])


def _with_dice(pairs: DataFrame) -> DataFrame:
    i, p, g = F.col("overlap"), F.col("pred_size"), F.col("truth_size")
    return pairs.select("vol_id", "pred", "truth", "overlap", (1 - (2 * i + 1) / (p + g + 1)).alias("dice_cost"), (i / (p + g - i)).alias("iou"))


def dice_matrix(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """1 - (2 I + 1) / (P + G + 1) for every pair of a predicted and a true label of a volume, also of labels without a common voxel."""
    return _with_dice(overlap_matrix(pred, truth))


def mask_cost_matrix(queries: DataFrame, truth: DataFrame, voxels: int, eps: float = 1e-7) -> DataFrame:
    """Soft Dice and binary cross-entropy cost of every query against every true label of its volume, pairs without a common voxel included.

    ``queries``: (vol_id, query_id, z, y, x, prob); a voxel without a row has probability 0. ``voxels``: how many the cost is averaged over.
    One join on the voxel gives the sums over common voxels; all else follows from sums per query and per label, so the pairs are of names only.
    """
    p = F.least(F.greatest(F.col("prob"), F.lit(eps)), F.lit(1 - eps))
    q = queries.withColumns({"_pos": -F.log(p), "_neg": -F.log(1 - p)})
    mine = q.groupBy("vol_id", "query_id").agg(F.sum("prob").alias("_p"), F.sum("_neg").alias("_neg"), F.count(F.lit(1)).alias("_rows"))
    theirs = truth.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_t"))
    common = merge_join(q, truth.select(*VOXEL, "label"), VOXEL).groupBy("vol_id", "query_id", "label").agg(F.sum("prob").alias("_i"), F.sum(F.col("_pos") - F.col("_neg")).alias("_gain"), F.count(F.lit(1)).alias("_n"))
    out = every_pair(mine, theirs, common, "query_id", "label", ["_i", "_gain", "_n"])
    i, gain, n = F.col("_i"), F.col("_gain"), F.col("_n")
    off_pos, off_neg = -float(np.log(eps)), -float(np.log(1 - eps))
    bce = (F.col("_neg") + (voxels - F.col("_rows")) * off_neg + gain + (F.col("_t") - n) * (off_pos - off_neg)) / voxels
    return out.select("vol_id", "query_id", "label", (1 - (2 * i + 1) / (F.col("_p") + F.col("_t") + 1)).alias("dice_cost"), bce.alias("bce_cost"))


def match_instances(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs with a common voxel that are each other's cheapest, one to one."""
    m = touching_labels(pred, truth).join(_sizes(pred, "pred"), ["vol_id", "pred"]).join(_sizes(truth, "truth"), ["vol_id", "truth"])
    m = _with_dice(m)
    for mine, other in (("pred", "truth"), ("truth", "pred")):
        m = m.withColumn(f"_{mine}", F.row_number().over(Window.partitionBy("vol_id", mine).orderBy("dice_cost", other)))
    return m.where("_pred = 1 AND _truth = 1").drop("_pred", "_truth")


def confidence_mean(instances: DataFrame, keys: Sequence[str] = ("z", "y", "x")) -> DataFrame:
    """Mean confidence over the patches that wrote a voxel."""
    return instances.groupBy(*keys).agg(F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("written"))


def filter_instances(voxels: DataFrame, raw: DataFrame | None = None, min_size: int = 0, max_size: int | None = None, min_intensity: float | None = None) -> DataFrame:
    """The labels with a size between the bounds and at least the mean intensity, numbered anew."""
    kept = filtered_labels(voxels, raw, min_size, max_size, min_intensity).where("kept")
    return relabel_sequential(merge_join(voxels, kept, CELL, "left_semi"))


def filtered_labels(voxels: DataFrame, raw: DataFrame | None = None, min_size: int = 0, max_size: int | None = None, min_intensity: float | None = None) -> DataFrame:
    """Each label's size and mean intensity, and whether the filter keeps it."""
    rows = voxels if raw is None else merge_join(voxels, raw, VOXEL, "left")
    out = rows.groupBy(*CELL).agg(F.count(F.lit(1)).alias("voxel_count"), *([F.avg("value").alias("mean_intensity")] if raw is not None else []))
    keep = F.col("voxel_count") >= min_size
    if max_size is not None:
        keep &= F.col("voxel_count") <= max_size
    if min_intensity is not None and raw is not None:
        keep &= F.coalesce(F.col("mean_intensity") >= min_intensity, F.lit(False))
    return out.withColumn("kept", keep)


def clean_instances(voxels: DataFrame, raw: DataFrame | None = None, min_area: int = 20, min_size: int = 0, max_size: int | None = None, min_intensity: float | None = None) -> DataFrame:
    """Small pieces of slices go, then small, large or dark labels; the rest are numbered 1..N."""
    return filter_instances(drop_small_slices(voxels, min_area), raw, min_size, max_size, min_intensity)


def click_scores(queries: DataFrame, clicks: DataFrame, radius: tuple[int, int, int] = (1, 3, 3), threshold: float = 0.5) -> DataFrame:
    """For each click and each query near it: the greatest probability around the click, area, score and quality."""
    near = clicks
    for a, r in zip("zyx", radius):
        near = near.withColumn(a, F.explode(F.sequence(F.col(f"c{a}") - r, F.col(f"c{a}") + r)))
    hit = near.select("click_id", "z", "y", "x").join(queries, ["z", "y", "x"]).groupBy("click_id", *QUERY).agg(F.max("prob").alias("click_prob"))
    return hit.join(mask_quality(queries, threshold), QUERY)


def select_clicked_query(queries: DataFrame, clicks: DataFrame, min_score: float = 0.05, min_prob: float = 0.10, min_area: int = 20, threshold: float = 0.5, floor: float = 0.05) -> DataFrame:
    """The query of each click with the greatest product of click probability, score and quality among valid ones, else the
    greatest click probability; with the mask threshold, lowered where the click's probability does not reach it."""
    s = click_scores(queries, clicks, threshold=threshold)
    s = s.withColumn("valid", (F.col("score") >= min_score) & (F.col("click_prob") >= min_prob) & (F.col("area") >= min_area))
    s = s.withColumn("rank_score", F.when(F.col("valid"), F.col("click_prob") * F.col("score") * F.col("quality")).otherwise(F.col("click_prob")))
    place = F.row_number().over(Window.partitionBy("click_id").orderBy(F.desc("valid"), F.desc("rank_score"), "patch_id", "query_id"))
    low = F.greatest(F.lit(floor), 0.85 * F.col("click_prob"))
    out = s.withColumn("_n", place).where("_n = 1").drop("_n")
    return out.withColumn("mask_threshold", F.when(F.col("click_prob") <= threshold, low).otherwise(F.lit(threshold)))


def core_bounds(patches: DataFrame, volumes: DataFrame, stride: Sequence[int]) -> DataFrame:
    """The half-open core of each patch: a stride's length behind its margin, but to the end where it touches the volume's."""
    out = patches.join(volumes.select("vol_id", "nz", "ny", "nx"), "vol_id")
    for a, s in zip("zyx", stride):
        margin = F.expr(f"(p{a} - {s}) div 2")
        out = out.withColumn(f"lo_{a}", F.when(F.col(f"{a}0") == 0, F.lit(0)).otherwise(F.col(f"{a}0") + margin))
        out = out.withColumn(f"hi_{a}", F.when(F.col(f"{a}0") + F.col(f"p{a}") >= F.col(f"n{a}"), F.col(f"{a}0") + F.col(f"p{a}")).otherwise(F.col(f"{a}0") + margin + s))
    return out


def split_local(local: DataFrame) -> DataFrame:
    """G2, in each patch: separate pieces of an instance get labels of their own."""
    patch = F.concat_ws("/", "vol_id", F.col("patch_id").cast("string"))
    pieces = split_disconnected(local.select(patch.alias("vol_id"), "z", "y", "x", "label")).withColumnsRenamed({"vol_id": "_patch", "label": "_piece"})
    return merge_join(local.withColumn("_patch", patch), pieces, ["_patch", "z", "y", "x"]).withColumn("label", F.col("_piece")).drop("_patch", "_piece")


def stitch_patches(local: DataFrame, patches: DataFrame, volumes: DataFrame, stride: Sequence[int], min_core: int = 64, min_iom: float = 0.2, min_largest: int = 10, min_ratio: float = 0.5) -> DataFrame:
    """One label volume from instances (vol_id, patch_id, z, y, x, label, confidence) of overlapping patches, in patch order.

    Instances are split into their connected pieces. One with enough voxels in its patch's core takes the label of the best stitched instance
    that touches it across a lower face of the core, else a new one; later patches overwrite earlier ones. Contact, and both areas on
    the face, count what is stitched into one label by then: labels are recomputed until none changes, and as each
    depends on earlier patches alone, the result is that of stitching one patch after the other.
    """
    core = core_bounds(patches, volumes, stride)
    bounds = core.select("vol_id", "patch_id", *(f"{m}_{a}" for a in "zyx" for m in ("lo", "hi")))
    inside = " AND ".join(f"{a} >= lo_{a} AND {a} < hi_{a}" for a in "zyx")
    rows = stored(split_local(local).join(bounds, ["vol_id", "patch_id"]).withColumn("core", F.expr(inside)), "stitch-rows")
    item = ["vol_id", "patch_id", "label"]
    sizes = rows.groupBy(*item).agg(F.sum(F.col("core").cast("long")).alias("core_size")).where(F.col("core_size") >= min_core)
    rows = merge_join(rows, sizes.select(*item), item, "left_semi")
    # the boxes of the cores, as patches whose first layer along an axis is a face
    boxes = bounds.select("vol_id", "patch_id", *(F.col(f"lo_{a}").alias(f"{a}0") for a in "zyx"), *((F.col(f"hi_{a}") - F.col(f"lo_{a}")).alias(f"p{a}") for a in "zyx"))
    mine = theirs = None
    for a in "zyx":
        flat = [c for c in "zyx" if c != a]
        plane = [F.lit(a).alias("face"), F.col(flat[0]).alias("y"), F.col(flat[1]).alias("x")]
        own = rows.where(f"core AND {a} = lo_{a} AND {a} > 0").select(*item, *plane)
        # voxels one layer below a face, moved up into the core; the last earlier patch that wrote one owns it
        below = rows.select("vol_id", F.col("patch_id").alias("from_patch"), F.col("label").alias("from_label"), *((F.col(c) + (1 if c == a else 0)).alias(c) for c in "zyx"))
        edge = boxes.where(f"{a}0 > 0").withColumn(f"p{a}", F.lit(1).cast("long"))
        hit = voxels_in_patches(below, edge).where("from_patch < patch_id")
        hit = hit.groupBy("vol_id", "patch_id", *plane).agg(F.max_by("from_label", "from_patch").alias("from_label"), F.max("from_patch").alias("from_patch"))
        mine, theirs = (own, hit) if mine is None else (mine.unionByName(own), theirs.unionByName(hit))
    theirs = stored(theirs, "stitch-below")
    place = ["vol_id", "patch_id", "face", "y", "x"]
    areas = stored(mine.groupBy(*item, "face").agg(F.count(F.lit(1)).alias("area_a")), "stitch-areas")
    touching = stored(merge_join(mine, theirs, place), "stitch-faces")

    root = ["up_patch", "up_label"]
    some = ["vol_id", F.floor(F.col("patch_id") / FACES), "face"]  # faces of all patches lie at the same place
    tree = stored(sizes.select(*item, F.col("patch_id").alias("up_patch"), F.col("label").alias("up_label")), "stitch-tree")
    while True:
        up = tree.select("vol_id", F.col("patch_id").alias("from_patch"), F.col("label").alias("from_label"), *root)
        below = merge_join(theirs, up, ["vol_id", "from_patch", "from_label"]).groupBy("vol_id", "patch_id", "face", *root).agg(F.count(F.lit(1)).alias("area_b"))
        contact = merge_join(touching, up, ["vol_id", "from_patch", "from_label"]).select(*item, "face", *root, F.lit(0).cast("long").alias("z"), "y", "x")
        found = contact_continuity(contact, [*item, "face", *root], some).join(areas, [*item, "face"]).join(below, ["vol_id", "patch_id", "face", *root])
        found = found.withColumn("iom", F.col("contact_total") / (F.least("area_a", "area_b") + 1e-6))
        found = found.where((F.col("iom") >= min_iom) & (F.col("contact_largest") >= min_largest) & (F.col("contact_ratio") >= min_ratio))
        # of equal candidates the first by face and label
        best = Window.partitionBy(*item).orderBy(F.desc("contact_largest"), F.desc("contact_ratio"), F.desc("iom"), F.desc("contact_total"), F.desc("face"), *root)
        parents = found.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(*item, F.col("up_patch").alias("_p"), F.col("up_label").alias("_l"))
        new = sizes.select(*item).join(parents, item, "left").select(*item, F.coalesce("_p", "patch_id").alias("up_patch"), F.coalesce("_l", "label").alias("up_label"))
        new = _roots(stored(new, "stitch-tree"), item)
        same = not new.join(tree, [*item, *root], "left_anti").limit(1).count()
        tree = new
        if same:
            break
    roots = tree.select("vol_id", *root).distinct().withColumn("global_label", F.row_number().over(Window.partitionBy("vol_id").orderBy(*root)).cast("long"))
    named = tree.join(roots, ["vol_id", *root]).select(*item, "global_label")
    out = merge_join(rows, named, item)
    return out.groupBy(*VOXEL).agg(F.max_by("global_label", "patch_id").alias("label"), F.avg("confidence").alias("confidence"))


def _roots(tree: DataFrame, item: list[str]) -> DataFrame:
    """Each item's last ancestor, by jumping along (up_patch, up_label); parents lie in earlier patches."""
    while True:
        up = tree.select("vol_id", F.col("patch_id").alias("up_patch"), F.col("label").alias("up_label"), F.col("up_patch").alias("_p"), F.col("up_label").alias("_l"))
        jump = stored(tree.join(up, ["vol_id", "up_patch", "up_label"]).select(*item, F.col("_p").alias("up_patch"), F.col("_l").alias("up_label")), "stitch-tree")
        if not jump.join(tree, [*item, "up_patch", "up_label"], "left_anti").limit(1).count():
            return jump
        tree = jump
