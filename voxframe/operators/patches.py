"""Normalisation, patch grids, crops, padding and training patches.

A raw volume has one row per voxel: (vol_id, z, y, x, value). A patch is (patch_id, z0, y0, x0, pz, py, px).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import axis_starts, clipped, padded_length, reflected
from ..functions.joins import merge_join
from ..functions.scratch import stored
from .voxel import VOXEL, label_numbers


#: Ranges that the values of a range are dealt over in one step, and different values that are put in order in one task.
RANGES, MOST = 4096, 200_000


def percentile_ranges(counts: DataFrame, asked: DataFrame, ends: DataFrame, most: int = MOST) -> DataFrame:
    """(vol_id, base, lo, hi, kinds): ranges of values that hold the asked places, ``base`` values before each, with ``most`` different values at most.

    A range with more is cut into equal ones between its least and its greatest value, of which those without an asked place go. Both ends then lie in ranges
    of their own, so however far a value lies out, the others are told apart in the next step.
    """
    ranges, turn = ends.select("vol_id", F.lit(0).cast("long").alias("base"), F.col("lowest").alias("lo"), F.col("highest").alias("hi"), "kinds"), 0
    part = lambda x: F.greatest(F.least(x, F.lit(1.7e308)), F.lit(-1.7e308)) / 4  # noqa: E731  so that differences stay in range
    while True:
        ranges = stored(ranges, "percentile-ranges")
        wide = ranges.where((F.col("kinds") > most) & (F.col("hi") > F.col("lo")))
        if turn == 200 or not wide.limit(1).count():
            return ranges
        at = F.floor((part(F.col("_v")) - part(F.col("lo"))) / (part(F.col("hi")) - part(F.col("lo"))) * RANGES)
        at = F.when(F.col("_v") >= F.col("hi"), RANGES).otherwise(F.coalesce(at, F.lit(0)))
        cut = counts.join(wide, "vol_id").where("_v >= lo AND _v <= hi").groupBy("vol_id", "base", at.alias("_r"))
        cut = cut.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("kinds"), F.sum("_n").alias("_n"))
        upto = Window.partitionBy("vol_id", "base").orderBy("_r")
        cut = cut.select("vol_id", (F.col("base") + F.sum("_n").over(upto) - F.col("_n")).alias("base"), "lo", "hi", "kinds", "_n")
        cut = cut.join(asked.select("vol_id", "place").distinct(), "vol_id").where("place >= base AND place < base + _n").select("vol_id", "base", "lo", "hi", "kinds").distinct()
        ranges, turn = ranges.where((F.col("kinds") <= most) | (F.col("hi") <= F.col("lo"))).unionByName(cut), turn + 1


def exact_percentiles(rows: DataFrame, points: dict[str, float], name: str, most: int = MOST) -> DataFrame:
    """(vol_id, lowest, highest, and each point by its name): percentiles with linear interpolation, exactly, in any number of tasks.

    Equal values are counted first; volumes with few different ones are done by that. Else the ranges that hold a percentile's neighbours are cut until they have
    ``most`` different values at most (see ``percentile_ranges``), and only these are put in order, a range in a task of its own.
    """
    v = F.col(name).cast("double")
    counts = stored(rows.where(v.isNotNull()).groupBy("vol_id", v.alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    ends = counts.groupBy("vol_id").agg(F.min("_v").alias("lowest"), F.max("_v").alias("highest"), F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("kinds"))
    ends = stored(ends, "value-ends")  # a row for each volume
    places = [F.struct(F.lit(p).alias("p"), g(F.lit(q) * (F.col("_all") - 1)).cast("long").alias("place")) for p, q in points.items() for g in (F.floor, F.ceil)]
    asked = ends.withColumn("_a", F.explode(F.array(*places))).select("vol_id", "_a.*").distinct()
    ranges = percentile_ranges(counts, asked, ends, most)
    inside = counts.join(ranges, "vol_id").where("_v >= lo AND _v <= hi")
    last = F.col("base") + F.sum("_n").over(Window.partitionBy("vol_id", "base").orderBy("_v"))
    inside = inside.select("vol_id", "_v", last.alias("_last"), (last - F.col("_n")).alias("_first"))
    hit = asked.join(inside, "vol_id").where("place >= _first AND place < _last").groupBy("vol_id", "p").agg(F.min_by("_v", "place").alias("low"), F.max_by("_v", "place").alias("high"))
    hit = hit.groupBy("vol_id").agg(*(F.max(F.when(F.col("p") == p, F.struct("low", "high"))).alias(f"_{p}") for p in points))
    out = ends.join(hit, "vol_id", "left")
    part = {p: F.lit(q) * (F.col("_all") - 1) for p, q in points.items()}
    out = out.withColumns({p: F.col(f"_{p}.low") + (F.col(f"_{p}.high") - F.col(f"_{p}.low")) * (part[p] - F.floor(part[p])) for p in points})
    return out.drop("_all", "kinds", *(f"_{p}" for p in points))


def percentile_stats(raw: DataFrame, low: float = 1, high: float = 99, name: str = "value") -> DataFrame:
    out = exact_percentiles(raw, {"p_low": low / 100, "p_high": high / 100}, name)
    return out.select("vol_id", "p_low", "p_high", F.col("lowest").alias("raw_min"), F.col("highest").alias("raw_max"))


def percentile_normalize(raw: DataFrame, low: float = 1, high: float = 99) -> DataFrame:
    """Values cut to two percentiles and scaled to 0..1; all 0 where the percentiles are equal."""
    out = raw.join(percentile_stats(raw, low, high), "vol_id")
    scaled = (clipped(F.col("value").cast("double"), F.col("p_low"), F.col("p_high")) - F.col("p_low")) / (F.col("p_high") - F.col("p_low"))
    return out.select(*raw.columns, F.when(F.col("p_high") <= F.col("p_low"), 0.0).otherwise(scaled).alias("norm"))


def normalized_threshold(stats: DataFrame, background: float) -> DataFrame:
    """A raw background value on the normalised scale, 0 where the scale is degenerate."""
    t = clipped((background - F.col("p_low")) / (F.col("p_high") - F.col("p_low")), 0.0, 1.0)
    return stats.select("vol_id", F.when(F.col("p_high") <= F.col("p_low"), 0.0).otherwise(t).alias("threshold"))


def minmax_normalize(raw: DataFrame) -> DataFrame:
    """(value - least) / (greatest - least + 1e-8)."""
    ends = raw.groupBy("vol_id").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    return raw.join(ends, "vol_id").select(*raw.columns, ((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8)).alias("norm"))


def auto_contrast(raw: DataFrame, volumes: DataFrame, low: float = 0.2, high: float = 99.8) -> DataFrame:
    """Display range from the first, middle and last slice; least and greatest value if the percentiles are equal, then one more."""
    some = raw.join(volumes.select("vol_id", "nz"), "vol_id").where("z IN (0, nz div 2, nz - 1)")
    p = percentile_stats(some, low, high)
    lo = F.when(F.col("p_high") > F.col("p_low"), F.col("p_low")).otherwise(F.col("raw_min"))
    hi = F.when(F.col("p_high") > F.col("p_low"), F.col("p_high")).otherwise(F.col("raw_max"))
    return p.select("vol_id", lo.alias("contrast_low"), F.when(hi > lo, hi).otherwise(lo + 1).alias("contrast_high"))


def bright_display(raw: DataFrame, contrast: DataFrame, gamma: float = 0.75) -> DataFrame:
    """Values in the display range, raised to a power."""
    v = clipped((F.col("value") - F.col("contrast_low")) / (F.col("contrast_high") - F.col("contrast_low")), 0.0, 1.0)
    return raw.join(contrast, "vol_id").select(*raw.columns, F.pow(v, F.lit(gamma)).alias("display"))


def _grid(volumes: DataFrame, starts: dict[str, object], patch: Sequence[int]) -> DataFrame:
    g = volumes.select("vol_id", *(s.alias(f"_{a}") for a, s in starts.items()))
    for a in "zyx":
        g = g.withColumn(f"{a}0", F.explode(f"_{a}"))
    number = F.row_number().over(Window.partitionBy("vol_id").orderBy("z0", "y0", "x0")).cast("long")
    return g.select("vol_id", number.alias("patch_id"), "z0", "y0", "x0", *(F.lit(p).cast("long").alias(f"p{a}") for a, p in zip("zyx", patch)))


def patch_grid(volumes: DataFrame, patch: Sequence[int], stride: Sequence[int]) -> DataFrame:
    """Patches in order of z, y, x that cover each volume to its end."""
    return _grid(volumes, {a: axis_starts(F.col(f"n{a}"), p, s) for a, p, s in zip("zyx", patch, stride)}, patch)


def inference_grid(volumes: DataFrame, patch: Sequence[int], stride: Sequence[int] | None = None) -> DataFrame:
    """Patches at regular starts over the padded volume; the stride is half a patch by default."""
    stride = stride or [p // 2 for p in patch]
    starts = {a: F.sequence(F.lit(0).cast("long"), padded_length(F.col(f"n{a}"), p, s) - p, F.lit(s).cast("long")) for a, p, s in zip("zyx", patch, stride)}
    return _grid(volumes, starts, patch)


def pad_volume(rows: DataFrame, volumes: DataFrame, patch: Sequence[int], stride: Sequence[int]) -> DataFrame:
    """The volume lengthened at its ends, mirrored without repeating the edge. Labels padded with 0 need no rows."""
    return mirrored(rows, volumes, {a: padded_length(F.col(f"n{a}"), p, s) for a, p, s in zip("zyx", patch, stride)})


def mirrored(rows: DataFrame, volumes: DataFrame, lengths: dict) -> DataFrame:
    """The volume lengthened to the given length on each axis."""
    v = volumes.select("vol_id", *(f"n{a}" for a in "zyx"), *(n.alias(f"m{a}") for a, n in lengths.items()))
    out = rows
    for a in "zyx":  # each axis maps source index to all padded indexes
        axis = v.select("vol_id", F.col(f"n{a}").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"m{a}") - 1)).alias("to"))
        axis = axis.select("vol_id", "to", reflected(F.col("to"), F.col("n")).alias(a))
        out = out.join(axis, ["vol_id", a]).drop(a).withColumnRenamed("to", a)
    return out.select(*rows.columns)


def crop_box(rows: DataFrame, low: Sequence[int], high: Sequence[int], origin: bool = True) -> DataFrame:
    """P25: rows in a half-open box, counted from its corner."""
    inside = rows.where(" AND ".join(f"{a} >= {lo} AND {a} < {hi}" for a, lo, hi in zip("zyx", low, high)))
    return inside.withColumns({a: F.col(a) - lo for a, lo in zip("zyx", low)}) if origin else inside


def crop_centered(rows: DataFrame, volumes: DataFrame, clicks: DataFrame, patch: Sequence[int]) -> DataFrame:
    """The patch around each click (vol_id, click_id, cz, cy, cx), mirrored at the volume's ends, in the patch's coordinates. A click outside is an error."""
    c = clicks.join(volumes, "vol_id")
    if c.where(" OR ".join(f"c{a} < 0 OR c{a} >= n{a}" for a in "zyx")).limit(1).count():
        raise ValueError("a click lies outside its volume")
    out = c.select("vol_id", "click_id", *(f"c{a}" for a in "zyx"), *(f"n{a}" for a in "zyx"))
    for a, p in zip("zyx", patch):
        out = out.withColumn(f"local_{a}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p - 1).cast("long"))))
        out = out.withColumn(a, reflected(F.col(f"c{a}") - p // 2 + F.col(f"local_{a}"), F.col(f"n{a}")))
    return merge_join(out, rows, VOXEL).select("vol_id", "click_id", *(f"local_{a}" for a in "zyx"), *[x for x in rows.columns if x not in VOXEL])


def expand_bbox(boxes: DataFrame, factor: float = 2.0, least: int = 1) -> DataFrame:
    """Boxes (lo_a, hi_a half-open, n_a) grown about their centre, moved back inside the volume."""
    out = boxes
    for a in "zyx":
        size = F.least(F.greatest(F.ceil((F.col(f"hi_{a}") - F.col(f"lo_{a}")) * factor), F.lit(least)), F.col(f"n{a}")).cast("long")
        start = F.floor((F.col(f"lo_{a}") + F.col(f"hi_{a}") - size) / 2)
        start = F.least(F.greatest(start, F.lit(0)), F.col(f"n{a}") - size).cast("long")
        out = out.withColumn(f"_lo_{a}", start).withColumn(f"_hi_{a}", start + size)
    for a in "zyx":
        out = out.drop(f"lo_{a}", f"hi_{a}").withColumnRenamed(f"_lo_{a}", f"lo_{a}").withColumnRenamed(f"_hi_{a}", f"hi_{a}")
    return out


def union_bboxes(boxes: DataFrame, keys: Sequence[str], margin: int = 2) -> DataFrame:
    """One box around all of a group, with a margin, cut to the volume."""
    aggs = [x for a in "zyx" for x in (F.greatest(F.min(f"lo_{a}") - margin, F.lit(0)).alias(f"lo_{a}"), F.least(F.max(f"hi_{a}") + margin, F.max(f"n{a}")).alias(f"hi_{a}"))]
    return boxes.groupBy(*keys).agg(*aggs)


def voxels_in_patches(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """Every row with each patch that covers it. On each axis the covering starts come from a small table of starts, so all joins are equi joins."""
    out = rows
    for a in "zyx":
        at = patches.select("vol_id", f"{a}0", f"p{a}").distinct().withColumn(a, F.explode(F.sequence(F.col(f"{a}0"), F.col(f"{a}0") + F.col(f"p{a}") - 1)))
        out = out.join(at.drop(f"p{a}"), ["vol_id", a])
    return out.join(patches, ["vol_id", "z0", "y0", "x0"])


def instances_per_patch(voxels: DataFrame, patches: DataFrame) -> DataFrame:
    """Labels in each patch, 0 included."""
    found = voxels_in_patches(voxels, patches).groupBy("vol_id", "patch_id").agg(F.countDistinct("label").alias("_n"))
    return patches.join(found, ["vol_id", "patch_id"], "left").select("vol_id", "patch_id", F.coalesce("_n", F.lit(0)).cast("long").alias("instances"))


def _renumbered(kept: DataFrame, patches: DataFrame) -> DataFrame:
    out = patches.join(kept, ["vol_id", "patch_id"])
    return out.withColumn("patch_id", F.row_number().over(Window.partitionBy("vol_id").orderBy("z0", "y0", "x0")).cast("long"))


def valid_patches_max(raw: DataFrame, patches: DataFrame, threshold: float) -> DataFrame:
    """Patches whose greatest raw value reaches the threshold, numbered anew in grid order."""
    top = voxels_in_patches(raw, patches).groupBy("vol_id", "patch_id").agg(F.max("value").alias("max_value"))
    return _renumbered(top.where(F.col("max_value") >= threshold), patches)


def patch_p999(normalized: DataFrame, patches: DataFrame) -> DataFrame:
    """The 99.9 percentile of normalised intensity in each patch, background included."""
    return voxels_in_patches(normalized, patches).groupBy("vol_id", "patch_id").agg(F.percentile("norm", F.lit(0.999)).alias("p999"))


def valid_patches_p999(normalized: DataFrame, patches: DataFrame, threshold: float) -> DataFrame:
    """Patches whose 99.9 percentile is not below the threshold."""
    return _renumbered(patch_p999(normalized, patches).where(F.col("p999") >= threshold), patches)


def sample_patches(patches: DataFrame, n: int, seed: int = 2026) -> DataFrame:
    """O2: at most n patches of each volume, drawn by a hash of seed and patch, in grid order."""
    drawn = F.row_number().over(Window.partitionBy("vol_id").orderBy(F.xxhash64(F.lit(seed), "vol_id", "patch_id"), "patch_id"))
    return patches.withColumn("_n", drawn).where(F.col("_n") <= n).drop("_n").orderBy("vol_id", "z0", "y0", "x0")


def strided_sample(rows: DataFrame, n: int, order: Sequence[str] = ("z", "y", "x")) -> DataFrame:
    """O3: at most n evenly spaced rows of each volume. Rows are numbered in groups of the first of ``order``, which are counted before; no window runs over a volume."""
    first, *rest = order
    counts = rows.groupBy("vol_id", first).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("vol_id").orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_base": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy("vol_id"))})
    line = Window.partitionBy("vol_id", first).orderBy(*rest)
    step = F.greatest(F.ceil(F.col("_all") / n), F.lit(1))
    out = rows.withColumn("_at", F.row_number().over(line) - 1).join(counts.select("vol_id", first, "_base", "_all"), ["vol_id", first])
    return out.where((F.col("_base") + F.col("_at")) % step == 0).select(*rows.columns)


def training_patches(voxels: DataFrame, raw: DataFrame, volumes: DataFrame, patch: Sequence[int], stride: Sequence[int], min_instances: int = 1, threshold: float | None = None, limit: int | None = None, seed: int = 2026) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(patches kept, image rows, label rows) for training; labels run 1..N in each patch, which is named by its corner.

    Patches are chosen by their labels first. The 99.9 percentile is computed only with a ``threshold``, and only for those. A volume
    shorter than a patch is mirrored for images; labels are 0 there.
    """
    grid = patch_grid(volumes, patch, stride)
    inside = stored(voxels_in_patches(voxels.select(*VOXEL, "label"), grid), "patch-labels")
    enough = inside.groupBy("vol_id", "patch_id").agg(F.countDistinct("label").alias("instances")).where(F.col("instances") >= min_instances)
    if min_instances < 1:
        enough = grid.select("vol_id", "patch_id").join(enough, ["vol_id", "patch_id"], "left").fillna(0, ["instances"])
    kept = grid.join(enough, ["vol_id", "patch_id"])
    norm = percentile_normalize(raw)
    if threshold is not None:
        norm = stored(norm, "normalised")  # read for the percentiles, and for the images
        kept = kept.join(patch_p999(norm, kept.drop("instances")).where(F.col("p999") >= threshold), ["vol_id", "patch_id"])
    if limit is not None:
        kept = sample_patches(kept, limit, seed)
    # images and labels both follow the patches that are kept
    kept = stored(kept.withColumn("patch_name", F.format_string("%s_z%04d_y%04d_x%04d", "vol_id", "z0", "y0", "x0")), "patches")
    corner = kept.select("vol_id", "patch_id", "patch_name", *(f"{a}0" for a in "zyx"), *(f"p{a}" for a in "zyx"))
    local = [(F.col(a) - F.col(f"{a}0")).alias(a) for a in "zyx"]
    whole = mirrored(norm, volumes, {a: F.greatest(F.col(f"n{a}"), F.lit(p).cast("long")) for a, p in zip("zyx", patch)})
    images = voxels_in_patches(whole, corner).select("vol_id", "patch_name", *local, "norm")
    labels = merge_join(inside.select("vol_id", "patch_id", *VOXEL[1:], "label"), corner, ["vol_id", "patch_id"])
    numbers = label_numbers(labels, ("vol_id", "patch_name"))
    labels = merge_join(labels, numbers, ["vol_id", "patch_name", "label"]).select("vol_id", "patch_name", *local, F.col("new_label").alias("label"))
    return kept, images, labels


def patch_export_summary(grid: DataFrame, kept: DataFrame, stats: DataFrame) -> DataFrame:
    """For each volume all and saved patches, the least, greatest and mean instances of those saved, and the normalisation's bounds."""
    every = grid.groupBy("vol_id").agg(F.count(F.lit(1)).alias("all_patches"))
    saved = kept.groupBy("vol_id").agg(F.count(F.lit(1)).alias("saved_patches"), F.min("instances").alias("min_instances"), F.max("instances").alias("max_instances"), F.avg("instances").alias("mean_instances"))
    return every.join(saved, "vol_id", "left").join(stats.select("vol_id", "p_low", "p_high"), "vol_id").withColumn("saved_patches", F.coalesce("saved_patches", F.lit(0)).cast("long"))
