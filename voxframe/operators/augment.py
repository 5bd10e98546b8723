"""Augmentation of training patches: rows (patch_name, z, y, x, norm) or labels, with draws that a hash of patch and seed decides."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import merge_join
from ..functions.scratch import stored


def draw(seed: int, what: str, *keys: str):
    """A number in 0..1 that depends on the keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *keys), F.lit(1_000_003)) / 1_000_003.0


def normal(seed: int, what: str, *keys: str):
    """A standard normal number, from two draws."""
    u = F.greatest(draw(seed, what + "/u", *keys), F.lit(1e-9))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * draw(seed, what + "/v", *keys))


def flip_rot90(rows: DataFrame, size: tuple[int | str, int | str, int | str], seed: int = 0) -> DataFrame:
    """Flips along each axis and quarter turns of y and x, the same for an image and its labels.

    Coordinates are local to the patch. ``size``: numbers, or names of columns that hold each patch's own size.
    Only patches whose y and x are of one size turn.
    """
    nz, ny, nx = sizes = [F.col(n) if isinstance(n, str) else F.lit(n) for n in size]
    z, y, x = (F.when(draw(seed, f"flip {a}", "patch_name") < 0.5, n - 1 - F.col(a)).otherwise(F.col(a)) for a, n in zip("zyx", sizes))
    out = rows.withColumns({"z": z, "y": y, "x": x})
    turns = F.when(ny == nx, F.floor(draw(seed, "turn", "patch_name") * 4)).otherwise(0)
    ty = F.when(turns == 1, nx - 1 - F.col("x")).when(turns == 2, ny - 1 - F.col("y")).when(turns == 3, F.col("x")).otherwise(F.col("y"))
    tx = F.when(turns == 1, F.col("y")).when(turns == 2, nx - 1 - F.col("x")).when(turns == 3, ny - 1 - F.col("y")).otherwise(F.col("x"))
    return out.withColumns({"y": ty, "x": tx})


def intensity_jitter(rows: DataFrame, seed: int = 0, brightness: float = 0.08, contrast: float = 0.3) -> DataFrame:
    """A normal shift of brightness and a log-uniform contrast around the patch's mean, cut to 0..1."""
    mean = rows.groupBy("patch_name").agg(F.avg("norm").alias("_mean"))
    gain = F.exp((draw(seed, "contrast", "patch_name") * 2 - 1) * contrast)
    v = (F.col("norm") - F.col("_mean")) * gain + F.col("_mean") + brightness * normal(seed, "brightness", "patch_name")
    return rows.join(mean, "patch_name").withColumn("norm", F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))).drop("_mean")


def blur(rows: DataFrame, sigmas: dict[str, float]) -> DataFrame:
    """Gaussian blur along each axis in turn, weights renewed at the ends of the patch, which is a full box."""
    ends = rows.groupBy("patch_name").agg(*(g(a).alias(f"_{m}_{a}") for a in sigmas for m, g in (("lo", F.min), ("hi", F.max))))
    out = rows.join(ends, "patch_name")
    for a, s in sigmas.items():
        if s <= 0:
            continue
        reach = max(1, int(3 * s + 0.5))
        taps = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(float(np.exp(-d * d / (2 * s * s)))).alias("w")) for d in range(-reach, reach + 1)))
        spread = out.withColumn("_t", F.explode(taps)).withColumn("_to", F.col(a) + F.col("_t.d")).where(F.col("_to").between(F.col(f"_lo_{a}"), F.col(f"_hi_{a}")))
        rest = [c for c in out.columns if c not in (a, "norm")]
        out = spread.groupBy(*rest, F.col("_to").alias(a)).agg((F.sum(F.col("norm") * F.col("_t.w")) / F.sum("_t.w")).alias("norm"))
    return out.select(*rows.columns)


def poisson_noise(rows: DataFrame, photons: float = 100.0, seed: int = 0) -> DataFrame:
    """Each value as a count of photons, drawn anew; the draws are of NumPy, seeded by patch and place."""

    def noisy(batches):
        for pdf in batches:
            if len(pdf):
                rng = np.random.default_rng(pd.util.hash_pandas_object(pdf[["patch_name", "z", "y", "x"]], index=False).to_numpy() ^ np.uint64(seed))
                pdf["norm"] = np.clip(rng.poisson(np.maximum(pdf.norm, 0) * photons) / photons, 0, 1)
            yield pdf

    return rows.mapInPandas(noisy, rows.schema)


def coarse_xy(rows: DataFrame, factor: int = 2) -> DataFrame:
    """Y and x sampled down and up again: each value becomes its block's mean."""
    block = ["patch_name", "z", F.floor(F.col("y") / factor).alias("_by"), F.floor(F.col("x") / factor).alias("_bx")]
    means = rows.groupBy(*block).agg(F.avg("norm").alias("_mean"))
    keyed = rows.withColumns({"_by": F.floor(F.col("y") / factor), "_bx": F.floor(F.col("x") / factor)})
    return merge_join(keyed, means, ["patch_name", "z", "_by", "_bx"]).withColumn("norm", F.col("_mean")).select(*rows.columns)


def degrade(rows: DataFrame, seed: int = 0, share: float = 0.5) -> DataFrame:
    """Half of the patches get one of Poisson noise, blur, coarse y and x, or blur along z."""
    kind = F.when(draw(seed, "degrade", "patch_name") < share, F.floor(draw(seed, "kind", "patch_name") * 4)).otherwise(-1)
    kinds = rows.select("patch_name").distinct().withColumn("_kind", kind)
    marked = stored(rows.join(kinds, "patch_name"), "degrade")
    pick = lambda k: marked.where(F.col("_kind") == k).select(*rows.columns)
    out = pick(-1).unionByName(poisson_noise(pick(0), seed=seed)).unionByName(blur(pick(1), {"z": 1.0, "y": 1.0, "x": 1.0}))
    return out.unionByName(coarse_xy(pick(2))).unionByName(blur(pick(3), {"z": 2.0, "y": 0.5, "x": 0.5}))


def random_scale(rows: DataFrame, size: tuple[int, int, int], seed: int = 0, low: float = 0.75, high: float = 1.5, value: str = "norm") -> DataFrame:
    """Y and x scaled about the centre by a factor in low..high, nearest source, then cut or filled to the patch's size: images repeat their edge, labels are left empty."""
    nz, ny, nx = size
    grid = rows.select("patch_name", "z").distinct().withColumn("_f", low + (high - low) * draw(seed, "scale", "patch_name"))
    for a, n in (("y", ny), ("x", nx)):
        grid = grid.withColumn(f"_to_{a}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        source = F.floor((F.col(f"_to_{a}") - (n - 1) / 2) / F.col("_f") + (n - 1) / 2 + 0.5)
        if value != "label":
            source = F.least(F.greatest(source, F.lit(0)), F.lit(n - 1))
        grid = grid.withColumn(a, source)
    out = merge_join(grid, rows, ["patch_name", "z", "y", "x"])
    return out.select("patch_name", "z", F.col("_to_y").alias("y"), F.col("_to_x").alias("x"), value)
