"""Column expressions: geometry, normalisation, shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def equivalent_diameter(volume: Column) -> Column:
    """Diameter of the ball of this volume."""
    return F.pow(6 * volume / F.pi(), F.lit(1 / 3))


def sphericity(volume: Column, surface: Column) -> Column:
    return F.pow(F.pi(), F.lit(1 / 3)) * F.pow(6 * volume, F.lit(2 / 3)) / (surface + EPS)


def compactness(volume: Column, surface: Column) -> Column:
    return F.pow(surface, F.lit(1.5)) / (volume + EPS)


def clipped(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def missing_if_nan(value: Column) -> Column:
    """NaN and infinities as null, so that aggregates skip them."""
    value = value.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def anisotropy_ratio(vz: Column, vy: Column, vx: Column) -> Column:
    return F.greatest(vz, vy, vx) / (F.least(vz, vy, vx) + EPS)


def categorical_code(value: Column) -> Column:
    """Class numbers as image values: value + 1 in 0..65535, missing 0."""
    return clipped(F.coalesce(value.cast("long"), F.lit(-1)) + 1, 0, 65535)


def quantized_uint16(value: Column, p_low: Column, p_high: Column) -> Column:
    """0..65535 between two percentiles, cut down to whole numbers; missing 0."""
    scaled = clipped((value - p_low) / (p_high - p_low + EPS), 0.0, 1.0) * 65535
    return F.coalesce(F.floor(scaled), F.lit(0)).cast("long")


def axis_starts(length: Column, patch: int, stride: int) -> Column:
    """Start positions 0, stride, ... and one last that reaches the end; only 0 if the axis is no longer than a patch."""
    if stride <= 0:
        raise ValueError("stride must be positive")
    last = length - patch
    covered = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long")), F.array(last)))
    return F.when(length <= patch, F.array(F.lit(0).cast("long"))).otherwise(covered)


def padded_length(length: Column, patch: int, stride: int) -> Column:
    """Length that regular starts cover whole."""
    return F.when(length <= patch, F.lit(patch).cast("long")).otherwise((patch + F.ceil((length - patch) / stride) * stride).cast("long"))


def reflected(position: Column, length: Column) -> Column:
    """Source index of a position past the end when an axis is mirrored without repeating its edge."""
    period = 2 * (length - 1)
    folded = F.pmod(position, period)
    return F.when(length <= 1, F.lit(0).cast("long")).otherwise(F.when(folded < length, folded).otherwise(period - folded))


def region_bin(centroid: Column, extent: Column, bins: int) -> Column:
    """Bin of a coordinate in 0..bins-1."""
    return clipped(F.floor(centroid / (extent / bins)), 0, bins - 1).cast("int")


def width_of_label(largest: Column) -> Column:
    """Narrowest unsigned type that holds the largest label."""
    return F.when(largest <= 65535, "uint16").when(largest <= 4294967295, "uint32").otherwise("uint64")


def log_note(operation: Column, label: Column, z: Column, old: Column, new: Column) -> Column:
    """One line of an edit's note."""
    return F.concat_ws("; ", F.format_string("%s label=%d", operation, label), F.format_string("z=%d", z), F.format_string("voxels %d -> %d", old, new))


def symmetric_eigenvalues(a: str, b: str, c: str, d: str, e: str, f: str) -> dict[str, str]:
    """SQL for the eigenvalues, largest first, of [[a, d, e], [d, b, f], [e, f, c]], by the closed form with a cosine.

    Steps by name; each may use the names before it.
    """
    return {
        "eig_q": f"(({a}) + ({b}) + ({c})) / 3",
        "eig_p": f"sqrt((pow(({a}) - eig_q, 2) + pow(({b}) - eig_q, 2) + pow(({c}) - eig_q, 2) + 2 * (pow({d}, 2) + pow({e}, 2) + pow({f}, 2))) / 6)",
        "eig_r": f"CASE WHEN eig_p > 0 THEN greatest(-1.0D0, least(1.0D0, ((({a}) - eig_q) * ((({b}) - eig_q) * (({c}) - eig_q) - pow({f}, 2)) - ({d}) * (({d}) * (({c}) - eig_q) - ({f}) * ({e})) + ({e}) * (({d}) * ({f}) - (({b}) - eig_q) * ({e}))) / (2 * pow(eig_p, 3)))) ELSE 0.0D0 END".replace("D0", ""),
        "eig_phi": "acos(eig_r) / 3",
        "eig_1": "greatest(0, eig_q + 2 * eig_p * cos(eig_phi))",
        "eig_3": "greatest(0, eig_q + 2 * eig_p * cos(eig_phi + 2 * pi() / 3))",
        "eig_2": "greatest(0, 3 * eig_q - (eig_q + 2 * eig_p * cos(eig_phi)) - (eig_q + 2 * eig_p * cos(eig_phi + 2 * pi() / 3)))",
    }
