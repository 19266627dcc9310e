"""Scalar expressions: angles, ids, numbers as text, geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def exp_score(x: Column, scale: float) -> Column:
    """exp(-x / scale) for x >= 0; 1 below 0."""
    return F.exp(-F.greatest(x, F.lit(0.0)) / max(scale, 1e-6))


def angle_diff(a: Column, b: Column) -> Column:
    """The angle between two directions in degrees, 0 to 180."""
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def angle_diff_axis(a: Column, b: Column) -> Column:
    """The angle between two undirected axes, 0 to 90."""
    d = angle_diff(a, b)
    return F.least(d, 180 - d)


def wrap_angle(a: Column) -> Column:
    """An angle in (-180, 180]."""
    return 180 - F.pmod(180 - a, F.lit(360.0))


def sanitize_token(x: Column) -> Column:
    """A text as part of a file name: other characters and runs of _ become one _; none at the ends; unknown if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), "[^A-Za-z0-9._-]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(clean, "^[._]+|[._]+$", ""), F.lit("")), F.lit("unknown"))


def stable_id(*parts: Column, readable: int = 4, digest: int = 12) -> Column:
    """Readable parts and a hash of all parts, at most 180 characters."""
    text = [p.cast("string") for p in parts]
    mark = F.substring(F.sha1(F.concat_ws("|", *text)), 1, digest)
    return F.substring(F.concat_ws("__", *[sanitize_token(p) for p in text[:readable]], mark), 1, 180)


def significant(x: Column, digits: int = 4) -> Column:
    """A number rounded to so many significant digits."""
    return F.format_string(f"%.{digits - 1}e", x).cast("double")


def tolerant_double(x: Column) -> Column:
    """A number in a text, null for anything else."""
    return F.trim(x).try_cast("double")


def stability_score(seed: Column, dist: Column, reproj: Column, angle: Column, scale: Column, response: Column, texture: Column) -> Column:
    """The weighted quality of a correspondence, 0 to 1. The weights are fixed values."""
    terms = [(0.08, seed), (0.22, exp_score(dist, 0.7)), (0.24, exp_score(reproj, 5.0)), (0.18, exp_score(angle, 30.0)), (0.10, scale), (0.08, response), (0.10, texture)]
    total = F.lit(0.0)
    for weight, value in terms:
        total = total + weight * value
    return clamp(total, 0.0, 1.0)
