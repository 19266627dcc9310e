"""Affine maps of points, and the gates and scores that use them; all are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.scalars import angle_diff_axis, clamp


def project(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """(x, y) by the affine map m = [m00, m01, m02, m10, m11, m12]."""
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def reprojection_error(m: list[Column], x: Column, y: Column, u: Column, v: Column) -> Column:
    px, py = project(m, x, y)
    return F.hypot(px - u, py - v)


def rotation_degrees(m: list[Column]) -> Column:
    return F.degrees(F.atan2(m[3], m[0]))


def scale_of(m: list[Column]) -> Column:
    """The square root of the determinant's size; 1 for a degenerate map."""
    det = F.abs(m[0] * m[4] - m[1] * m[3])
    return F.when(det < 1e-8, 1.0).otherwise(F.sqrt(det))


def scale_in_range(scale: Column, low: float, high: float) -> Column:
    """False for nulls, nan and infinite scales."""
    return F.coalesce(~F.isnan(scale) & scale.between(low, high), F.lit(False))


def inside_border(x: Column, y: Column, width: Column, height: Column, margin: int) -> Column:
    return (x >= margin) & (y >= margin) & (x < width - margin) & (y < height - margin)


def overlap_ratio(x: Column, y: Column, width: Column, height: Column, size: int) -> Column:
    """The share of a square of this size around a point that lies in the image."""
    half = size / 2
    side = lambda at, most: F.greatest(F.lit(0.0), F.least(most.cast("double"), at + half) - F.greatest(F.lit(0.0), at - half))
    return side(x, width) * side(y, height) / float(size * size)


def candidate_gate(rows: DataFrame, margin: int = 8, most_angle: float = 30.0, low: float = 0.7, high: float = 1.4, least_std: float = 5.0) -> DataFrame:
    """Rows (x_a, y_a, angle_a, size_a, std_a and the same of b, width, height, rotation, scale, expanded) that may be positives.

    Both sides keep clear of the border and have texture; expanded rows also need a like direction and size. angle_error
    and scale_ratio are added; a row with a null in a column needed is left out.
    """
    c = F.col
    angle = angle_diff_axis(c("angle_b"), c("angle_a") + c("rotation"))
    ratio = c("size_b") / F.greatest(c("size_a") * c("scale"), F.lit(1e-6))
    clear = inside_border(c("x_a"), c("y_a"), c("width"), c("height"), margin) & inside_border(c("x_b"), c("y_b"), c("width"), c("height"), margin)
    like = ~c("expanded") | ((c("angle_error") <= most_angle) & c("scale_ratio").between(low, high))
    return rows.withColumn("angle_error", angle).withColumn("scale_ratio", ratio).where(clear & like & (F.least("std_a", "std_b") >= least_std))


def patch_reason(read: Column, overlap: Column, blank: Column, std: Column, valid: Column) -> Column:
    """Why a patch is refused, by the first rule that it fails; empty if it passes. Names and limits are fixed values."""
    rules = [(~read, "image_read_failed"), (overlap < 0.55, "overlap_too_low"), (blank > 0.55, "blank_ratio_too_high"), (std < 5.0, "patch_std_too_low"), (valid < 0.35, "valid_ratio_too_low")]
    return F.coalesce(*[F.when(rule, name) for rule, name in rules], F.lit(""))


def fused_score(unique: Column, texture: Column, low: int = 4, full: float = 12.0, geometry_weight: float = 0.7, texture_weight: float = 0.3) -> Column:
    """(score, decision) of a match by its unique inliers and texture similarity (null: not enough area)."""
    geometry, total = clamp(unique / full, 0.0, 1.0), geometry_weight + texture_weight
    score = clamp((geometry * geometry_weight + texture * texture_weight) / total, 0.0, 1.0)
    decided = lambda value, name: F.struct(value.alias("score"), F.lit(name).alias("decision"))
    return F.when(unique < low, decided(F.lit(0.0), "geometry_below_low_gate")).when(texture.isNull(), decided(F.lit(0.0), "insufficient_texture_area")).otherwise(decided(score, "fused_score"))


def quality_score(unique: Column, inlier_ratio: Column, dist_similarity: Column, reproj: Column) -> Column:
    """The weights are fixed values."""
    return 0.55 * F.least(unique / 40, F.lit(1.0)) + 0.20 * inlier_ratio + 0.15 * dist_similarity + 0.10 * clamp(1 - reproj / 5, 0.0, 1.0)
