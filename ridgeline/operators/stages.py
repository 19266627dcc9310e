"""At which stage verification attempts fail, and how many attempts reach each stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The counts of an attempt's templates that reach a stage, and the numbers of its best template.
COUNTS = ["templates_with_candidates", "templates_with_abs_distance_pass", "templates_with_ratio_pass", "templates_with_ransac_success", "scale_rejected", "templates_with_unique_inlier_ready", "templates_with_texture_evaluated", "templates_with_texture_available", "templates_with_fused_score"]
MEANS = {
    "mean_best_candidates": "num_candidates",
    "mean_best_raw_inliers": "raw_inliers",
    "mean_best_unique_inliers": "unique_inliers",
    "mean_max_unique_inliers": "max_unique_inliers",
    "mean_max_candidate_query_coverage": "max_candidate_query_coverage",
    "mean_best_reprojection_error": "mean_reproj_error",
}
RATES = {
    "candidate_ready_rate": "templates_with_candidates",
    "ratio_ready_rate": "templates_with_ratio_pass",
    "ransac_success_rate": "templates_with_ransac_success",
    "unique_inlier_ready_rate": "templates_with_unique_inlier_ready",
    "texture_available_rate": "templates_with_texture_available",
    "fused_score_ready_rate": "templates_with_fused_score",
}


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _reached(name: str) -> Column:
    """Counts are whole numbers; what is behind a decimal point is cut off."""
    return F.floor(F.abs(_number(name))) > 0


def failure_stage(threshold: float, candidate_policy: str = "topk_or_ratio", texture: bool = False, edge: float = 0.05) -> Column:
    """The earliest stage at which a genuine attempt failed, from its counts and scores; nulls count as 0. Ten stages, in order."""
    ratio_counts = candidate_policy.lower() in ("ratio_only", "topk_or_ratio")
    no_candidates, no_fit = ~_reached("templates_with_candidates"), ~_reached("templates_with_ransac_success")
    stage = F.when(no_candidates & ~_reached("templates_with_abs_distance_pass"), "descriptor_distance_reject")
    if ratio_counts:
        stage = stage.when(no_candidates & ~_reached("templates_with_ratio_pass"), "ratio_reject")
    stage = stage.when(no_candidates, "candidate_insufficient")
    stage = stage.when(no_fit & _reached("scale_rejected") & (_number("scale_rejected") > 0), "ransac_scale_reject").when(no_fit, "ransac_failed")
    stage = stage.when(~_reached("templates_with_unique_inlier_ready"), "unique_inlier_insufficient")
    if texture:
        stage = stage.when(_reached("templates_with_texture_evaluated") & ~_reached("templates_with_texture_available"), "texture_unavailable")
        stage = stage.when(_reached("templates_with_fused_score") & (_number("max_geometry_similarity") >= threshold) & (_number("score") < threshold), "texture_fusion_reject")
    return stage.when(F.lit(threshold) - _number("score") <= edge, "threshold_edge").otherwise("score_below_threshold")


def stage_coverage(attempts: DataFrame) -> DataFrame:
    """A row for genuine and for impostor attempts (label 1 or not): their number, how many have candidates, the shares that reach
    each stage, and means of the best template's numbers. Nulls count as 0; a kind without attempts has zeros."""
    kind = F.when(F.coalesce(F.col("label").cast("int"), F.lit(0)) == 1, "genuine").otherwise("impostor").alias("kind")
    share = lambda name: F.avg((_number(name) > 0).cast("int"))
    measures = [F.count("*").alias("count"), F.count_if(_number("templates_with_candidates") > 0).alias("candidate_ready")]
    measures += [share(c).alias(n) for n, c in RATES.items()] + [F.avg(_number(c)).alias(n) for n, c in MEANS.items()]
    spine = attempts.sparkSession.createDataFrame([("genuine",), ("impostor",)], "kind string")
    return spine.join(attempts.groupBy(kind).agg(*measures), "kind", "left").fillna(0)
