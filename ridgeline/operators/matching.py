"""Matches of two images verified by geometry: robust affine maps, their inliers, one-to-one matches and a summary of each pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.functions.scalars import wrap_angle
from ridgeline.operators.geometry import reprojection_error, rotation_degrees, scale_in_range, scale_of
from ridgeline.operators.pairs import affine_fit, dominant_angle
from ridgeline.sources.tables import written


def similarity(a: Column, b: Column, tx: Column, ty: Column) -> list[Column]:
    """The six entries of a rotation, scale and shift."""
    return [a, -b, tx, b, a, ty]


def hypotheses(points: DataFrame, by: list[str], count: int, pool: int, seed: int) -> DataFrame:
    """(by, h, a, b, tx, ty): at most count maps a group, each through two of its points.

    The points of a group are put in the order of a seeded hash and the first `pool` of them numbered. Map h goes through point
    h mod n and the one 1 + (h div n) places further on (round the n points), so few points give each pair of them before any
    comes again, and many points give pairs as random as the hash. Two equal places give no map. Only the pool's points are
    shuffled, twice count rows a group at most.
    """
    c = F.col
    key = F.md5(F.concat(F.lit(f"{seed}|"), c("id").cast("string")))
    ranked = points.select(*by, "id", "x", "y", "u", "v", (F.row_number().over(W.partitionBy(*by).orderBy(key, "id")) - 1).alias("i")).where(c("i") < pool)
    placed = ranked.withColumn("n", F.count("*").over(W.partitionBy(*by))).withColumn("h_end", F.least(F.lit(count), c("n") * (c("n") - 1)))
    turns = placed.where("n > 1").withColumn("t", F.explode(F.sequence(F.lit(0), F.floor((c("h_end") - 1) / c("n")))))
    step = 1 + F.pmod(c("t"), c("n") - 1)
    side = lambda place, name: F.struct((place + c("t") * c("n")).alias("h"), F.lit(name).alias("side"))
    sides = turns.select(*by, "x", "y", "u", "v", "h_end", F.explode(F.array(side(c("i"), 1), side(F.pmod(c("i") - step, c("n")), 2))).alias("s")).where("s.h < h_end")
    ends = sides.groupBy(*by, c("s.h").alias("h")).agg(*[F.max(F.when(c("s.side") == k, c(name))).alias(f"{name}{k}") for k in (1, 2) for name in "xyuv"])
    dx, dy, du, dv = (c(f"{name}2") - c(f"{name}1") for name in "xyuv")
    d = dx * dx + dy * dy
    maps = ends.withColumn("a", F.try_divide(dx * du + dy * dv, d)).withColumn("b", F.try_divide(dx * dv - dy * du, d)).where("a is not null and b is not null")
    return maps.select(*by, "h", "a", "b", (c("u1") - c("a") * c("x1") + c("b") * c("y1")).alias("tx"), (c("v1") - c("b") * c("x1") - c("a") * c("y1")).alias("ty"))


def robust_affine(points: DataFrame, *by: str, threshold: float = 5.0, count: int = 256, pool: int = 256, seed: int = 7) -> DataFrame:
    """(by, n, inliers, guess, a, b, tx, ty): the rotation, scale and shift of (x, y) to (u, v) that most points of a group agree with.

    points: (by, id, x, y, u, v), ids unique in their group; rows with a null place are left out. Of seeded two-point maps (see
    hypotheses) the one with most points within the threshold wins, the first of equals; guess is that map (h, a, b, tx, ty), the
    rest its least-squares fit over those points. A group of fewer than two points, or of one place only, has no row.

    A group's maps are one row, which its points meet; their votes are summed before they are shuffled, so a large group is
    `count` rows a task.
    """
    c = F.col
    keys = list(by)
    points = points.dropna(subset=[*keys, "x", "y", "u", "v"])
    maps = hypotheses(points, keys, count, pool, seed).groupBy(*keys).agg(F.collect_list(F.struct("h", "a", "b", "tx", "ty")).alias("maps"))
    votes = points.join(maps, keys).select(*keys, "x", "y", "u", "v", F.explode("maps").alias("guess"))
    votes = votes.groupBy(*keys, "guess").agg(F.count_if(_off("guess") <= threshold * threshold).alias("inliers"), F.count("*").alias("n"))
    best = votes.groupBy(*keys).agg(F.max_by(F.struct("guess", "n", "inliers"), F.struct("inliers", -c("guess.h"))).alias("g")).select(*keys, "g.n", "g.inliers", "g.guess")
    best = written(best, "maps")
    fit = affine_fit(points.join(best, keys).where(_off("guess") <= threshold * threshold), *keys)
    return best.join(fit.drop("n"), keys).select(*keys, "n", "inliers", "guess", "a", "b", "tx", "ty")


def _off(of: str) -> Column:
    """The squared distance of (u, v) from (x, y) by the map in the struct."""
    c = F.col
    a, b = c(f"{of}.a"), c(f"{of}.b")
    x, y = a * c("x") - b * c("y") + c(f"{of}.tx") - c("u"), b * c("x") + a * c("y") + c(f"{of}.ty") - c("v")
    return x * x + y * y


def inliers(points: DataFrame, maps: DataFrame, *by: str, threshold: float = 5.0) -> DataFrame:
    """The points that agree with the guess of their group's map (see robust_affine), with their error under the fitted map."""
    fitted = similarity(*(F.col(f"fit.{k}") for k in ("a", "b", "tx", "ty")))
    held = points.join(maps.select(*by, "guess", F.struct("a", "b", "tx", "ty").alias("fit")), list(by)).where(_off("guess") <= threshold * threshold)
    return held.withColumn("error", reprojection_error(fitted, *map(F.col, "xyuv"))).drop("guess", "fit")


def one_to_one(edges: DataFrame, by: str) -> DataFrame:
    """The edges (by, q, g, cost, ...) that taking them from the least cost on keeps, where an edge goes once its q or its g is taken.

    Ties go to the lower q, then g; costs that are null or nan are left out, of repeated (q, g) the cheaper stays. Rounds do the
    same as the one long pass: an edge that is the least at both its ends is taken, with all edges there decided. Each round is
    written, and is over the edges that are still open; a round decides the least edge of each connected part at least, half of
    all or more when costs fall at random. Points are dealt by group and point, so a large group isn't one task.
    """
    c = F.col
    order = F.struct("cost", "q", "g")
    at_q, at_g = W.partitionBy(by, "q"), W.partitionBy(by, "g")
    cheapest = F.row_number().over(W.partitionBy(by, "q", "g").orderBy("cost"))
    now = written(edges.where(c("cost").isNotNull() & ~F.isnan("cost") & c(by).isNotNull() & c("q").isNotNull() & c("g").isNotNull()).withColumn("_k", cheapest).where("_k = 1").drop("_k"), "edges")
    taken = now.limit(0)
    while now.limit(1).count():
        least = now.withColumn("_q", F.min(order).over(at_q) == order).withColumn("_took", F.col("_q") & (F.min(order).over(at_g) == order))
        gone = F.max("_took").over(at_g)
        decided = written(least.withColumn("_gone", gone).withColumn("_gone", c("_gone") | F.max("_took").over(at_q)).where("_took or not _gone"), "edges")
        taken = taken.unionByName(decided.where("_took").select(*edges.columns))
        now = decided.where("not _took").select(*edges.columns)
    return taken


def pair_summary(candidates: DataFrame, maps: DataFrame, kept: DataFrame, by: str, scale: tuple[float, float] = (0.75, 1.35), turn: float = 15.0, bin_degrees: int = 10) -> DataFrame:
    """A row for each group of candidates (by, ..., angle): counts, the map's rotation and scale, and how far its matches agree.

    kept: one-to-one matches with error and angle. consistency: the share of them whose angle is within `turn` of the fullest
    bin of their angles. A group without a map, or whose scale is out of range, has success false and zeros.
    """
    c = F.col
    m = similarity(c("a"), c("b"), c("tx"), c("ty"))
    counts = candidates.groupBy(by).agg(F.count("*").alias("candidates"))
    mapped = maps.select(by, "inliers", rotation_degrees(m).alias("rotation"), scale_of(m).alias("scale"))
    main = dominant_angle(kept, by, c("angle"), bin_degrees).select(by, c("angle").alias("main"))
    ends = kept.join(main, by).groupBy(by).agg(F.count("*").alias("matches"), F.avg("error").alias("mean_error"), F.max("main").alias("main_angle"), F.avg(F.when(F.abs(wrap_angle(c("angle") - c("main"))) <= turn, 1.0).otherwise(0.0)).alias("consistency"))
    got = counts.join(mapped, by, "left").join(ends, by, "left").withColumn("success", scale_in_range(c("scale"), *scale))
    zero = lambda name: F.when(c("success"), F.coalesce(c(name), F.lit(0))).otherwise(0).alias(name)
    return got.select(by, "candidates", "success", *[zero(k) for k in ("inliers", "matches")], *[zero(k).cast("double").alias(k) for k in ("rotation", "scale", "mean_error", "main_angle", "consistency")])
