"""Image pairs, group-disjoint splits, affine fits, dominant angles, greedy selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.functions.scalars import angle_diff, wrap_angle
from ridgeline.sources.tables import written


def image_pairs(images: DataFrame, cap: int) -> DataFrame:
    """(owner, a, b): the first cap unordered pairs of each owner's ids, in the order of (a, b).

    A pair's number follows from the ranks of its ids, so each id states its own partners' ranks and only the pairs asked for
    are made: at most cap rows for each owner. The first cap + 1 ids of an owner make them all, and only these are shuffled.
    """
    by = W.partitionBy("owner")
    first = images.select("owner", "id", F.row_number().over(by.orderBy("id")).alias("i")).where(F.col("i") <= cap + 1)
    ranked = first.withColumn("n", F.count("*").over(by))
    before = (F.col("i") - 1) * F.col("n") - F.col("i") * (F.col("i") - 1) / 2
    last = F.least(F.col("n"), F.col("i") + cap - before).cast("int")
    left = ranked.where(F.col("i") < last).select("owner", F.col("id").alias("a"), F.explode(F.sequence(F.col("i") + 1, last)).alias("i"))
    return left.join(ranked.select("owner", F.col("id").alias("b"), "i"), ["owner", "i"]).select("owner", "a", "b")


def group_split(groups: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """(owner, split) of each distinct owner: hashed order, cut at half-even rounded shares, so no owner is in two splits.

    Of three owners or more, an empty split gets the last owner of the largest split that has two or more. The order is
    found within hash ranges, not in one task; the counts of the 256 ranges are read at once. Null owners are left out.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("owner").cast("string")))
    rows = written(groups.select("owner").where("owner is not null").distinct().withColumn("key", key).withColumn("part", F.substring("key", 1, 2)), "owners")
    counts = sorted(rows.groupBy("part").count().collect())
    before, n = [], 0
    for part, count in counts:
        before.append((part, n))
        n += count
    parts = groups.sparkSession.createDataFrame(before, "part string, before long")
    at = rows.join(F.broadcast(parts), "part").withColumn("at", F.row_number().over(W.partitionBy("part").orderBy("key", "owner")) + F.col("before"))  # 256 rows
    runs, lent = split_runs(n, ratios)
    split = F.lit("test")
    for name, (lo, hi) in runs.items():
        split = F.when((F.col("at") > lo) & (F.col("at") <= hi), name).otherwise(split)
    for place, name in lent.items():
        split = F.when(F.col("at") == place, name).otherwise(split)
    return at.select("owner", split.alias("split"))


def split_runs(n: int, ratios: tuple[float, float, float]) -> tuple[dict[str, list[int]], dict[int, str]]:
    """(before, last) of each split's run of the places 1 to n, and the places that an empty split got from the largest."""
    total = sum(ratios)
    first, second = round(n * ratios[0] / total), round(n * (ratios[0] + ratios[1]) / total)
    runs, lent = {"train": [0, first], "val": [first, second], "test": [second, n]}, {}
    for name, (lo, hi) in runs.items():
        largest = max(runs.values(), key=lambda r: r[1] - r[0])
        if n >= 3 and lo == hi and largest[1] - largest[0] > 1:
            lent[largest[1]] = name
            largest[1] -= 1
    return runs, lent


def affine_fit(points: DataFrame, *by: str) -> DataFrame:
    """The least-squares rotation, scale and shift of (x, y) to (u, v) for each group: u = ax - by + tx, v = bx + ay + ty.

    Centred moments in one grouping, so far-off coordinates lose no digits; a group whose points are all equal gets nulls.
    """
    c, cov = F.col, F.covar_pop
    sums = points.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(k).alias(f"m{k}") for k in "xyuv"], (F.var_pop("x") + F.var_pop("y")).alias("d"), (cov("x", "u") + cov("y", "v")).alias("p"), (cov("x", "v") - cov("y", "u")).alias("q"))
    got = sums.withColumn("a", F.try_divide("p", "d")).withColumn("b", F.try_divide("q", "d"))
    return got.select(*by, "n", "a", "b", (c("mu") - c("a") * c("mx") + c("b") * c("my")).alias("tx"), (c("mv") - c("b") * c("mx") - c("a") * c("my")).alias("ty"))


def dominant_angle(rows: DataFrame, by: str, angle: Column, bin_degrees: int = 10) -> DataFrame:
    """(by, angle, votes): the centre of the fullest bin of wrapped angles, the first of equals."""
    bins = rows.select(by, F.least(F.floor((wrap_angle(angle) + 180) / bin_degrees), F.lit(360 // bin_degrees - 1)).cast("int").alias("bin"))
    counts = bins.groupBy(by, "bin").agg(F.count("*").alias("votes"))
    top = counts.groupBy(by).agg(F.max_by(F.struct("bin", "votes"), F.struct("votes", -F.col("bin"))).alias("t"))
    return top.select(by, (F.col("t.bin") * bin_degrees - 180 + bin_degrees / 2).alias("angle"), "t.votes")


def ratio_matches(near: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Of (q, g, d, rank) rows, the best where it is below ratio times the second; without a second it passes."""
    second = F.coalesce(F.lead("d").over(W.partitionBy("q").orderBy("rank")), F.lit(float("inf")))
    return near.withColumn("second", second).where((F.col("rank") == 1) & (F.col("d") < ratio * F.col("second")) & (F.col("second") > 1e-12)).select("q", "g", "d")


def candidates(near: DataFrame, policy: str = "topk_or_ratio", top: int = 3, ratio: float = 0.8, most: float = 1.2, margin: float = 0.1) -> DataFrame:
    """(q, g, d) of (q, g, d, rank) rows, two ranks or more, that go on to verification.

    ratio_only: the best, if below ratio times the second and at most so far. topk_only: the first top within
    min(most, best + margin). topk_or_ratio: the best alone where the ratio holds, else as topk_only. Each gallery row
    is kept for its nearest query only, the first of equals.
    """
    if policy not in ("ratio_only", "topk_only", "topk_or_ratio"):
        raise ValueError(f"unknown policy {policy!r}")
    c, by = F.col, W.partitionBy("q")
    best, second = F.min(F.when(c("rank") == 1, c("d"))).over(by), F.coalesce(F.min(F.when(c("rank") == 2, c("d"))).over(by), F.lit(float("inf")))
    rows = near.withColumn("best", best).withColumn("second", second)
    alone = (c("second") > 1e-12) & (c("best") < ratio * c("second")) & (c("best") <= most)
    many = (c("rank") <= top) & (c("d") <= F.least(F.lit(most), c("best") + margin))
    kept = {"ratio_only": alone & (c("rank") == 1), "topk_only": many, "topk_or_ratio": F.when(alone, c("rank") == 1).otherwise(many)}[policy]
    return rows.where(kept).groupBy("g").agg(F.min_by("q", F.struct("d", "q")).alias("q"), F.min("d").alias("d")).select("q", "g", "d")


def _both_ways(firsts: DataFrame) -> DataFrame:
    """(q, g, d) of first neighbours (back, of, to, d) that are so both ways, met in one grouping."""
    pair = firsts.select(F.when(F.col("back"), F.col("to")).otherwise(F.col("of")).alias("q"), F.when(F.col("back"), F.col("of")).otherwise(F.col("to")).alias("g"), "d")
    return pair.groupBy("q", "g").agg(F.count("*").alias("n"), F.min("d").alias("d")).where("n = 2").select("q", "g", "d")


def mutual(near: DataFrame) -> DataFrame:
    """(q, g, d) of two-way neighbours (see blocks.nearest_both) that are each other's best."""
    return _both_ways(near.where("rank = 1"))


def two_way_ratio(near: DataFrame, ratio: float = 0.8) -> DataFrame:
    """(q, g, d) of two-way neighbours, two ranks or more, that are each other's best and pass the ratio test (see ratio_matches) both ways."""
    second = F.coalesce(F.lead("d").over(W.partitionBy("back", "of").orderBy("rank")), F.lit(float("inf")))
    return _both_ways(near.withColumn("second", second).where((F.col("rank") == 1) & (F.col("d") < ratio * F.col("second")) & (F.col("second") > 1e-12)))


def spaced(points: DataFrame, by: str, distance: float, sides: tuple[tuple[str, str], ...] = (("x", "y"),)) -> DataFrame:
    """(by, id): greedy thinning within each group by falling score (then id): a point stays unless, on any of its sides, it is
    closer than distance to one that stayed. Rows with a null are left out; ids are unique in their group.

    Cells of the distance over root 2 hold one staying point at most. In each round a point stays that is the best of those left
    in the 25 cells around it on every side, and what is close to it goes; the best point left always stays, so rounds end,
    after as many as the longest run of ever better neighbours. Points meet the best of cells and points that stay, never all
    others of a cell or group, and each round is written.
    """
    c, close = F.col, distance / 2**0.5
    rank = F.struct((-c("score")).alias("s"), "id")
    cells = {f"{s}{k}": F.floor(c(x) / close) for s, side in enumerate(sides) for k, x in enumerate(side)} if distance > 0 else {}
    flat = [x for side in sides for x in side]
    now = points.select(by, "id", "score", *flat).dropna()
    if distance <= 0:
        return now.select(by, "id")
    now = written(now.select(by, "id", rank.alias("rank"), *flat, *[v.alias(f"_c{k}") for k, v in cells.items()]), "points")
    stay = now.limit(0).select(by, "id")
    spread = F.sequence(F.lit(-2), F.lit(2))

    def around(df: DataFrame, s: int) -> DataFrame:
        for k in (0, 1):
            df = df.withColumn("_d", F.explode(spread)).withColumn(f"_c{s}{k}", c(f"_c{s}{k}") + c("_d")).drop("_d")
        return df

    while now.limit(1).count():
        best = now
        for s in range(len(sides)):
            at = [by, f"_c{s}0", f"_c{s}1"]
            least = around(now.groupBy(*at).agg(F.min("rank").alias("r")), s).groupBy(*at).agg(F.min("r").alias(f"_r{s}"))
            best = best.join(least, at).where(c("rank") == c(f"_r{s}")).drop(f"_r{s}")
        best = written(best.select(now.columns), "stay")
        stay, left = stay.unionByName(best.select(by, "id")), now
        for s, (x, y) in enumerate(sides):
            near = around(best.select(by, c(x).alias("_x"), c(y).alias("_y"), *[c(f"_c{s}{k}") for k in (0, 1)]), s).withColumnsRenamed({by: "_by", f"_c{s}0": "_k0", f"_c{s}1": "_k1"})
            met = (c(by) == c("_by")) & (c(f"_c{s}0") == c("_k0")) & (c(f"_c{s}1") == c("_k1")) & (F.hypot(c(x) - c("_x"), c(y) - c("_y")) < distance)
            left = left.join(near, met, "left_anti")
        now = written(left, "points")
    return stay


def nearby(left: DataFrame, right: DataFrame, by: str, radius: float, angle_limit: float) -> DataFrame:
    """(by, a, b, distance): for each point of left the best point of right within the radius, in the same group.

    Both: (by, id, x, y, angle), left already projected. Best: least distance plus radius times the angle's difference
    (mod 180) in units of angle_limit, 2 at most; then the lower id. Points meet in grid cells of the radius, each left
    point in the nine around it, so a large group is dealt by place. They meet twice: once for each point's least cost, a number
    that is hashed, and once for what has it, so pairs are never sorted. Null groups or places meet nothing.
    """
    c = F.col
    cell = [F.floor(c(k) / radius).alias(f"c{k}") for k in "xy"]
    around = left.select(by, c("id").alias("a"), c("x").alias("ax"), c("y").alias("ay"), c("angle").alias("aa"), *cell)
    for k in ("cx", "cy"):
        around = around.withColumn(k, F.explode(F.sequence(c(k) - 1, c(k) + 1)))
    cells = right.select(by, c("id").alias("b"), c("x").alias("bx"), c("y").alias("by_"), c("angle").alias("ba"), *cell)
    d, turn = F.hypot(c("bx") - c("ax"), c("by_") - c("ay")), angle_diff(c("ba"), c("aa"))
    cost = c("distance") + radius * F.least(F.least(turn, 180 - turn) / max(angle_limit, 1e-6), F.lit(2.0))
    met = lambda points: points.join(cells, [by, "cx", "cy"]).withColumn("distance", d).where(c("distance") <= radius).withColumn("cost", cost)
    least = met(around).groupBy(by, "a").agg(F.min("cost").alias("least"))
    best = met(around.join(least, [by, "a"])).where(c("cost") == c("least")).groupBy(by, "a").agg(F.min_by(F.struct("b", "distance"), F.struct("cost", "b")).alias("m"))
    return best.select(by, "a", "m.b", "m.distance")


def expanded(found: DataFrame, known: DataFrame, by: str) -> DataFrame:
    """The best of each point (see nearby) that isn't known as a pair already; a known one is not replaced by the next best."""
    return found.join(known, [by, "a", "b"], "left_anti")


def reserved_picks(rows: DataFrame, by: str, reserve: int, most: int) -> DataFrame:
    """(by, id, score, reserved, rank): at most `most` of each group by falling score, then id, but first the `reserve` best that are reserved.

    Only each group's first rows of either kind are shuffled, so a large group stays small.
    """
    order = [F.desc("score"), F.col("id")]
    some = rows.select(by, "id", "score", "reserved").withColumn("k", F.row_number().over(W.partitionBy(by, "reserved").orderBy(*order))).where(F.col("k") <= most)
    first = F.col("reserved") & (F.col("k") <= min(reserve, most))
    kept = some.withColumn("k", F.row_number().over(W.partitionBy(by).orderBy(F.desc(first), *order))).where(F.col("k") <= most)
    return kept.select(by, "id", "score", "reserved", F.row_number().over(W.partitionBy(by).orderBy(*order)).alias("rank"))
