"""Enrolment, verification scores and the rates that follow from them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.operators.blocks import BLOCK, each, identity_scores, parts_met, unit_distances
from ridgeline.operators.numbering import running_sums
from ridgeline.sources.tables import written


def enrolled(vectors: DataFrame, count: int = 5, strategy: str = "first") -> DataFrame:
    """vectors (id, owner, v) and whether each is enrolled: the first of its owner by id, every step-th, or by a seeded hash."""
    by = W.partitionBy("owner")
    rank = F.row_number().over(by.orderBy("id"))
    if strategy == "first":
        return vectors.withColumn("enrolled", rank <= count)
    if strategy == "random":
        return vectors.withColumn("enrolled", F.row_number().over(by.orderBy(F.md5(F.concat(F.lit("7|"), F.col("id").cast("string"))), "id")) <= count)
    if strategy != "stride":
        raise ValueError(f"unknown strategy {strategy!r}")
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(by) / count))
    return vectors.withColumn("enrolled", ((rank - 1) % step == 0) & ((rank - 1) / step < count))


def scores(vectors: DataFrame, count: int = 5) -> DataFrame:
    """Every vector that isn't enrolled against every identity; genuine says that the identity is its own."""
    rows = enrolled(vectors, count)
    got = identity_scores(rows.where("not enrolled"), rows.where("enrolled"))
    return got.withColumn("genuine", F.col("q_owner") == F.col("owner"))


def cumulative(found: DataFrame) -> DataFrame:
    """(score, g, i, far_n, frr_n, impostors, genuines) for each distinct score as threshold: the genuine and impostor rows of that
    score, accepted impostors, rejected genuines, and all of either. Scores are taken as they are and counted first; counts are
    summed up within ranges of scores and carried over these, so that no task orders all of them."""
    c = F.col
    by = found.groupBy(c("best").alias("score")).agg(F.count_if("genuine").alias("g"), F.count_if(~c("genuine")).alias("i"))
    at = running_sums(by, ["score"], ["g", "i"])
    return at.select("score", "g", "i", (c("all_i") - c("upto_i") + c("i")).alias("far_n"), (c("upto_g") - c("g")).alias("frr_n"), c("all_i").alias("impostors"), c("all_g").alias("genuines"))


def threshold_rates(found: DataFrame, configured: tuple[float, ...] = (), auto: tuple[float, float, float] | None = None) -> DataFrame:
    """(threshold, fa, fr, far, frr) at each configured threshold (0, 0.5 and 1 without any), each of an even grid (low, high, step), and
    each finite score, all to ten decimals, from 0 to 1, once. Scores are counted, and counts summed up to each threshold within
    ranges of both, so scores and thresholds aren't joined."""
    c = F.col
    grid = [auto[0] + k * auto[2] for k in range(round((auto[1] - auto[0]) / auto[2]) + 1)] if auto else []
    counts = found.where("best is not null and not isnan(best) and abs(best) < double('inf')").groupBy(c("best").alias("at")).agg(F.count_if("genuine").alias("g"), F.count_if(~c("genuine")).alias("i"))
    fixed = found.sparkSession.createDataFrame([(float(x),) for x in (*(configured or (0.0, 0.5, 1.0)), *grid)], "at double")
    marks = fixed.unionByName(counts.select("at")).select(F.round("at", 10).alias("at")).where("at between 0 and 1").distinct()
    both = counts.withColumn("kind", F.lit(1)).unionByName(marks.select("at", F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("i"), F.lit(0).alias("kind")))
    at = running_sums(both, ["at", "kind"], ["g", "i"]).where("kind = 0")  # a threshold comes before the scores that reach it
    got = at.select(c("at").alias("threshold"), (c("all_i") - c("upto_i")).alias("fa"), c("upto_g").alias("fr"), "all_i", "all_g")
    return got.select("threshold", "fa", "fr", F.try_divide("fa", "all_i").alias("far"), F.try_divide("fr", "all_g").alias("frr"))


def rates(n: str, of: str, name: str):
    """n / of to six decimals; null where of is 0."""
    return F.round(F.try_divide(F.col(n), F.col(of)), 6).alias(name)


def far_frr_table(found: DataFrame, low: float = 0.5, high: float = 0.85, step: float = 0.01) -> DataFrame:
    """FAR and FRR at each threshold of a grid, by counting scores into its cells: one pass, no join of scores and thresholds."""
    n = round((high - low) / step)
    cell = F.least(F.greatest(F.floor(F.round((F.col("best") - low) / step, 6)), F.lit(-1)), F.lit(n)).cast("int")
    counts = found.groupBy(cell.alias("cell")).agg(F.count_if("genuine").alias("g"), F.count_if(~F.col("genuine")).alias("i"))
    grid = found.sparkSession.range(-1, n + 1).select(F.col("id").cast("int").alias("cell"))
    all_ = grid.join(counts, "cell", "left").fillna(0)
    up, down = W.orderBy("cell").rowsBetween(0, W.unboundedFollowing), W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(1))
    got = all_.select("cell", F.sum("i").over(up).alias("fa"), F.coalesce(F.sum("g").over(down), F.lit(0)).alias("fr"), F.sum("i").over(every).alias("impostors"), F.sum("g").over(every).alias("genuines"))
    return got.where("cell >= 0").select(F.round(F.lit(low) + F.col("cell") * step, 10).alias("threshold"), "fa", "fr", rates("fa", "impostors", "far"), rates("fr", "genuines", "frr"))


def zero_far_point(found: DataFrame) -> DataFrame:
    """The rates just above the largest impostor score; threshold_above is that score, null (FAR too) without impostors."""
    top = found.agg(F.max(F.when(~F.col("genuine"), F.col("best"))).alias("threshold_above"))
    got = found.crossJoin(F.broadcast(top))  # one row
    return got.agg(F.first("threshold_above").alias("threshold_above"), F.count_if(F.col("genuine") & (F.col("best") <= F.coalesce("threshold_above", F.lit(-1.0)))).alias("fr"), F.count_if("genuine").alias("genuines"), F.count_if(~F.col("genuine")).alias("impostors")).select(
        "threshold_above", "fr", rates("fr", "genuines", "frr"), F.when(F.col("impostors") > 0, 0.0).alias("far")
    )


def per_owner_rates(found: DataFrame, threshold: float) -> DataFrame:
    """Rates over all rows and by identity at one threshold, as grouping sets."""
    got = found.rollup("owner").agg(F.grouping("owner").cast("int").alias("overall"), F.count_if(F.col("genuine") & (F.col("best") < threshold)).alias("fr"), F.count_if(~F.col("genuine") & (F.col("best") >= threshold)).alias("fa"), F.count_if("genuine").alias("genuines"), F.count_if(~F.col("genuine")).alias("impostors"))
    return got.select("overall", "owner", "fr", "fa", rates("fr", "genuines", "frr"), rates("fa", "impostors", "far"))


def auc_eer(found: DataFrame) -> DataFrame:
    """Area under the tie-collapsed ROC by trapezoids, and the equal error rate at the vertex where FAR and FRR are nearest."""
    c, share = F.col, lambda n, of: F.try_divide(n, F.col(of))
    at = cumulative(found).select("score", share(c("far_n"), "impostors").alias("fpr"), (1 - share(c("frr_n"), "genuines")).alias("tpr"), share(c("far_n") - c("i"), "impostors").alias("f0"), (1 - share(c("frr_n") + c("g"), "genuines")).alias("t0"))
    gap = F.abs(F.col("fpr") - (1 - F.col("tpr")))
    return at.agg(F.round(F.sum((F.col("fpr") - F.col("f0")) * (F.col("tpr") + F.col("t0")) / 2), 6).alias("auc"), F.round(F.min_by((F.col("fpr") + 1 - F.col("tpr")) / 2, F.struct(F.round(gap, 9), -F.col("score"))), 6).alias("eer"))


def distance_metrics(rows: DataFrame, digits: int | None = None, positive_at: tuple[float, ...] = ()) -> DataFrame:
    """One row of what distances (d, positive) tell: means, low percentiles of the negative ones, FPR where TPR first reaches
    0.95 (1 if never), the greatest TPR with FPR of 1e-4 or less, the area under the ROC, the interpolated equal error rate; and
    pos_pNN, the percentiles of the positive ones that are asked for.

    Distances that are null or not finite are left out, as are null kinds; the rest is taken as it is, or to so many digits.
    Distances are counted first, and the counts summed up within ranges and carried over these, so that no task orders all of
    them. Without a kind, its rates are null.
    """
    c = F.col
    d = c("d") if digits is None else F.round("d", digits)
    counts = rows.where("positive is not null and not isnan(d) and abs(d) < double('inf')").groupBy(d.alias("d")).agg(F.count_if("positive").alias("p"), F.count_if(~c("positive")).alias("n"))
    return _counted_metrics(counts, positive_at)


def _counted_metrics(counts: DataFrame, positive_at: tuple[float, ...]) -> DataFrame:
    """See distance_metrics; counts: (d, p, n), the positive and negative rows of each distance."""
    c = F.col
    at = running_sums(counts, ["d"], ["p", "n"])
    rate = lambda x, of: F.try_divide(x, c(f"all_{of}"))
    roc = at.select("d", "p", "n", "upto_n", "all_n", "upto_p", "all_p", rate(c("upto_n"), "n").alias("fpr"), rate(c("upto_p"), "p").alias("tpr"), rate(c("upto_n") - c("n"), "n").alias("f0"), rate(c("upto_p") - c("p"), "p").alias("t0"))
    gap, gap0 = F.round(c("fpr") + c("tpr") - 1, 12), F.round(c("f0") + c("t0") - 1, 12)
    w = F.when(gap == gap0, 0.0).otherwise(-gap0 / (gap - gap0))
    crossing = (c("f0") + w * (c("fpr") - c("f0")) + 1 - c("t0") - w * (c("tpr") - c("t0"))) / 2
    value = lambda of, k: F.min(F.when((c(f"all_{of}") > 0) & (c(f"upto_{of}") > k), c("d")))
    low = {}
    for of, name, at_ in (("n", "neg", (0.01, 0.05)), ("p", "pos", positive_at)):
        for q in at_:
            spot = (c(f"all_{of}") - 1) * q
            low[f"{name}_p{round(q * 100):02}"] = (value(of, F.floor(spot)), value(of, F.ceil(spot)), F.max(spot - F.floor(spot)))
    got = roc.agg(
        F.try_divide(F.sum(c("d") * c("p")), F.sum("p")).alias("pos_mean"), F.try_divide(F.sum(c("d") * c("n")), F.sum("n")).alias("neg_mean"), *[(a + (b - a) * f).alias(name) for name, (a, b, f) in low.items()],
        F.coalesce(F.min(F.when(c("tpr") >= 0.95, c("fpr"))), F.when(F.sum("p") > 0, 1.0)).alias("fpr_at_tpr95"), F.coalesce(F.max(F.when(c("fpr") <= 1e-4, c("tpr"))), F.when(F.sum("n") > 0, 0.0)).alias("tpr_at_fpr_1e_4"),
        F.sum((c("fpr") - c("f0")) * (c("tpr") + c("t0")) / 2).alias("roc_auc"), F.min_by(crossing, F.when(gap >= 0, c("d"))).alias("eer"),
    )
    return got.select("pos_mean", "neg_mean", *low, "fpr_at_tpr95", "tpr_at_fpr_1e_4", "roc_auc", "eer")


def _pools(held, asked):
    """The distances of each block of rows asked for to each block of those held (see blocks.parts_met): of one owner, and of two."""
    ids, owners, v = (x[np.argsort(held[1], kind="stable")] for x in held)
    for block in asked:
        q, own, x = (y[np.argsort(block[1], kind="stable")] for y in block)
        edge = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own)).tolist() if len(own) else [0]
        for lo in range(0, len(ids), BLOCK):
            here, theirs = ids[lo : lo + BLOCK], owners[lo : lo + BLOCK]
            d = unit_distances(x @ v[lo : lo + BLOCK].T)
            itself = np.flatnonzero(np.isin(q, here))
            for i in itself:
                d[i, here == q[i]] = np.nan
            sides: tuple[list, list] = ([np.empty(0)], [np.empty(0)])
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                left, right = np.searchsorted(theirs, own[a], "left"), np.searchsorted(theirs, own[a], "right")
                sides[0].append(d[a:b, left:right].ravel())
                sides[1].extend((d[a:b, :left].ravel(), d[a:b, right:].ravel()))
            p, n = (np.concatenate(x) for x in sides)
            if len(itself) or not np.isfinite(d.sum()):
                p, n = p[np.isfinite(p)], n[np.isfinite(n)]
            yield p, n


def _fine_area(queries: DataFrame, gallery: DataFrame, p: np.ndarray, n: np.ndarray, fine: int) -> tuple[float, float]:
    """How many pairs of a positive and a negative distance have the positive one first, and how many share a cell besides, of those that
    share one of the even cells, which hold p and n distances. These are cut into about so many finer ones, the more the more such
    pairs they have. A task counts its distances in all finer cells; its counts are summed up a stretch of cells at a time."""
    cells, width = len(p), 1 << 14
    weight = np.sqrt(p.astype(float) * n)
    parts = np.ceil(weight * (fine / weight.sum())).astype(np.int64)  # 0 where nothing is to be told apart
    first, total = np.cumsum(parts) - parts, int(parts.sum())

    def counted(held, asked):
        found = [np.zeros(-(-total // width) * width, np.int32) for _ in range(2)]
        for pools in _pools(held, asked):
            for count, d in zip(found, pools, strict=True):
                x = d * (cells / 2)
                c = np.minimum(x.astype(np.int64), cells - 1)
                m = parts[c]
                at = first[c] + np.clip(((x - c) * m).astype(np.int64), 0, np.maximum(m - 1, 0))
                np.add.at(count, at[m > 0], np.int32(1))
        both = [x.reshape(-1, width) for x in found]
        for k in np.flatnonzero((both[0] | both[1]).any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k]), *(pa.ListArray.from_arrays(pa.array([0, width], pa.int32()), pa.array(x[k])) for x in both)], ["stretch", "p", "n"])

    def summed(t: pa.Table) -> pa.Table:
        pos, neg = (t[x].combine_chunks().flatten().to_numpy().reshape(-1, width).sum(0, dtype=np.int64).astype(float) for x in ("p", "n"))
        return pa.table({"stretch": t["stretch"][:1], "p": [pos.sum()], "n": [neg.sum()], "before": [float(neg @ (np.cumsum(pos) - pos))], "level": [float(pos @ neg)]})

    got = parts_met(queries, gallery, counted, "stretch long, p array<int>, n array<int>").groupBy("stretch").applyInArrow(summed, "stretch long, p double, n double, before double, level double").toPandas().sort_values("stretch")
    pos, neg = got["p"].to_numpy(), got["n"].to_numpy()
    held = np.where(parts > 0, p, 0).astype(float)
    across = float(np.where(parts > 0, n, 0) @ (np.cumsum(held) - held))  # of different even cells, which the caller knows
    return float(got["before"].sum() + neg @ (np.cumsum(pos) - pos)) - across, float(got["level"].sum())


def pooled_metrics(queries: DataFrame, gallery: DataFrame, positive_at: tuple[float, ...] = (), cell_rows: int = 1 << 18, at_once: int | None = None, digits: int | None = None, fine: int = 1 << 22) -> DataFrame:
    """distance_metrics of the distances (see blocks.nearest) of all queries to all other gallery rows, positive within an owner.

    The pairs are never held at once. One pass counts and sums them in even cells of distance, at most 65,536, so it is known in which
    cells the percentiles and rates lie. Only these cells give each distance with its counts; any other stands for all of its rows.
    The area under the ROC needs the order within each cell: rounds of cells with at_once pairs (by default more with more rows)
    compute their distances again and order a cell at a time. Blocks pass on equal distances once.

    digits: the area is asked for to so many decimals only. Then, where one round would not do, distances are counted again in finer
    cells (about `fine`; four and sixteen times as many, these in four passes, if they tell more), and nothing is ordered if the area has
    the same decimals wherever the distances of a cell lie in it. Else it is ordered as above, so the decimals are right either way.
    """
    c, spark = F.col, queries.sparkSession
    size = queries.count() * gallery.count()
    cells = 1 << min(16, max(4, (size // cell_rows).bit_length() + 3))  # distances fill a part of them
    at_once = at_once or max(1 << 27, size // max(1, queries.count()) << 11)
    cell = lambda d: np.minimum((d * (cells / 2)).astype(np.int64), cells - 1)

    def pools(q, g, d):
        known = np.isfinite(d) & (q[0][:, None] != g[0][None, :])
        same = q[1][:, None] == g[1][None, :]
        return d[known & same], d[known & ~same]

    def counted(held, asked):
        found, sums = np.zeros((2, cells), np.int64), np.zeros((2, cells))
        for both in _pools(held, asked):
            for k, x in enumerate(both):
                c = cell(x)
                found[k] += np.bincount(c, minlength=cells)
                if k or len(x):
                    sums[k] += np.bincount(c, x, cells)
        at = np.flatnonzero(found.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x[at]) for x in (*found, *sums))], ["cell", "p", "n", "sum_p", "sum_n"])

    table = parts_met(queries, gallery, counted, "cell long, p long, n long, sum_p double, sum_n double").groupBy("cell").agg(*[F.sum(x).alias(x) for x in ("p", "n", "sum_p", "sum_n")]).toPandas()
    p, n = (np.bincount(table["cell"], table[x], cells).astype(np.int64) for x in "pn")
    upto_p, upto_n = np.cumsum(p), np.cumsum(n)
    all_p, all_n = int(upto_p[-1]), int(upto_n[-1])
    spots = set()  # the cells that hold what is asked for
    for upto, total, shares in ((upto_n, all_n, (0.01, 0.05)), (upto_p, all_p, positive_at)):
        for k in (f((total - 1) * x) for x in shares for f in (math.floor, math.ceil)):
            spots.add(int(np.searchsorted(upto, k, "right")))
    if all_p:
        spots.add(int(np.argmax(upto_p / all_p >= 0.95)))
    if all_n:
        spots.add(int(np.argmax(upto_n / all_n > 1e-4)))
    if all_p and all_n:
        spots.add(int(np.argmax(np.round(upto_n / all_n + upto_p / all_p - 1, 12) >= 0)))
    exact = np.isin(np.arange(cells), list(spots)) & (p + n > 0)
    means = {f"{of}_mean": F.lit(float(table[f"sum_{of[0]}"].sum() / total) if total else None).cast("double") for of, total in (("pos", all_p), ("neg", all_n))}
    rest = [((k + 0.5) * 2 / cells, int(p[k]), int(n[k])) for k in np.flatnonzero((p + n > 0) & ~exact).tolist()]
    counts = spark.createDataFrame(rest, "d double, p long, n long")

    def settled() -> float | None:
        """The area, if its decimals are certain from counts."""
        unit, apart = 10.0**digits, float(n.astype(float) @ (upto_p - p).astype(float))
        share = np.cumsum(np.sqrt(p.astype(float) * n))
        for times, passes in ((1, 1), (4, 1), (16, 4)):
            of = np.minimum((share / max(share[-1], 1) * passes).astype(int), passes - 1)
            some = [np.where(of == k, (p, n), 0) for k in range(passes)]
            more, level = np.sum([_fine_area(queries, gallery, *x, fine * times // passes) for x in some if (x.min(0) > 0).any()] or [(0.0, 0.0)], axis=0)
            low, high = (x / all_p / all_n for x in (apart + more, apart + more + level))
            if math.floor((low - 1e-9) * unit + 0.5) == math.floor((high + 1e-9) * unit + 0.5):
                return (low + high) / 2
            middle = (low + high) / 2 * unit
            if abs(middle - math.floor(middle) - 0.5) < (high - low) * unit / 64:  # still in doubt with cells 16 times as fine
                return None
        return None

    def of_spots(held, asked):
        for both in _pools(held, asked):
            for k, x in enumerate(both):
                d, times = np.unique(x[exact[cell(x)]], return_counts=True)
                if len(d):
                    none = np.zeros(len(d), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(none if k else times), pa.array(times if k else none)], ["d", "p", "n"])

    known = settled() if digits is not None and all_p and all_n and size > at_once else None  # one round orders as fast as these count
    if known is not None:
        some = parts_met(queries, gallery, of_spots, "d double, p long, n long").groupBy("d").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        return _counted_metrics(counts.unionByName(some), positive_at).withColumns({**means, "roc_auc": F.lit(known)})
    wanted = exact | ((p > 0) & (n > 0))
    held = np.where(wanted, p + n, 0)
    turn = np.where(wanted, (np.cumsum(held) - held) // at_once, -1)

    def dealt(now):
        def found(q, g, d):
            for positive, x in zip((True, False), pools(q, g, d), strict=True):
                x = np.sort(x[turn[cell(x)] == now])
                first = np.flatnonzero(np.diff(x, prepend=-1.0))
                x, times = x[first], np.diff(np.append(first, len(x)))
                of = cell(x)
                starts = np.flatnonzero(np.diff(of, prepend=-1))
                ends = pa.array(np.append(starts, len(x)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (x, times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(of[starts]), pa.array(np.full(len(starts), positive)), *lists], ["cell", "positive", "d", "times"])

        return each(queries, gallery, "id", found, "cell long, positive boolean, d array<double>, times array<int>")

    def ordered(t: pa.Table) -> pa.Table:
        sides = []
        for positive in (True, False):
            side = t.filter(pc.equal(t["positive"], positive))
            d, times = (side[x].combine_chunks().flatten().to_numpy().astype(k) for x, k in (("d", float), ("times", np.int64)))
            order = np.argsort(d)
            sides.append((d[order], times[order]))
        (dp, tp), (dn, tn) = sides
        before = np.append(0, np.cumsum(tp))
        wins = int(((before[np.searchsorted(dp, dn, "left")] + before[np.searchsorted(dp, dn, "right")]) * tn).sum())  # twice the positives below, and those level
        values = np.unique(np.concatenate([dp, dn])) if exact[t["cell"][0].as_py()] else np.array([np.nan])
        ends = [np.diff(np.append(0, np.append(0, np.cumsum(k))[np.searchsorted(d, values, "right")])) for d, k in sides]
        return pa.table({"wins": pa.array([float(wins), *[0.0] * (len(values) - 1)]), "d": values, "p": ends[0], "n": ends[1]})

    done = None
    for now in range(int(turn.max()) + 1):
        some = written(dealt(now).groupBy("cell").applyInArrow(ordered, "wins double, d double, p long, n long"), "ordered", clean_up=True)
        done = some if done is None else done.unionByName(some)
    if done is None:
        return _counted_metrics(counts, positive_at)
    wins = done.agg(F.sum("wins")).first()[0] / 2 + float(n.astype(float) @ (upto_p - p).astype(float))
    got = _counted_metrics(counts.unionByName(done.where("not isnan(d)").select("d", "p", "n")), positive_at)
    area = F.lit(wins / all_p / all_n if all_p and all_n else None).cast("double")
    return got.withColumns({**means, "roc_auc": area})


def kinds(rows: DataFrame, by: str, measures: list) -> DataFrame:
    """The measures of genuine and of impostor rows (by: a boolean), a row for each, zeros where a kind has none."""
    spine = rows.sparkSession.createDataFrame([(True,), (False,)], f"{by} boolean")
    return spine.join(rows.groupBy(by).agg(*measures), by, "left").fillna(0)


def score_summary(rows: DataFrame, threshold: float) -> DataFrame:
    """(genuine, count, texture_evaluated, texture_available, fused_score_count, mean_*, *_accept, decision_changed) of attempts
    (genuine, score, geometry, texture, evaluated, available, decision): both kinds always. Nulls count as 0, false or another decision."""
    number = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    score, geometry = number("score") >= threshold, number("geometry") >= threshold
    flags = {"texture_evaluated": F.col("evaluated"), "texture_available": F.col("available"), "fused_score_count": F.col("decision") == "fused_score", "match_score_accept": score, "geometry_only_accept": geometry, "decision_changed": score != geometry}
    measures = [F.count("*").alias("count"), *[F.count_if(v).alias(k) for k, v in flags.items()], *[F.avg(number(k)).alias(f"mean_{k}") for k in ("score", "geometry", "texture")]]
    return kinds(rows.withColumn("genuine", F.coalesce("genuine", F.lit(False))), "genuine", measures)


def identity_fusion(templates: DataFrame, stop: float | None = None, counts: tuple[str, ...] = (), most: tuple[str, ...] = ()) -> DataFrame:
    """A row for each query and identity of its templates' results (q, owner, pos, template, score, quality, ...), scanned in the order of pos.

    stop: the scan ends with the first template that reaches it; later ones don't count. best_score, mean_score, top_mean (of the
    three best), best_template and best_pos (by score, then quality, then the first), templates scanned, stopped, and of the
    columns named the count of rows above 0 (with_<name>) and the most (max_<name>). Nulls count as 0. Where the scan ends is
    found and left by before rows meet, so what is shuffled again is what was scanned.
    """
    c = F.col
    number = lambda name: F.coalesce(c(name).cast("double"), F.lit(0.0))
    rows = templates.withColumn("score", number("score")).withColumn("quality", number("quality"))
    if stop is not None:
        ends = F.min(F.when(c("score") >= stop, c("pos"))).over(W.partitionBy("q", "owner"))
        rows = rows.withColumn("_end", ends).where("_end is null or pos <= _end")
    item = F.struct("score", "quality", (-c("pos")).alias("p"), "template")
    top = F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 3)  # of one identity's templates, as many as it may enrol
    got = rows.groupBy("q", "owner").agg(
        F.max(item).alias("b"), F.avg("score").alias("mean_score"), F.aggregate(top, F.lit(0.0), lambda a, x: a + x).alias("_top"), F.count("*").alias("templates"),
        *[F.count_if(number(k) > 0).alias(f"with_{k}") for k in counts], *[F.max(number(k)).alias(f"max_{k}") for k in most],
    )
    stopped = F.lit(False) if stop is None else c("b.score") >= stop
    return got.select("q", "owner", c("b.score").alias("best_score"), "mean_score", (c("_top") / F.least(c("templates"), F.lit(3))).alias("top_mean"), c("b.template").alias("best_template"), (-c("b.p")).alias("best_pos"), "templates", stopped.alias("stopped"), *[f"with_{k}" for k in counts], *[f"max_{k}" for k in most])


def failures(found: DataFrame, threshold: float, cap: int) -> DataFrame:
    """The cap worst false rejects and false accepts, by falling score, then query and owner."""
    kind = F.when(F.col("genuine") & (F.col("best") < threshold), "false_reject").when(~F.col("genuine") & (F.col("best") >= threshold), "false_accept")
    bad = found.withColumn("kind", kind).where("kind is not null")
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("best"), "q", "owner"))
    return bad.withColumn("rank", rank).where(F.col("rank") <= cap).select("kind", "rank", "q", "owner", "best")


def extreme_cases(rows: DataFrame, top: int, bottom: int, least: int = 3) -> DataFrame:
    """(side, rank, q_owner, q, inliers, score, quality): the top cases by unique inliers, then score, quality, owner and query, and the
    bottom ones the other way round, of those with `least` unique inliers or more. Only so many rows of a task are ordered again."""
    order = ["inliers", "score", "quality", "q_owner", "q"]
    some = rows.select(*order)
    best = some.orderBy(*[F.desc(c) for c in order]).limit(max(0, top)).withColumn("side", F.lit("top")).withColumn("rank", F.row_number().over(W.orderBy(*[F.desc(c) for c in order])))
    worst = some.where(F.col("inliers") >= max(0, least)).orderBy(*order).limit(max(0, bottom)).withColumn("side", F.lit("bottom")).withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return best.unionByName(worst).select("side", "rank", "q_owner", "q", "inliers", "score", "quality")


def nearest_candidates(rows: DataFrame, by: str, most: int) -> DataFrame:
    """Each group's `most` candidates of least d, ties by q, then g; all of them if most is 0 or less."""
    if most <= 0:
        return rows
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy("d", "q", "g"))).where(F.col("_k") <= most).drop("_k")
