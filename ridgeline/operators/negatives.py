"""Hard negatives within training batches, and the values of the losses over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.blocks import in_order, unit_distances
from ridgeline.operators.verification import distance_metrics


def hard_negatives(rows: DataFrame, top: int = 3, same_owner: bool = False, separation: float = 0.0) -> DataFrame:
    """(batch, anchor, positive_dist, negatives): each anchor's nearest legal negatives (d, direction, candidate), nearest first.

    rows: (batch, id, owner, point, frame, x, y, v, p), p the positive of v, both unit vectors. An anchor's candidates are the
    other rows' positives (direction 0) and, for its own positive, the other rows' anchors (direction 1). Rows of the same
    point are never legal, rows of the same owner only with same_owner, and then only where their frames differ or their
    places are separation or more apart in x or y. Ties go by direction, then id; both directions often tie, so
    products are summed value by value and not in a matrix product's own order. A batch is one unit of work: its size is
    the trainer's batch size, and only the chosen negatives leave it. An anchor without any has an empty list.
    """

    def chosen(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, owner, point, frame, x, y = (t[c].to_numpy() for c in ("id", "owner", "point", "frame", "x", "y"))
        v, p = (np.stack(t[c].to_numpy()) for c in ("v", "p"))
        d = unit_distances(in_order(v, p))
        illegal = point[:, None] == point[None, :]
        same = owner[:, None] == owner[None, :]
        if not same_owner:
            illegal |= same
        else:
            gap = np.maximum(np.abs(x[:, None] - x[None, :]), np.abs(y[:, None] - y[None, :]))
            illegal |= same & (frame[:, None] == frame[None, :]) & (gap < separation)
        both = np.concatenate([np.where(illegal, np.inf, d), np.where(illegal, np.inf, d.T)], axis=1)
        order = np.argsort(both, axis=1, kind="stable")[:, :top]
        n = len(ids)
        found = [[{"d": float(both[i, j]), "direction": int(j >= n), "candidate": int(ids[j % n])} for j in order[i] if np.isfinite(both[i, j])] for i in range(n)]
        kind = pa.list_(pa.struct([("d", pa.float64()), ("direction", pa.int32()), ("candidate", pa.int64())]))
        return pa.table({"batch": t["batch"], "anchor": t["id"], "positive_dist": np.diag(d), "negatives": pa.array(found, kind)})

    known = rows.select("batch", "id", "owner", "point", "frame", F.col("x").cast("double"), F.col("y").cast("double"), "v", "p").dropna()
    return known.groupBy("batch").applyInArrow(chosen, "batch long, anchor long, positive_dist double, negatives array<struct<d:double,direction:int,candidate:long>>")


def triplet_loss(found: DataFrame, margin: float = 1.0, top1_weight: float = 0.6, p95_target: float = 0.5, p99_target: float = 0.7, tail_weight: float = 0.5) -> DataFrame:
    """Per batch: the weighted hinge over chosen negatives and a squared hinge on the positives' high quantiles.

    The nearest negative weighs top1_weight, the others share the rest; a lone negative weighs 1. Anchors without negatives
    are skipped and counted. The quantiles interpolate and weigh the same.
    """
    c, n = F.col, F.size("negatives")
    hinge = F.transform("negatives", lambda x: F.greatest(F.lit(0.0), margin + c("positive_dist") - x["d"]))
    total = F.aggregate("h", F.lit(0.0), lambda a, x: a + x)
    value = F.when(n > 1, c("h")[0] * top1_weight + (total - c("h")[0]) * (1 - top1_weight) / (n - 1)).otherwise(F.get("h", F.lit(0)))
    mean = F.aggregate("negatives", F.lit(0.0), lambda a, x: a + x["d"]) / n
    valid = found.withColumn("h", hinge).withColumn("ok", n > 0).withColumn("value", F.when(c("ok"), value)).withColumn("neg", F.when(c("ok"), mean)).withColumn("pos", F.when(c("ok"), c("positive_dist")))
    got = valid.groupBy("batch").agg(F.count_if("ok").alias("anchors"), F.count_if(~c("ok")).alias("skipped"), F.avg("value").alias("ranking"), F.avg("neg").alias("neg_mean"), F.avg("pos").alias("pos_mean"), F.percentile("pos", 0.95).alias("p95"), F.percentile("pos", 0.99).alias("p99"))
    tail = lambda q, target: F.pow(F.greatest(F.lit(0.0), c(q) - target), 2)
    got = got.withColumn("tail", tail_weight * (tail("p95", p95_target) + tail("p99", p99_target)) / 2)
    return got.select("batch", "anchors", "skipped", *[F.round(x, 6).alias(x) for x in ("ranking", "neg_mean", "pos_mean", "p95", "p99", "tail")], F.round(c("ranking") + c("tail"), 6).alias("loss"))


def validation_summary(found: DataFrame, top: int = 3, margin: float = 1.0) -> DataFrame:
    """One row over all batches of found (see hard_negatives, with all legal negatives of each anchor): what the whole pool of
    distances tells (see distance_metrics), and the margin loss over each anchor's nearest `top` alone.

    Anchors without negatives are skipped and counted; their positives count nowhere. loss: the mean over anchors of their mean
    hinge; active_triplet_ratio: the share of anchors with a hinge above 0. Without any valid anchor the query fails.
    """
    c = F.col
    valid = found.where(F.size("negatives") > 0)
    pool = valid.select(F.inline(F.concat(F.array(F.struct(c("positive_dist").alias("d"), F.lit(True).alias("positive"))), F.transform("negatives", lambda x: F.struct(x["d"].alias("d"), F.lit(False).alias("positive"))))))
    hinges = F.transform(F.slice("negatives", 1, top), lambda x: F.greatest(F.lit(0.0), margin + c("positive_dist") - x["d"]))
    mean = F.aggregate("h", F.lit(0.0), lambda a, x: a + x) / F.size("h")
    ok, size = c("n") > 0, F.size("negatives")
    rows = found.select("batch", size.alias("n"), hinges.alias("h"))
    counts = rows.agg(
        F.countDistinct("batch").alias("batches"), F.count_if(ok).alias("valid_anchor_count"), F.count_if(~ok).alias("skipped_anchor_count"),
        F.avg(F.when(ok, mean)).alias("loss"), F.avg(F.when(ok, F.exists("h", lambda x: x > 0).cast("int"))).alias("active_triplet_ratio"),
    )
    checked = F.when(c("valid_anchor_count") > 0, c("valid_anchor_count")).otherwise(F.raise_error(F.lit("every anchor has zero legal negatives in its batch")).cast("long"))
    counts = counts.withColumn("valid_anchor_count", checked).withColumn("valid_anchor_ratio", F.try_divide(c("valid_anchor_count"), c("valid_anchor_count") + c("skipped_anchor_count")))
    return counts.crossJoin(distance_metrics(pool, positive_at=(0.95, 0.99)))  # one row each
