"""Loss values of binary descriptors by batch, from Gram matrices that partitions sum up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEIGHTS = {"teacher_similarity": 0.5, "positive_consistency": 0.1, "quantization": 0.1, "balance": 0.02, "decorrelation": 0.02}


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def gram_sums(rows: DataFrame, bits: int, teacher: int) -> DataFrame:
    """(batch, k, s): sums over each batch's rows (batch, anchor, positive, anchor_teacher, positive_teacher), number by number.

    The numbers of a batch, one after another: how many descriptors; sums of x; of x'x; of u'u, u't and t't for rows u and t of
    unit length; of (u.u - t.t)^2; of |(1 - |x|)|^2; of anchor . positive. A task adds up what it has of a batch before it is
    shuffled, so a batch of any size is one row of numbers a task. Rows with a null are left out.
    """
    n = 1 + bits + bits * bits + bits * bits + bits * teacher + teacher * teacher + 3

    def run(batches):
        held: dict[int, np.ndarray] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.list_(pa.float64()))], ["batch", "sums"])

        for b in batches:
            if not b.num_rows:
                continue
            batch = b.column("batch").to_numpy()
            sides = [b.column(c).flatten().to_numpy().reshape(b.num_rows, -1) for c in ("anchor", "positive", "anchor_teacher", "positive_teacher")]
            for k in np.unique(batch).tolist():
                anchor, positive, *teachers = (m[batch == k] for m in sides)
                x, t = np.concatenate([anchor, positive]), _unit(np.concatenate(teachers))
                u = _unit(x)
                diagonal = (((u * u).sum(1) - (t * t).sum(1)) ** 2).sum()
                s = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel(), (u.T @ u).ravel(), (u.T @ t).ravel(), (t.T @ t).ravel(), [diagonal, ((1 - np.abs(x)) ** 2).sum(), (anchor * positive).sum()]])
                held[k] = held[k] + s if k in held else s
            if len(held) * n > 1 << 22:
                yield out()
                held = {}
        if held:
            yield out()

    sums = rows.dropna().mapInArrow(run, "batch long, sums array<double>")
    return sums.select("batch", F.posexplode("sums").alias("k", "s")).groupBy("batch", "k").agg(F.sum("s").alias("s"))


def binary_losses(rows: DataFrame, bits: int, teacher: int, weights: dict[str, float] | None = None) -> DataFrame:
    """(batch, n, teacher_similarity, positive_consistency, quantization, balance, decorrelation, loss) of each batch of rows (see
    gram_sums): continuous bits of an anchor and its positive, and the teacher's descriptors of both.

    teacher_similarity: the mean squared difference of bits' and teachers' cosines over all pairs of different descriptors,
    which the squared norms of u'u, u't and t't give without any pair. decorrelation: the mean squared covariance of
    different bits. balance: the mean squared mean of bits. loss: their sum by weights (fixed values by default).
    """
    weights = WEIGHTS if weights is None else weights
    if any(w < 0 for w in weights.values()) or not any(weights.values()):
        raise ValueError("weights must not be negative, and one of them must count")
    c, k = F.col, F.col("k")
    at, spans = 0, {}
    for name, size in (("n", 1), ("x", bits), ("xx", bits * bits), ("uu", bits * bits), ("ut", bits * teacher), ("tt", teacher * teacher), ("diagonal", 1), ("off", 1), ("agree", 1)):
        spans[name] = (at, at + size)
        at += size
    within = lambda name: (k >= spans[name][0]) & (k < spans[name][1])
    sums = gram_sums(rows, bits, teacher)
    one = {name: F.max(F.when(within(name), c("s"))).alias(name) for name in ("n", "diagonal", "off", "agree")}
    squares = {name: F.sum(F.when(within(name), c("s") * c("s"))).alias(name) for name in ("x", "uu", "ut", "tt")}
    i, j = F.floor((k - spans["xx"][0]) / bits), F.pmod(k - spans["xx"][0], F.lit(bits))
    means = sums.where(within("x")).select("batch", (k - spans["x"][0]).alias("bit"), c("s").alias("sum"))
    cells = sums.where(within("xx")).select("batch", i.alias("i"), j.alias("j"), "s").where("i != j")
    n = sums.where(within("n")).select("batch", c("s").alias("n"))
    spread = cells.join(means.select("batch", c("bit").alias("i"), c("sum").alias("si")), ["batch", "i"]).join(means.select("batch", c("bit").alias("j"), c("sum").alias("sj")), ["batch", "j"]).join(n, "batch")
    covariance = F.try_divide(c("s") - c("si") * c("sj") / c("n"), c("n") - 1)
    apart = spread.groupBy("batch").agg((F.sum(covariance * covariance) / max(bits * (bits - 1), 1)).alias("decorrelation"))
    got = sums.groupBy("batch").agg(*one.values(), *squares.values()).join(apart, "batch", "left")
    parts = {
        "teacher_similarity": F.coalesce(F.try_divide(c("uu") - 2 * c("ut") + c("tt") - c("diagonal"), c("n") * (c("n") - 1)), F.lit(0.0)),
        "positive_consistency": 0.5 * (1 - 2 * c("agree") / (c("n") * bits)),
        "quantization": c("off") / (c("n") * bits),
        "balance": c("x") / (c("n") * c("n") * bits),
        "decorrelation": F.coalesce(c("decorrelation"), F.lit(0.0)),
    }
    got = got.select("batch", c("n").cast("long").alias("n"), *[v.alias(name) for name, v in parts.items()])
    return got.withColumn("loss", sum((c(name) * w for name, w in weights.items()), F.lit(0.0)))
