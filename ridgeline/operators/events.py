"""Ordered events: timing summaries, running bests, and keyed libraries with least-recently-used eviction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def timing_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count, least, mean, nearest-rank p50 and p95, and most of each group. Nearest rank: the sorted place round((n - 1) q), half
    to even. Places are counted over distinct values, which a running sum orders."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(by).orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(W.partitionBy(by)))
    at = lambda q: F.min(F.when(F.col("upto") > F.bround((F.col("n") - 1) * q), F.col("v")))
    return placed.groupBy(by).agg(F.sum("c").alias("n"), F.min("v").alias("least"), F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 6).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("v").alias("most"))


def best_so_far(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """rows and best: the largest value up to each row; is_best where the row reaches it (the latest tie wins)."""
    upto = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("best", F.max(value).over(upto)).withColumn("is_best", F.col(value) >= F.col("best"))


def weighted_mean(rows: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """sum(value * weight) / sum(weight) of each group, 0 without weight."""
    return rows.groupBy(by).agg(F.round(F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)), F.lit(0.0)), 6).alias("mean"))


def library_contents(touches: DataFrame, owner: str, item: str, order: list[str], size: int) -> DataFrame:
    """(owner, item, position): what an LRU library of so many items holds after all touches, the latest first.

    The library after a touch holds the last size distinct items, so one grouping finds it, without state or order of rows.
    """
    last = touches.groupBy(owner, item).agg(F.max(F.struct(*order)).alias("last"))
    return last.withColumn("position", F.row_number().over(W.partitionBy(owner).orderBy(F.desc("last")))).where(F.col("position") <= size).select(owner, item, "position")


def early_stop(rows: DataFrame, least: float = 0.0, patience: int = 5) -> DataFrame:
    """rows (run, step, score) with reference, stale and stopped: an improvement is a score above reference * (1 + least), which then
    becomes the reference and sets stale to 0; else stale counts up. The first score is the first reference. From stale =
    patience on (0: never) a run has stopped: its later rows are left out.

    Each row needs the state before it. A run's rows stream through one task in the order of step, which holds three numbers.
    Rows with a null or nan are left out; steps are unique in their run.
    """
    clean = rows.select("run", "step", F.col("score").cast("double").alias("score")).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reference, stale, over = None, 0.0, 0, False
        for b in batches:
            keep, refs, counts, ends = [], [], [], []
            for k, (name, score) in enumerate(zip(b.column("run").to_pylist(), b.column("score").to_pylist(), strict=True)):
                if name != now:
                    now, reference, stale, over = name, score, 0, False
                elif over:
                    continue
                elif score > reference * (1 + least):
                    reference, stale = score, 0
                else:
                    stale += 1
                over = 0 < patience <= stale
                for c, v in zip((keep, refs, counts, ends), (k, reference, stale, over), strict=True):
                    c.append(v)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("run", "step", "score")), pa.array(refs, pa.float64()), pa.array(counts, pa.int64()), pa.array(ends, pa.bool_())], ["run", "step", "score", "reference", "stale", "stopped"])

    kinds = ", ".join(f"{c} {t}" for c, t in clean.dtypes)
    return clean.repartition("run").sortWithinPartitions("run", "step").mapInArrow(run, f"{kinds}, reference double, stale long, stopped boolean")
