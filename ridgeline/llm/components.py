"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each linked node but the roots; root is the smallest node of the component.

    links: two long columns a and b. Each round joins every node to the smallest of its neighbours, first among the
    larger nodes, then among the smaller ones; the number of rounds grows with the logarithm of a component's size.
    Each round is written to the shared folder. Nulls and a = b link nothing; repeated links count once; no links
    give no rows.
    """
    now = staged(links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = staged(small.where("a != b").distinct(), "links")
        was, mark = mark, _mark(now)
        if mark == was:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
