"""Connected groups of points by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.sources.tables import written


def point_groups(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node reachable. Nulls link nothing."""
    now = written(links.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "groups")
    nodes, mark = now.select(F.explode(F.array("a", "b")).alias("node")).distinct(), None
    star = lambda side, least: side.join(least, "a")
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = star(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = star(large, large.groupBy("a").agg(F.min("b").alias("m"))).select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        now = written(small.where("a != b").distinct(), "groups")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
        if seen == mark:
            break
        mark = seen
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
