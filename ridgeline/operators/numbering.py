"""Dense numbers of rows in an order, without ordering all of them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.sources.tables import written


def dense_numbers(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place in the order, from 0 without gaps. Rows that are equal in it are numbered one after another.

    Rows are dealt by ranges of the order and numbered within each; a range starts where those before it end, so only the
    ranges' sizes come together, a row for each. No rows give no rows.
    """
    parts = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    firsts = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_within", within).join(F.broadcast(firsts), "_part").withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")  # a row for each shuffle partition


def first_appearance(rows: DataFrame, key: list[str], order: str, name: str) -> DataFrame:
    """(key, first, name) of each distinct key: its least order, and its number by that, from 0. Null keys are keys of their own;
    keys of one least order are numbered by themselves."""
    firsts = rows.groupBy(*key).agg(F.min(order).alias("first")).where("first is not null")
    return dense_numbers(firsts, ["first", *key], name)


def running_sums(rows: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """rows, each of a place of its own in the order, with upto_<name> for each of sums: the sum of the column up to and with the row;
    all_<name>: its sum over all rows. Ranges of the order are summed within, and carried over as one row for each range."""
    c = F.col
    parts = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("_part").agg(*[F.sum(x).alias(f"_{x}") for x in sums])
    upto, every = W.orderBy("_part"), W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    carried = totals.select("_part", *[(F.sum(f"_{x}").over(upto) - c(f"_{x}")).alias(f"_before_{x}") for x in sums], *[F.sum(f"_{x}").over(every).alias(f"all_{x}") for x in sums])
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    got = parts
    for x in sums:
        got = got.withColumn(f"_upto_{x}", F.sum(x).over(within))
    got = got.join(F.broadcast(carried), "_part")  # a row for each shuffle partition
    return got.select(*[f"`{x}`" for x in rows.columns], *[(c(f"_before_{x}") + c(f"_upto_{x}")).alias(f"upto_{x}") for x in sums], *[f"all_{x}" for x in sums])
