"""CSV in and out: text columns, checked pair tables, rounded numbers, guarded appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.scalars import significant, tolerant_double

PAIR_COLUMNS = ("finger_id", "image_pair_id", "image_a_id", "image_b_id", "x_a", "y_a", "x_b", "y_b")


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns as texts; a byte order mark is no part of the first name."""
    df = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8", multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def checked_pairs(rows: DataFrame) -> DataFrame:
    """Pair rows with coordinates as doubles; an error if a column is missing, an image id is empty or a coordinate isn't finite."""
    if missing := [c for c in PAIR_COLUMNS if c not in rows.columns]:
        raise ValueError(f"missing columns: {missing}")
    xy = PAIR_COLUMNS[-4:]
    typed = rows.withColumns({c: tolerant_double(F.col(c)) for c in xy})
    empty = F.greatest(*[(F.coalesce(F.trim(c), F.lit("")) == "").cast("int") for c in ("image_a_id", "image_b_id")]) == 1
    infinite = F.greatest(*[F.coalesce((F.isnan(c) | (F.abs(c) == float("inf"))).cast("int"), F.lit(1)) for c in xy]) == 1
    bad = typed.agg(F.count_if(empty).alias("ids"), F.count_if(infinite).alias("places")).head()
    if bad["ids"] or bad["places"]:
        raise ValueError(f"{bad['ids']} rows without image ids, {bad['places']} without finite places")
    return typed


def write_csv(rows: DataFrame, path: str, digits: int = 4) -> None:
    """Rows as CSV with a header; doubles to so many significant digits."""
    shown = [significant(F.col(f"`{n}`"), digits).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in rows.dtypes]
    rows.select(*shown).write.csv(path, header=True)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Rows appended to a parquet table of the same columns and types; any other schema is an error."""
    spark = rows.sparkSession
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there) and spark.read.parquet(path).dtypes != rows.dtypes:
        raise ValueError("the table has other columns")
    rows.write.mode("append").parquet(path)
