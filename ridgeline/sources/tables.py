"""Tables of a folder of parquet files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(id, owner, v) of the embeddings: the identity is the label, values are doubles."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("owner"), F.col("embedding").cast("array<double>").alias("v"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir; a local one only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="ridgeline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str, clean_up: bool = False) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here. clean_up: the write's own shuffle files go at its end."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, was = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(key, None)
    try:
        if clean_up:
            spark.conf.set(key, "true")
        df.write.parquet(path)
    finally:
        if clean_up:
            spark.conf.unset(key) if was is None else spark.conf.set(key, was)
    return spark.read.schema(df.schema).parquet(path)
