"""Several tables written as one version: readers see all of a version or none of it."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, name string, path string, rows long"


def publish(tables: dict[str, DataFrame], folder: str) -> int:
    """Write the tables into folder as its next version, and the manifest that lists them last; returns the version.

    Each table goes to a path of its own. The manifest is one file, which Spark moves into place when it is whole: until then
    readers have the version before, and a job that fails leaves paths that nobody lists. Of two jobs that publish at the same
    time both are listed under one number; the later by name is read, whole.
    """
    if not tables:
        raise ValueError("there are no tables to publish")
    spark = next(iter(tables.values())).sparkSession
    listed = []
    for name, df in tables.items():
        path = f"{folder}/tables/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        listed.append((name, path, spark.read.parquet(path).count()))
    before = _manifest(spark, folder)
    version = 1 + ((before.agg(F.max("version")).head()[0] or 0) if before is not None else 0)
    one = spark.createDataFrame([(version, *x) for x in listed], MANIFEST)
    one.coalesce(1).write.parquet(f"{folder}/manifests/at={version:012}-{uuid.uuid4().hex}")
    return version


def _manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST + ", at string").option("basePath", f"{folder}/manifests").parquet(f"{folder}/manifests/at=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def published(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the last version, or of the one asked for; empty if there is none."""
    listed = _manifest(spark, folder)
    if listed is None:
        return {}
    rows = listed if version is None else listed.where(F.col("version") == version)
    last = rows.agg(F.max("at")).head()[0]
    return {r["name"]: spark.read.parquet(r["path"]) for r in rows.where(F.col("at") == last).collect()}  # a row a table
