"""Images of a folder tree as a table of paths, identities and ids; no image is opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def identity_of(stem: Column, depth: int) -> Column:
    """The first depth folders of a relative path without extension; all folders for depth 0 or less; unknown_finger for none."""
    folders = F.slice(F.split(stem, "/"), 1, F.size(F.split(stem, "/")) - 1)
    used = F.slice(folders, 1, depth) if depth > 0 else folders
    return F.when(F.size(used) > 0, F.array_join(used, "/")).otherwise("unknown_finger")


def image_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("png", "bmp", "jpg", "jpeg", "tif", "tiff")) -> DataFrame:
    """(path, rel, stem, ext) of each file below root with one of these extensions; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    mark = "/" + root.rstrip("/").split("://")[-1].lstrip("/") + "/"
    rel = F.expr("substring(path, locate('{0}', path) + {1})".format(mark.replace("'", "\\'"), len(mark)))
    found = files.withColumn("rel", rel).withColumn("ext", F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1))).withColumn("stem", F.regexp_replace("rel", r"\.[^./]+$", ""))
    return found.where(F.col("ext").isin(*extensions)).select("path", "rel", "stem", "ext")


def sample_index(files: DataFrame, extensions: tuple[str, ...], depth: int = 1) -> DataFrame:
    """One file of each stem, of the extension that comes first in extensions: (finger_id, image_id, stem, path)."""
    priority = F.array_position(F.lit(list(extensions)), F.col("ext"))
    best = files.groupBy("stem").agg(F.min_by("path", F.struct(priority, "path")).alias("path"))
    return best.select(identity_of(F.col("stem"), depth).alias("finger_id"), F.element_at(F.split("stem", "/"), -1).alias("image_id"), "stem", "path")


def strict_images(files: DataFrame) -> DataFrame:
    """(identity_id, image_id, path) of files that all lie at identity/file; an error names how many don't, or says that there are none."""
    parts = F.split("rel", "/")
    n, bad = files.agg(F.count("*"), F.count_if(F.size(parts) != 2)).head()
    if not n or bad:
        raise ValueError(f"{bad} of {n} images are not at <identity>/<file>" if n else "no image found")
    stems = files.select(parts[0].alias("identity_id"), F.element_at(F.split("stem", "/"), -1).alias("stem"), "rel", "path")
    return unique_image_ids(stems).select("identity_id", "image_id", "path")


def unique_image_ids(rows: DataFrame) -> DataFrame:
    """rows (identity_id, stem, rel, ...) and image_id: the stem, with a hash of rel where an identity has the stem twice."""
    twice = rows.groupBy("identity_id", "stem").agg((F.count("*") > 1).alias("twice")).where("twice")
    marked = rows.join(twice, ["identity_id", "stem"], "left")
    return marked.withColumn("image_id", F.when(F.col("twice"), F.concat("stem", F.lit("__"), F.substring(F.sha1("rel"), 1, 10))).otherwise(F.col("stem"))).drop("twice")


def with_enough(rows: DataFrame, least: int, by: str = "identity_id") -> DataFrame:
    """The rows of identities with at least so many rows."""
    return rows.join(rows.groupBy(by).count().where(F.col("count") >= least).select(by), by, "left_semi")


def limited(rows: DataFrame, identities: int, images: int) -> DataFrame:
    """For a trial run: the first images (by image_id) of each of the first identities (by name)."""
    first = rows.select("identity_id").distinct().orderBy("identity_id").limit(identities)
    rank = F.row_number().over(W.partitionBy("identity_id").orderBy("image_id"))
    return rows.join(F.broadcast(first), "identity_id", "left_semi").withColumn("rank", rank).where(F.col("rank") <= images).drop("rank")  # identities rows
