"""What the operators share: staged tables, Arrow maps and sorted groups."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="ridgeline-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the writes within, put back afterwards."""
    names = {k: _NAMES[k] for k in values}
    was = {k: spark.conf.get(name, None) for k, name in names.items()}
    for k, name in names.items():
        spark.conf.set(name, values[k])
    try:
        yield
    finally:
        for k, name in names.items():
            if was[k] is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, was[k])


_NAMES = {
    "clean_up": "spark.sql.classic.shuffleDependency.fileCleanup.enabled",  # a write's own shuffle files, which nothing else reads
    "ordered": "spark.sql.legacy.bucketedTableScan.outputOrdering",  # whether a bucket of one sorted file is known to be sorted
    "sort_agg": "spark.sql.execution.replaceHashWithSortAgg",  # whether sorted rows are grouped in their order
    "all_keys": "spark.sql.requireAllClusterKeysForCoPartition",  # whether tables bucketed by one of two join keys are shuffled again
}


def staged(df: DataFrame, name: str, **more: str) -> DataFrame:
    """df written to the shared folder, with settings, and read again: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, clean_up="true", **more):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Whole texts reach Python in batches of this size at most (one longer text is a batch of its own), so a worker stays small.
BATCH_BYTES = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str = "text"):
    """A text column as its UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def sealed(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns needed and, as the struct row, all columns: no name of docs can clash with an operator's own."""
    return docs.select(*needed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """df.mapInArrow, a function of one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := rows(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Batches of rows sorted by keys, cut anew so that no group of equal keys is split. The rows of one group must fit in memory."""
    left: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        if left is not None:
            now = {n: np.concatenate([left[n], now[n]]) for n in now}
        same = np.ones(len(now[keys[0]]), bool)
        for k in keys:
            same &= now[k] == now[k][-1]
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield {n: v[:cut] for n, v in now.items()}
        left = {n: v[cut:] for n, v in now.items()}
    if left is not None:
        yield left


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any of these columns; the first row does."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) reduced to a star per component: each linked value but the smallest, and the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], least)
        np.minimum.at(new, root[y], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]
