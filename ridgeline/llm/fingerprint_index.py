"""Repeated word passages, found batch by batch with a log-structured index of window fingerprints."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import anchors
from ridgeline.llm.anchors import FIRST, REPEATED, SHARED, UNSURE
from ridgeline.llm.common import settings, shared_dir, staged, utf8

WINDOW, GRAM = 20, 8
COLUMNS = ["kind", "ah", "sh", "key", "lo", "n", "pkey", "plo"]


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class LogIndex:
    """Immutable runs of the fingerprints of all batches so far: one run per batch, or several compacted.

    A run is a table in the folder that all machines share, bucketed by anchor and sorted by anchor and segment hash, with a row
    for each distinct segment that its batches had first, and where it starts. All runs have the same buckets, a file each,
    so a new batch is written as a run once and merge-joined with the others bucket by bucket, in the order they are stored
    in: no run is shuffled or sorted again. save and open carry the index from one job to the next.
    """

    #: With these, reads keep the order of a bucket's file, and grouping by it keeps it too.
    ORDERED = {"ordered": "true", "sort_agg": "true", "all_keys": "false"}

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, most_runs: int = 2, ranges: int | None = None):
        self.spark, self.window, self.gram, self.most_runs = spark, window, gram, most_runs
        self.ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.base = f"ridgeline_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {self.base} LOCATION '{shared_dir(spark)}/{self.base}'")
        self.runs: list[str] = []
        self.compactions = 0

    def absorb(self, docs: DataFrame) -> DataFrame:
        """What the fingerprints tell of the next batch of docs (distinct key, text), whose keys are above all before: REPEATED
        rows, whose segment is in the batch before, or in a run, at plo in pkey, and UNSURE ones, whose windows must be
        compared, among them those of earlier batches that share an anchor with the batch's."""
        run = self._written(anchors.judged(anchors.anchored(docs, word_hashes, self.window, self.gram), firsts=True, ranges=self.ranges))
        new = self.spark.table(run)
        found = staged(self.met(new).unionByName(new.where(F.col("kind") == REPEATED).select(*COLUMNS)), "found", **self.ORDERED)
        if self.runs:
            shared = staged(found.where(F.col("kind") == UNSURE).select("ah").distinct(), "shared")
            for old in self.runs:
                rows = self._firsts(old).join(shared.hint("merge"), "ah", "left_semi").withColumn("kind", F.lit(UNSURE)).select(*COLUMNS)
                found = found.unionByName(staged(rows, "found", **self.ORDERED))
        self.runs.append(run)
        if len(self.runs) > self.most_runs:
            self.compact()
        return found

    def met(self, new: DataFrame) -> DataFrame:
        """The first segments of a run that are in an earlier one, or share an anchor; to be planned with ORDERED."""
        firsts, known, seen = new.where(F.col("kind").isin(FIRST, SHARED)), [], [F.col("kind") == SHARED]
        for i, old in enumerate(self.runs):
            old = self._firsts(old)
            firsts = firsts.join(old.select("ah", "sh", F.struct("key", "lo").alias(f"at{i}")).hint("merge"), ["ah", "sh"], "left")
            known.append(F.col(f"at{i}"))
        for i, old in enumerate(self.runs):  # after the others: rows stay in the order of both keys until here
            firsts = firsts.join(self._firsts(old).select("ah").distinct().withColumn(f"seen{i}", F.lit(True)).hint("merge"), "ah", "left")
            seen.append(F.col(f"seen{i}").isNotNull())
        met = firsts.withColumn("at", F.coalesce(*known) if known else F.lit(None).cast("struct<key:bigint,lo:int>"))
        unsure = seen[0]
        for x in seen[1:]:
            unsure = unsure | x
        met = met.where(F.col("at").isNotNull() | unsure).withColumn("kind", F.when(F.col("at").isNotNull(), REPEATED).otherwise(UNSURE))
        return met.withColumn("pkey", F.coalesce("at.key", "pkey")).withColumn("plo", F.coalesce("at.lo", "plo")).select(*COLUMNS)

    def _firsts(self, run: str) -> DataFrame:
        return self.spark.table(run).where(F.col("kind").isin(FIRST, SHARED))

    def _written(self, rows: DataFrame) -> str:
        name = f"{self.base}.run_{uuid.uuid4().hex}"
        with settings(self.spark, clean_up="true"):
            rows.select(*COLUMNS).write.format("parquet").bucketBy(self.ranges, "ah").sortBy("ah", "sh").saveAsTable(name)
        return name

    def compact(self) -> None:
        """One sorted run instead of all, with the earliest place of each segment; the old ones are dropped."""
        whole = self._firsts(self.runs[0])
        for run in self.runs[1:]:
            whole = whole.unionByName(self._firsts(run))
        least = F.min(F.struct("key", "lo", "n")).alias("at")
        rows = whole.repartition(self.ranges, "ah").groupBy("ah", "sh").agg(least).select(F.lit(FIRST).alias("kind"), "ah", "sh", "at.*", F.lit(0).cast("long").alias("pkey"), F.lit(-1).alias("plo"))
        run = self._written(rows)
        self._forget()
        self.runs = [run]
        self.compactions += 1

    def _forget(self) -> None:
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self.runs = []

    def drop(self) -> None:
        """Deletes the runs and their folder."""
        self._forget()
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.base} CASCADE")

    def save(self, path: str) -> None:
        """Writes what open needs: the runs' folders and the parameters."""
        rows = [(self.spark.sql(f"DESCRIBE TABLE EXTENDED {run}").where("col_name = 'Location'").head()["data_type"], self.ranges, self.window, self.gram, self.most_runs, i) for i, run in enumerate(self.runs)]
        self.spark.createDataFrame(rows, "location string, ranges int, window int, gram int, most_runs int, at int").coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LogIndex:
        """The index that save wrote, in this or another session; its runs are read where they lie."""
        rows = spark.read.schema("location string, ranges int, window int, gram int, most_runs int, at int").json(path).orderBy("at").collect()
        index = cls(spark, rows[0]["window"], rows[0]["gram"], rows[0]["most_runs"], rows[0]["ranges"])
        for r in rows:
            name = f"{index.base}.run_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {name} ({anchors.FOUND}) USING parquet CLUSTERED BY (ah) SORTED BY (ah, sh) INTO {index.ranges} BUCKETS LOCATION '{r['location']}'")
            index.runs.append(name)
        return index


def spans(texts: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """Spans (key, a, b, proof) of words, from what an index tells; texts: (distinct key, text) of all batches it tells of.

    Windows of UNSURE segments are compared one by one, dealt by two hashes of their words. All repeats carry the earlier
    words as proof, against which the words are compared before they go.
    """
    unsure = found.where(F.col("kind") == UNSURE).select("key", "lo", "n").distinct()
    windows = staged(anchors.judged(anchors.single_windows(texts, unsure, word_hashes, window)).where(F.col("kind") == REPEATED), "windows")
    return anchors.proven(texts, found.where(F.col("kind") == REPEATED).unionByName(windows), window, bytes.split, b" ".join)


def cut(docs: DataFrame, spans_: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of each row of docs (key, doc_id, text) without these spans."""

    def rows_of(batch, texts, cut_):
        cols: list[list] = [[], [], [], []]
        for words, spans_ in zip(texts, cut_, strict=True):
            kept, at = [], 0
            for a, b in spans_:
                kept += words[at:a]
                at = b
            kept += words[at:]
            joined = b" ".join(kept)
            for c, v in zip(cols, (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()), strict=True):
                c.append(v)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return anchors.remaining(docs, spans_, bytes.split, b" ".join, rows_of, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string", ["doc_id"])


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = 4, most_runs: int = 2) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of each row of docs (doc_id, text).

    A word is removed if a window of so many words that covers it also starts earlier: in a smaller doc_id, or earlier in
    the same document. Batches of ascending doc_id meet the index one after another; windows are those of the input. kept:
    the other words, joined by one space. Null and short texts lose nothing. Rows alike in doc_id and text are one document
    and get equal results; rows of one doc_id but different texts count as one after another; a null doc_id comes first.
    No rows give no rows.
    """
    keyed, texts = anchors.document_keys(docs.select(F.col("doc_id").cast("long"), utf8().alias("text")))
    edges = texts.agg(F.percentile_approx("key", [i / batches for i in range(1, batches)])).head()[0] or []
    edges = [None, *sorted(set(edges)), None]
    index, found = LogIndex(docs.sparkSession, window, gram, most_runs), None
    try:
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            got = index.absorb(texts.where(F.lit(True) if a is None else F.col("key") > a).where(F.lit(True) if b is None else F.col("key") <= b))
            found = got if found is None else found.unionByName(got)
    finally:
        index.drop()
    return cut(keyed, spans(texts, found, window))
