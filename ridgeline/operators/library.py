"""Template libraries that learn: admission, LRU eviction, the log of decisions, and which version a query sees."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LOG = "identity long, ord long, query string, accepted boolean, learned boolean, replaced string, reason string, library array<string>"


def learn(entries: list[list], query: str, content: str, score: float, matched: str, admissible: bool, threshold: float, size: int) -> tuple[bool, bool, str, str]:
    """One decision on a library, entries = [template, content, protected] from the most to the least recently used, changed in
    place. Returns (accepted, learned, replaced, reason). An accepted match moves its template to the front; the query is
    then admitted in front unless its content is known or it isn't admissible. A full library drops the last entry that
    isn't protected. Reasons are fixed values."""
    if score is None or score < threshold:
        return False, False, "", "unlock_failed"
    at = next((i for i, e in enumerate(entries) if e[0] == matched), None)
    if at is None:
        return True, False, "", "matched_template_not_in_library"
    entries.insert(0, entries.pop(at))
    if any(e[1] == content for e in entries):
        return True, False, "", "duplicate_content"
    if not admissible:
        return True, False, "", "not_admissible"
    replaced = ""
    if len(entries) >= size:
        victim = next((i for i in range(len(entries) - 1, -1, -1) if not entries[i][2]), None)
        if victim is None:
            return True, False, "", "template_library_full_and_all_templates_protected"
        replaced = entries.pop(victim)[0]
    entries.insert(0, [query, content, False])
    return True, True, replaced, "accepted"


def learning_log(seeds: DataFrame, attempts: DataFrame, threshold: float = 0.55, size: int = 5) -> DataFrame:
    """A row per attempt (identity, ord, query, content, score, matched, admissible), in order: the decision and the library after it.

    seeds: (identity, rank, template, content), protected, first in rank order. Identities are independent. One identity's
    attempts stream in order through one task, which holds a library only, so memory doesn't grow with them. A null identity
    or ord is left out; attempts of one ord go by query.
    """
    cols = ["identity", "kind", "ord", "query", "content", "score", "matched", "admissible"]
    first = seeds.select("identity", F.lit(0).alias("kind"), F.col("rank").cast("long").alias("ord"), F.col("template").alias("query"), "content", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("matched"), F.lit(True).alias("admissible"))
    later = attempts.withColumn("kind", F.lit(1)).select(*cols)
    rows = first.unionByName(later).where("identity is not null and ord is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, entries = None, []
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string())]
        names = [x.split()[0] for x in LOG.split(", ")]
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                if r["identity"] != now:
                    now, entries = r["identity"], []
                if r["kind"] == 0:
                    entries.append([r["query"], r["content"], True])
                    continue
                got = learn(entries, r["query"], r["content"], r["score"], r["matched"], bool(r["admissible"]), threshold, size)
                out.append((now, r["ord"], r["query"], *got, [e[0] for e in entries]))
            cols_ = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols_, kinds, strict=True)], names)

    return rows.repartition("identity").sortWithinPartitions("identity", "kind", "ord", "query").mapInArrow(run, LOG)


def as_of(rows: DataFrame, versions: DataFrame, key: str, at: str, span: float, value: str) -> DataFrame:
    """rows with value: that of the latest version of the same key at or before the row's time (a number), null if none.

    versions: (key, at, value); of equal times the largest value counts. Time is cut into spans: the last version of each
    span is carried on over spans, and rows are ordered within their key and span, so that a hot key isn't sorted by one task.
    """
    part = F.floor(F.col(at) / span)
    news = versions.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, at).agg(F.max(value).alias(value)).withColumn("part", part)
    both = rows.select(key, F.struct(*rows.columns).alias("row"), at, F.lit(None).cast(dict(versions.dtypes)[value]).alias(value)).withColumn("part", part)
    last = news.groupBy(key, "part").agg(F.max_by(value, at).alias("last"))
    spans = both.select(key, "part").distinct().join(last, [key, "part"], "full")
    carried = spans.withColumn("carried", F.last("last", True).over(W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1))).select(key, "part", "carried")
    all_ = both.withColumn("kind", F.lit(1)).unionByName(news.withColumn("kind", F.lit(0)), True)
    upto = W.partitionBy(key, "part").orderBy(at, "kind").rowsBetween(W.unboundedPreceding, 0)
    found = all_.withColumn("seen", F.last(value, True).over(upto)).where("kind = 1").join(carried, [key, "part"], "left")
    return found.select("row.*", F.coalesce("seen", "carried").alias(value))
