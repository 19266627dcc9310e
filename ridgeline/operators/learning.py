"""Identification against libraries that learn: genuine attempts in order, the libraries' versions, impostors against the version of their time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.operators.blocks import each
from ridgeline.sources.tables import written

LOG = "identity long, ord long, query long, score double, matched long, accepted boolean, learned boolean, replaced long, reasons array<string>, confirmations int, common_ratio double, updates int, templates int"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.float64(), pa.int32(), pa.int32()]


@dataclass(frozen=True)
class Rules:
    """When a match counts, and when its query is learned."""

    unlock: float = 0.55
    learn: float = 0.85
    most_common: float = 0.35  # share of the common area
    least_pixels: float = 256.0
    size: int = 40  # templates of a library


def similarity(v: np.ndarray, others: np.ndarray) -> np.ndarray:
    """1 - d/2 of unit vectors, to 12 decimals."""
    return np.round(np.maximum(1 - np.sqrt(np.maximum(2 - 2 * (others @ v), 0)) / 2, 0), 12)


def common_area(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(pixels, share of the smaller) that two boxes (x, y, width, height) have in common."""
    wide, high = (min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k]) for k in (0, 1))
    least = min(a[2] * a[3], b[2] * b[3])
    pixels = max(0.0, wide) * max(0.0, high)
    return pixels, pixels / least if least > 0 else 0.0


@dataclass
class Template:
    id: int
    content: str
    v: np.ndarray
    box: np.ndarray
    protected: bool


def attempt(library: list[Template], query: Template, rules: Rules) -> tuple:
    """One genuine attempt: the columns of LOG from score on. library goes from the most to the least recently used and is changed in place.

    An accepted match moves its template to the front. The query is learned, in front, if its content is new, the score is high
    and the matched template shares enough but not too much area with it; all reasons against are named (fixed values). A full
    library loses its last template that isn't protected. An empty library gives score 0 and no match; ties go to the front.
    """
    scores = similarity(query.v, np.stack([t.v for t in library])) if library else np.zeros(0)
    at = int(scores.argmax()) if len(scores) else -1
    score, matched = (float(scores[at]), library[at].id) if at >= 0 else (0.0, None)
    if at < 0 or score < rules.unlock:
        return score, matched, False, False, None, ["unlock_failed"], 0, None, 0, len(library)
    found = library.pop(at)
    library.insert(0, found)
    pixels, share = common_area(query.box, found.box)
    confirmed = score >= rules.learn and pixels > 0 and pixels >= rules.least_pixels and share <= rules.most_common
    reasons = ["duplicate_template_content"] * any(t.content == query.content for t in library) + ["no_high_score_low_overlap_match"] * (not confirmed)
    victim = None
    if not reasons and len(library) >= rules.size:
        victim = next((t for t in reversed(library) if not t.protected), None)
        if victim is None:
            reasons = ["template_library_full_and_all_templates_protected"]
    if reasons:
        return score, matched, True, False, None, reasons, int(confirmed), share, 1, len(library)
    if victim is not None:
        library.remove(victim)
    library.insert(0, query)
    return score, matched, True, True, victim.id if victim else None, ["accepted"], 1, share, 2, len(library)


def genuine_log(seeds: DataFrame, queries: DataFrame, rules: Rules) -> DataFrame:
    """A row for each query (ord, identity, id, content, v, box) in the order of ord: its attempt on its own identity's library, and what that learned.

    seeds: (identity, rank, id, content, v, box), protected, first in rank order; ids are unique among seeds and queries. Vectors
    are of unit length. Identities are independent; one identity's rows stream through one task in order, which holds a
    library only. Rows with a null identity, ord, id, vector or box are left out; queries of one ord go by id; an identity
    without seeds accepts nothing.
    """
    cols = ["identity", "kind", "ord", "id", "content", "v", "box"]
    first = seeds.withColumn("kind", F.lit(0)).withColumn("ord", F.col("rank").cast("long")).select(*cols)
    rows = first.unionByName(queries.withColumn("kind", F.lit(1)).select(*cols)).dropna(subset=[c for c in cols if c != "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, library = None, []
        for b in batches:
            if not b.num_rows:
                continue
            plain = {c: b.column(c).to_pylist() for c in cols[:5]}
            v, box = (b.column(c).flatten().to_numpy().reshape(b.num_rows, -1) for c in ("v", "box"))
            out: list[tuple] = []
            for k, identity in enumerate(plain["identity"]):
                if identity != now:
                    now, library = identity, []
                t = Template(plain["id"][k], plain["content"][k] or "", v[k], box[k], plain["kind"][k] == 0)
                if t.protected:
                    library.append(t)
                else:
                    out.append((now, plain["ord"][k], t.id, *attempt(library, t, rules)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), _TYPES, strict=True)], [x.split()[0] for x in LOG.split(", ")])

    return rows.repartition("identity").sortWithinPartitions("identity", "kind", "ord", "id").mapInArrow(run, LOG)


def running_total(rows: DataFrame, order: str, value: str, span: int, name: str) -> DataFrame:
    """rows with the sum of value over all rows up to their place in order (a long; equal places count together).

    Sums are taken within spans of order and carried over them, so only a row for each span is ordered in one task.
    """
    part = F.floor(F.col(order) / span)
    spans = rows.groupBy(part.alias("_part")).agg(F.sum(value).alias("_sum"))
    carried = spans.select("_part", (F.sum("_sum").over(W.orderBy("_part")) - F.col("_sum")).alias("_before"))
    within = F.sum(value).over(W.partitionBy("_part").orderBy(order).rangeBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_part", part).withColumn("_within", within).join(carried, "_part").withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")


def lives(seeds: DataFrame, queries: DataFrame, log: DataFrame) -> DataFrame:
    """(id, identity, v, valid_from, valid_to) of each template that was ever in a library: it counts for attempts with valid_from < ord <= valid_to."""
    learned = queries.join(log.where("learned").select(F.col("query").alias("id"), F.col("ord").alias("valid_from")), "id").select("id", "identity", "v", "valid_from")
    ends = log.where("replaced is not null").select("identity", F.col("replaced").alias("id"), F.col("ord").alias("valid_to"))
    all_ = seeds.select("id", "identity", "v", F.lit(-(2**62)).cast("long").alias("valid_from")).unionByName(learned)
    return all_.join(ends, ["identity", "id"], "left").withColumn("valid_to", F.coalesce("valid_to", F.lit(2**62)))


def impostor_scores(queries: DataFrame, templates: DataFrame) -> DataFrame:
    """(ord, query, identity, score, matched) of each query against each other identity's library as it was at its ord (see lives).

    Queries meet templates in blocks, in which templates out of their time are left out; the best of each identity is taken in
    the block, then over blocks, so an identity of any number of templates is dealt over tasks. Ties go to the lower template.
    """

    def found(q, g, d):
        s = np.round(np.maximum(1 - d / 2, 0), 12)
        ords, start, end = q[3], g[3], g[4]
        s[(q[1][:, None] == g[1][None, :]) | (start[None, :] >= ords[:, None]) | (ords[:, None] > end[None, :])] = -1
        order = np.lexsort((g[0], g[1]))
        s, ids, owners = s[:, order], g[0][order], g[1][order]
        edge = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
        for lo, hi in zip(edge, np.append(edge[1:], len(owners)), strict=True):
            best = s[:, lo:hi].argmax(1)
            top = s[np.arange(len(s)), lo + best]
            at = top >= 0
            yield pa.RecordBatch.from_arrays([pa.array(ords[at]), pa.array(q[0][at]), pa.array(np.full(at.sum(), owners[lo])), pa.array(top[at]), pa.array(ids[lo:hi][best][at])], ["ord", "query", "identity", "score", "matched"])

    name = lambda df: df.withColumnRenamed("identity", "owner")
    some = each(name(queries), name(templates), "id", found, "ord long, query long, identity long, score double, matched long", asked_more=("ord",), held_more=("valid_from", "valid_to"))
    best = F.max(F.struct("score", (-F.col("matched")).alias("m")))
    return some.groupBy("ord", "query", "identity").agg(best.alias("b")).select("ord", "query", "identity", "b.score", (-F.col("b.m")).alias("matched"))


def attempts(seeds: DataFrame, queries: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(log, attempts): genuine_log with update_counter, all updates of all libraries up to the row; and (ord, query, identity, genuine,
    score, matched, accepted) of each query against its own library before it learns and all others as of then."""
    queries = queries.dropna(subset=["identity", "ord", "id", "v", "box"])
    log = written(genuine_log(seeds, queries, rules), "learning")
    others = impostor_scores(queries, lives(seeds, queries, log))
    own = log.select("ord", "query", "identity", F.lit(True).alias("genuine"), "score", "matched", "accepted")
    every = own.unionByName(others.withColumn("genuine", F.lit(False)).withColumn("accepted", F.col("score") >= rules.unlock))
    return running_total(log, "ord", "updates", 1 << 20, "update_counter"), every


def learning_summary(seeds: DataFrame, log: DataFrame, rules: Rules) -> DataFrame:
    """One row: what the libraries hold and what the queries did; zeros without queries."""
    n = seeds.agg(F.count("*").alias("initial_template_count"))
    done = log.agg(F.count("*").alias("num_queries_processed"), F.count_if("accepted").alias("num_unlock_accepts"), F.count_if("learned").alias("num_templates_learned"), F.count_if(F.col("replaced").isNotNull()).alias("num_templates_replaced"), F.coalesce(F.sum("updates"), F.lit(0)).alias("update_counter"))
    return n.crossJoin(done).withColumn("max_active_templates", F.lit(rules.size))  # one row each
