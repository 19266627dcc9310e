"""Quality scores: random Fourier features of document statistics, ridge regression and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import arrow_map, staged, utf8

WIDTH = 256  # random features
BINS = 1000  # of raw scores, for calibration
_KINDS = np.zeros((256, 8))  # of bytes: upper, lower, digit, space, newline, sentence marks, other ASCII, above ASCII
for _c in range(256):
    _s = chr(_c)
    _KINDS[_c, 7 if _c > 127 else 0 if _s.isupper() else 1 if _s.islower() else 2 if _s.isdigit() else 4 if _c == 10 else 3 if _s.isspace() else 5 if _s in ".,;:'\"-()?" else 6] = 1


def statistics(text: bytes) -> list[float]:
    """Numbers that describe a text: shares of kinds of bytes, lengths of words and lines, and how much of them repeats."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, words, lines = max(len(text), 1), text.split(), [x for x in text.split(b"\n") if x.strip()]
    kinds = counts @ _KINDS / n
    w, ln = max(len(words), 1), max(len(lines), 1)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    marked = sum(not x[-1:].isalnum() and x[-1] < 128 and x[-1:] not in b".,;:" for x in words) / w
    p = counts[counts > 0] / n
    return [
        *kinds.tolist(), float(np.log1p(len(words))), float(np.log1p(len(lines))), float(lengths.mean()), float(lengths.std()), float(lengths.max()) ** 0.5,
        len(set(words)) / w, len(set(lines)) / ln, float(np.log1p(w / ln)), marked, sum(x.isupper() for x in words) / w, float(-(p * np.log2(p)).sum()) if len(text) else 0.0,
        sum(len(x) == 1 for x in words) / w,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of each row; a null text is empty."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = [statistics(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), utf8().alias("text")), rows, "doc_id long, stats array<double>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.ones(len(x)), x, np.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions.T + self.phases)])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.knots, self.levels), 0, 1)


def isotonic(x: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function that fits shares ones / n at ascending x best, by pooling adjacent violators. Shares are
    drawn a little to the middle, by half a one in one more row of each pool, and pooled again where that lets them fall."""
    at, share = x.astype(float), ones / n
    for smooth in (True, False):
        pools: list[list[float]] = []
        for xi, y, m in zip(at, share, n, strict=True):
            pools.append([xi * m, y * m, m])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
        at, n = np.array([p[0] / p[2] for p in pools]), np.array([p[2] for p in pools])
        share = np.array([(p[1] + 0.5) / (p[2] + 1) if smooth else p[1] / p[2] for p in pools])
    return at, share


def train(stats: DataFrame, labels: DataFrame, ridge: float = 1e-3, seed: int = 3) -> Model:
    """Fit on all labelled rows (stats joined with doc_id, quality): nothing is sampled.

    Each partition adds up its part of the normal equations, 300 rows of 300 numbers; those are added up by row in Spark,
    and one matrix reaches the driver. Three quarters of the labelled rows (by a hash of doc_id) fit the ridge scores, the
    others calibrate them: their labels are counted in 1000 bins of the score, and the bins fitted by a rising function.
    Missing doc_ids and labels are left out; repeated labels of a document count as one, the larger. With no labels, every
    score is 0.5.
    """
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    held = staged(stats.join(labels, "doc_id").withColumn("fits", F.expr("pmod(xxhash64(doc_id, 77), 4) != 0")), "labelled")
    moments = held.where("fits").select(F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).orderBy("i").collect()
    if not moments:
        d = len(statistics(b""))
        return Model(np.zeros(d), np.ones(d), np.zeros((1, d)), np.zeros(1), np.zeros(d + 2), np.array([0.0]), np.array([0.5]))
    mean, scale = np.array([r["mean"] for r in moments]), np.maximum([r["sd"] for r in moments], 1e-6)
    d, rng = len(mean), np.random.default_rng(seed)
    model = Model(mean, scale, rng.standard_normal((WIDTH, d)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, WIDTH), np.zeros(0), np.zeros(0), np.zeros(0))

    def sums(batches):
        total = 0
        for b in batches:
            if b.num_rows:
                x = np.column_stack([model.features(np.array(b.column("stats").to_pylist())), b.column("y").to_numpy()])
                total = total + x.T @ x
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total))], ["i", "v"])

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column("i").to_pylist(), b.column("v").to_numpy(zero_copy_only=False), strict=True):
                total[i] = total.get(i, 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["i", "v"])

    rows = held.where("fits").mapInArrow(sums, "i int, v array<double>").repartition(8, "i").mapInArrow(added, "i int, v array<double>")
    whole = np.array([r["v"] for r in sorted(rows.collect())])
    a, b, n = whole[:-1, :-1], whole[:-1, -1], whole[0, 0]
    weights = np.linalg.solve(a + ridge * n * np.eye(len(a)), b)
    model = Model(model.mean, model.scale, model.directions, model.phases, weights, np.zeros(0), np.zeros(0))

    def binned(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = np.clip(model.raw(np.array(batch.column("stats").to_pylist())), -1, 2)
        return pa.RecordBatch.from_arrays([pa.array(((raw + 1) / 3 * BINS).astype(np.int32)), batch.column("y")], ["bin", "y"])

    bins = arrow_map(held.where("not fits"), binned, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("ones"), F.count("*").alias("n")).orderBy("bin").collect()
    if not bins:
        return Model(model.mean, model.scale, model.directions, model.phases, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    knots, levels = isotonic(np.array([(r["bin"] + 0.5) / BINS * 3 - 1 for r in bins]), np.array([r["ones"] for r in bins]), np.array([r["n"] for r in bins], float))
    return Model(model.mean, model.scale, model.directions, model.phases, weights, knots, levels)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of document statistics; empty texts have statistics, and so a score."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.calibrated(model.raw(np.array(batch.column("stats").to_pylist()))))], ["doc_id", "score"])

    return arrow_map(stats.select("doc_id", "stats"), rows, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs; labels (doc_id, quality) of held-out rows are never read.

    held_out: crc32 of doc_id as text leaves 2 when divided by 4 (false for a null doc_id). Only texts are inputs of a score.
    Repeated rows get equal scores; no rows give no rows.
    """
    out = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"), F.lit(False))
    stats = staged(document_statistics(docs), "stats")
    model = train(stats, labels.where(~out))
    got = score(stats, model)
    return got.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
