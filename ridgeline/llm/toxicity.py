"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridgeline.llm.common import arrow_map, sealed, staged, utf8

NEW = ["tox_p", "tox_severity", "tox_grade", "tox_toxic"]
PREFIXES = (4, 5, 6)  # a word's features: itself and its prefixes of so many bytes
_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))  # what is no letter becomes a space


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).lower().split()


def terms_of(word: bytes) -> list[bytes]:
    return [word] + [word[:n] + b"*" for n in PREFIXES if len(word) > n]


@dataclass(frozen=True)
class Model:
    """Weights shared by all thresholds: P(grade <= k) = 1 / (1 + exp(weights . x - cuts[k]))."""

    index: dict[bytes, int]
    weights: np.ndarray
    cuts: np.ndarray

    def grades(self, x_dot_w: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - x_dot_w[:, None], -50, 50)))


class _Features(dict):
    """A word's features by word, kept for up to 100,000 words."""

    def __init__(self, index: dict[bytes, int]):
        self.index = index

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = tuple(self.index[t] for t in terms_of(word) if t in self.index)
        return found


def _values(text: bytes, known: _Features) -> Counter:
    return Counter(i for w in words_of(text) for i in known[w])


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grade: np.ndarray, width: int, ridge: float = 1e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts) of a cumulative-link model of grades 0..K by Adam on the mean log-loss; cuts ascend by positive steps."""
    top = int(grade.max()) if len(grade) else 1
    w, c = np.zeros(width), np.concatenate([[2.0], np.zeros(max(top - 1, 0))])
    m, v = np.zeros(width + len(c)), np.zeros(width + len(c))
    n = max(len(grade), 1)
    for t in range(1, steps + 1):
        cuts = c[0] + np.concatenate([[0.0], np.cumsum(np.exp(c[1:]))])
        z = np.bincount(rows, vals * w[cols], minlength=len(grade))
        below = np.column_stack([np.zeros(len(grade)), 1 / (1 + np.exp(np.clip(z[:, None] - cuts[None, :], -50, 50))), np.ones(len(grade))])
        slope = below * (1 - below)
        at = np.arange(len(grade))
        p = np.maximum(below[at, grade + 1] - below[at, grade], 1e-12)
        up, low = slope[at, grade + 1] / p, slope[at, grade] / p
        dz = (up - low) / n
        dcut = np.array([-(up[grade == k].sum() - low[grade == k + 1].sum()) / n for k in range(top)])
        dc = np.concatenate([[dcut.sum()], [dcut[k:].sum() * np.exp(c[k]) for k in range(1, top)]])
        g = np.concatenate([np.bincount(cols, vals * dz[rows], minlength=width) + ridge * w, dc])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, c = w - step[:width], c - step[width:]
    return w, c[0] + np.concatenate([[0.0], np.cumsum(np.exp(c[1:]))])


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, features: int = 4096, fewest: int = 24, seed: int = 5) -> Model:
    """Fit on at most sample labelled documents, the first by a hash of doc_id; their sparse features reach the driver.

    Features: the up to so many words and word prefixes that are more frequent in toxic texts than in clean ones by more than
    chance explains among all terms (likelihood ratio), and the fewest best ones where labels are too few to tell.
    The labels are binary, so grades come from the texts: toxic ones are graded 1 to 3 by thirds of how many words with such
    features they hold, so the order of grades above 0 is the features' own; clean ones are 0. Rows without doc_id, text or label are left out. Without both kinds of labels
    the model calls nothing toxic.
    """
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = labels.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    held = docs.where("text is not null").select("doc_id", utf8().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most sample rows of 12 bytes
    held = staged(held, "labelled")  # the documents are read once for all that follows

    def terms(batches):
        for b in batches:
            df = Counter()
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                df.update((t, toxic) for t in {t for w in set(words_of(text)) for t in terms_of(w)})
            if df:
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in df], pa.binary()), pa.array([x for _, x in df], pa.int32()), pa.array(list(df.values()), pa.int64())], ["term", "toxic", "n"])

    size = {r["toxic"]: r["count"] for r in held.groupBy("toxic").count().collect()}
    if not size.get(0) or not size.get(1):
        return Model({}, np.zeros(0), np.array([50.0]))
    df = held.mapInArrow(terms, "term binary, toxic int, n long").groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    n1, n0, a, b = float(size[1]), float(size[0]), F.col("a").cast("double"), F.col("b").cast("double")
    part = lambda k, of: k * F.log(F.greatest(k, F.lit(1e-9)) / ((a + b) * of / (n1 + n0)))
    rest = lambda k, of: (of - k) * F.log(F.greatest(of - k, F.lit(1e-9)) / ((n1 + n0 - a - b) * of / (n1 + n0)))
    df = staged(df.withColumn("g2", F.when(a / n1 > b / n0, 2 * (part(a, n1) + part(b, n0) + rest(a, n1) + rest(b, n0)))), "terms")
    chance = 2 * float(np.log(max(df.count(), 1)))  # about one term of all would pass by chance
    top = df.where("a >= 3 and g2 is not null").orderBy(F.desc("g2"), "term").limit(features).collect()
    picked = [r for i, r in enumerate(top) if r["g2"] > chance or i < fewest]
    index = {bytes(r["term"]): i for i, r in enumerate(picked)}

    def sparse(batches):
        known = _Features(index)
        for b in batches:
            got = [_values(t, known) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array([list(x.keys()) for x in got], pa.list_(pa.int32())), pa.array([list(x.values()) for x in got], pa.list_(pa.int32()))], ["doc_id", "toxic", "cols", "vals"])

    found = sorted(held.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(sparse, "doc_id long, toxic int, cols array<int>, vals array<int>").collect())
    hits = np.array([sum(r["vals"]) for r in found], float)
    toxic = np.array([r["toxic"] for r in found])
    cuts = np.quantile(hits[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + (hits > cuts[0]).astype(int) + (hits > cuts[1]), 0)
    rows = np.repeat(np.arange(len(found)), [len(r["cols"]) for r in found])
    cols = np.array([c for r in found for c in r["cols"]], int)
    vals = np.log1p(np.array([v for r in found for v in r["vals"]], float))
    w, c = fit_ordinal(rows, cols, vals, grade, len(index))
    return Model(index, w, c)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs and, for each row, p_toxic = P(grade > 0), severity = the expected grade, grade = the likeliest one, and
    toxic = p_toxic >= 0.5. Whole texts count; null and empty texts hold no feature, and score as such. The new columns
    are named as said with a leading tox_, and columns of these names are replaced. No rows give no rows."""
    docs = docs.drop("tox_p", "tox_severity", "tox_grade", "tox_toxic")
    index, weights = model.index, model.weights
    state: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = state.setdefault("known", _Features(index))
        z = np.array([sum(weights[i] * np.log1p(n) for i, n in _values(t, known).items()) for t in batch.column("tox_text").to_pylist()], float)
        over = model.grades(z)
        p = np.column_stack([np.ones(len(z)), over]) - np.column_stack([over, np.zeros(len(z))])
        new = [pa.array(over[:, 0]), pa.array(over.sum(1)), pa.array(p.argmax(1).astype(np.int32)), pa.array(over[:, 0] >= 0.5)]
        return pa.RecordBatch.from_arrays([batch.column("row"), *new], ["row", *NEW])

    held = sealed(docs, "text").select("row", utf8().alias("tox_text"))
    schema = StructType([held.schema["row"], *StructType.fromDDL("tox_p double, tox_severity double, tox_grade int, tox_toxic boolean").fields])
    scored = arrow_map(held, run, schema)
    return scored.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], *NEW)
