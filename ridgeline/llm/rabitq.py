"""Near-duplicate vectors by randomly rotated binary codes with correction factors."""

from __future__ import annotations

from functools import lru_cache
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import spanning, staged, starts, whole_groups
from ridgeline.llm.components import components

BLOCK = 1024  # rows of a bucket that meet in one unit of work; larger buckets are dealt as pairs of blocks
WHOLE = 20_000  # a label with no more different vectors is one bucket, in which all are compared
EPSILON = 5.0  # width of the confidence bound, in units of the estimator's standard deviation
MISS = 1e-6  # chance that no bucket of a larger label holds a pair just at the threshold
LEVELS = 4  # bits to which the other side's coordinates are rounded


@lru_cache(4)
def rotations(dim: int, bits: int, seed: int = 7) -> np.ndarray:
    """Random rotations, one below the other: at least so many rows, each dim of them orthonormal."""
    rng = np.random.default_rng([seed, dim])
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0].T for _ in range(max(1, ceil(bits / dim)))])


def tables_for(largest: int, threshold: float) -> tuple[int, int]:
    """(bits of a key, number of keys) so that buckets stay small and a pair at the threshold shares a key but for MISS."""
    agree = 1 - acos(threshold) / pi
    k = min(32, max(6, ceil(log2(max(largest, 2) / 8))))
    return k, ceil(log(MISS) / log(1 - agree**k))


def keys_of(vectors: np.ndarray, k: int, n_keys: int) -> np.ndarray:
    """n_keys keys of k sign bits of randomly rotated vectors, for each of these."""
    y = vectors @ rotations(vectors.shape[1], k * n_keys).T
    return (y[:, : k * n_keys] > 0).reshape(len(y), n_keys, k) @ (1 << np.arange(k))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits (rows, dim) as rows of 64-bit words."""
    out = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(out, ((0, 0), (0, -out.shape[1] % 8))).view(np.uint64)


def encode(unit: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """What is stored of unit vectors: code, the signs of the rotated coordinates, and its correction factor <code, vector>; and the
    rotated coordinates rounded to LEVELS bits, as planes of bits, with the lowest value, the step and the coordinates' sum.

    Rounding goes up or down at random, by a fixed draw for each coordinate, so that it is right on average.
    """
    dim = unit.shape[1]
    y = unit @ rotations(dim, dim, seed)[:dim].T
    low = y.min(1)
    step = np.maximum((y.max(1) - low) / (2**LEVELS - 1), 1e-300)
    level = np.clip(np.floor((y - low[:, None]) / step[:, None] + np.random.default_rng([seed, dim, 1]).random(dim)), 0, 2**LEVELS - 1).astype(np.uint8)
    planes = np.concatenate([_packed(level >> k & 1) for k in range(LEVELS)], axis=1)
    return {"code": _packed(y > 0), "planes": planes, "factor": np.abs(y).sum(1) / sqrt(dim), "low": low, "step": step, "total": y.sum(1)}


def estimates(c: dict[str, np.ndarray], dim: int, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of all inner products of rows a and b, from a's codes and b's rounded coordinates, and their bounds."""
    code, planes, words = c["code"][a], c["planes"][b], c["code"].shape[1]
    on = np.zeros((len(code), len(planes)), np.int32)  # the sum of b's levels where a's code is 1
    for k in range(LEVELS):
        for w in range(words):
            on += np.bitwise_count(code[:, None, w] & planes[None, :, k * words + w]).astype(np.int32) << k
    ones = np.bitwise_count(code).sum(1).astype(float)
    product = (2 * (c["low"][b][None, :] * ones[:, None] + c["step"][b][None, :] * on) - c["total"][b][None, :]) / sqrt(dim)
    f = c["factor"][a][:, None]
    spread = np.sqrt(np.maximum(0, 1 - f * f) / max(dim - 1, 1e-9)) + c["step"][b][None, :] / 2
    return product / f, EPSILON * spread / f


UNIT = ["table", "label", "dim", "key", "i", "j"]
STORED = {"code": np.uint64, "planes": np.uint64, "factor": float, "low": float, "step": float, "total": float}


def _units(g: dict[str, np.ndarray]):
    """The rows of each unit of work."""
    edge = np.append(np.flatnonzero(starts(*(g[c] for c in UNIT))), len(g["cid"]))
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        yield {n: v[lo:hi] for n, v in g.items()}


def _apart(u: dict[str, np.ndarray], a: slice, b: slice) -> np.ndarray:
    """Which of rows a and b meet in this unit: each two rows once, and of different blocks where the unit is of two."""
    at, bt = np.arange(len(u["cid"]))[a], np.arange(len(u["cid"]))[b]
    meet = at[:, None] < bt[None, :]
    return meet if u["i"][0] == u["j"][0] else meet & (u["block"][a][:, None] != u["block"][b][None, :])


def _open_rows(threshold: float):
    """The rows of each unit that take part in a pair which the codes can't rule out."""

    def run(batches):
        for g in whole_groups(batches, UNIT):
            for u in _units(g):
                n, dim = len(u["cid"]), int(u["dim"][0])
                c = {k: np.frombuffer(b"".join(u[k]), t).reshape(n, -1) if t is np.uint64 else u[k] for k, t in STORED.items()}
                open_ = np.zeros(n, bool)
                for lo in range(0, n, 256):
                    a, b = slice(lo, min(lo + 256, n)), slice(lo, n)
                    estimate, bound = estimates(c, dim, a, b)
                    may = (estimate + bound >= threshold) & _apart(u, a, b)
                    open_[a] |= may.any(1)
                    open_[b] |= may.any(0)
                if open_.any():
                    yield pa.RecordBatch.from_arrays([pa.array(u[x][open_]) for x in (*UNIT, "block", "cid", "size")], [*UNIT, "block", "cid", "size"])

    return run


def _links(threshold: float, k: int, n_keys: int):
    """Links among the open rows of each unit, recomputed exactly: for each class the number of linked rows, and the smallest class
    of its component there."""

    def run(batches):
        for g in whole_groups(batches, UNIT):
            for u in _units(g):
                raw = np.stack(u["v"]).astype(np.float64)
                raw /= np.abs(raw).max(1, keepdims=True)
                norm = np.linalg.norm(raw, axis=1)
                unit = raw / norm[:, None]
                keys = keys_of(unit, k, n_keys) if u["table"][0] >= 0 else None
                n, count, a_all, b_all = len(raw), np.zeros(len(raw), np.int64), [], []
                for lo in range(0, n, 256):
                    a, b = slice(lo, min(lo + 256, n)), slice(lo, n)
                    cosine = unit[a] @ unit[b].T
                    x, y = np.nonzero((cosine >= threshold - 1e-9) & _apart(u, a, b))
                    close = np.abs(cosine[x, y] - threshold) <= 1e-9
                    x, y = x + lo, y + lo
                    link = ~close
                    link[close] = np.einsum("ij,ij->i", raw[x[close]], raw[y[close]]) / (norm[x[close]] * norm[y[close]]) >= threshold
                    x, y = x[link], y[link]
                    if keys is not None:  # only the first bucket that holds a pair counts it
                        once = ~((keys[x] == keys[y]) & (np.arange(n_keys) < u["table"][0])).any(1)
                        x, y = x[once], y[once]
                    np.add.at(count, x, u["size"][y])
                    np.add.at(count, y, u["size"][x])
                    node, root = spanning(u["cid"][x], u["cid"][y])
                    a_all.append(node)
                    b_all.append(root)
                if not count.any():
                    continue
                node, root = spanning(np.concatenate(a_all), np.concatenate(b_all))
                hit = np.flatnonzero(count)
                pos = np.searchsorted(node, u["cid"][hit])
                pos[pos == len(node)] = 0
                roots = np.where(node[pos] == u["cid"][hit], root[pos], u["cid"][hit])
                yield pa.RecordBatch.from_arrays([pa.array(u["cid"][hit], pa.int64()), pa.array(count[hit]), pa.array(roots, pa.int64())], ["cid", "n", "root"])

    return run


def near_duplicates(rows: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of rows (vec_id, embedding, label).

    Vectors of equal, non-null label and equal length link when their cosine is threshold or more. Equal vectors are one
    class. Of each class a binary code of the rotated vector with its correction factor, and coarse coordinates, are stored
    once; only these meet in buckets. An unbiased estimate and its confidence bound rule pairs out; raw vectors are fetched
    for the rows of the pairs left, and cosines recomputed in double precision, so no link is false. A label of up to 20,000
    classes is one bucket, and a link is lost only if its estimate is off by five standard deviations. In larger labels keys of
    sign bits name buckets, so many that a pair at the threshold shares none with a chance of 1 in a million. A bucket
    of over 1024 classes is dealt as pairs of blocks, each a unit of work; units return counts and stars, never all pairs.
    n_links counts the linked rows; component_id is the smallest vec_id reachable; kept says that it is the row's own. Null,
    zero, empty and non-finite vectors and null labels link with nothing. Repeated rows link with each other; no rows give
    no rows.
    """
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    fit = F.expr("label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x != 0)")
    rows = staged(rows.withColumn("fit", F.coalesce(fit, F.lit(False))), "vectors")
    classes = rows.where("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("size"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "classes")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n")).head()[0] or 1
    k, n_keys = tables_for(largest, threshold)

    def code(batches):
        for b in batches:
            for large in (False, True):
                for dim in set(b.column("dim").to_pylist()):
                    part = b.filter(pc.and_(pc.equal(b.column("dim"), dim), pc.equal(b.column("large"), large)))
                    if not part.num_rows:
                        continue
                    v = part.column("embedding").flatten().to_numpy().reshape(-1, dim)
                    v = v / np.abs(v).max(1, keepdims=True)
                    v /= np.linalg.norm(v, axis=1, keepdims=True)
                    c = encode(v)
                    stored = [pa.array([r.tobytes() for r in c[n]], pa.binary()) if t is np.uint64 else pa.array(c[n]) for n, t in STORED.items()]
                    keys = list(keys_of(v, k, n_keys)) if large else [[0]] * len(v)
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("cid", "label", "dim", "size", "large")), *stored, pa.array(keys, pa.list_(pa.int64()))], ["cid", "label", "dim", "size", "large", *STORED, "keys"])

    held = classes.join(sizes.select("label", "dim", (F.col("n") > WHOLE).alias("large")), ["label", "dim"]).select("cid", "label", "dim", "size", "large", "embedding")
    fields = "cid long, label string, dim int, size long, large boolean, code binary, planes binary, factor double, low double, step double, total double, keys array<long>"
    coded = staged(held.mapInArrow(code, fields), "codes")
    bucket = ["table", "label", "dim", "key"]
    keyed = coded.select("cid", "label", "dim", "size", "large", *STORED, F.posexplode("keys").alias("at", "key")).withColumn("table", F.when(F.col("large"), F.col("at")).otherwise(-1))
    over = keyed.groupBy(bucket).agg(F.count("*").alias("n")).where(f"n > {BLOCK}").withColumn("blocks", F.ceil(F.col("n") / (BLOCK // 2)).cast("int")).drop("n")
    keyed = keyed.join(over, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    keyed = keyed.withColumn("block", F.expr("cast(pmod(xxhash64(cid), blocks) as int)")).withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    units = keyed.select(*bucket, F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "cid", "size", *STORED)
    unit_fields = "table int, label string, dim int, key long, i int, j int, block int, cid long, size long"
    open_ = staged(units.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(_open_rows(threshold), unit_fields), "open")
    fetched = open_.join(classes.select("cid", F.col("embedding").alias("v")), "cid").select(*UNIT, "block", "cid", "size", "v")
    found = staged(fetched.repartition(*UNIT).sortWithinPartitions(*UNIT, "cid").mapInArrow(_links(threshold, k, n_keys), "cid long, n long, root long"), "links")
    links = found.groupBy("cid").agg(F.sum("n").alias("n"))
    roots = staged(components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))), "roots").withColumnRenamed("node", "cid")
    named = classes.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(links, "cid", "left").join(least, "root").select("label", "embedding", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n"), "component")
    out = rows.join(named.withColumn("fit", F.lit(True)), ["fit", "label", "embedding"], "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
