"""A stated query set against a gallery of vectors, in blocks of matrix products."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 512  # query vectors of a block, on average
GALLERY = 2048  # gallery vectors of a block
PARTS = 64  # groups of gallery blocks; each query block is dealt to all of them
SIDE = 8  # parts of either side where whole parts meet


def blocked(vectors: DataFrame, by: str, size: int = BLOCK, more: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Rows (id, owner, v, more) as blocks (block, rows) of about `size` rows, dealt by a hash of the column by, and how many blocks there
    may be; rows with a null stay out."""
    rows = vectors.where("id is not null and owner is not null and v is not null")
    n = max(1, -(-rows.count() // size))
    return rows.groupBy(F.expr(f"pmod(xxhash64(`{by}`), {n})").alias("block")).agg(F.collect_list(F.struct("id", "owner", "v", *more)).alias("rows")), n


def _matrix(rows, more: tuple[str, ...] = ()) -> tuple[np.ndarray, ...]:
    flat = rows.flatten() if hasattr(rows, "flatten") else rows
    v = flat.field("v")
    return flat.field("id").to_numpy(), flat.field("owner").to_numpy(), v.flatten().to_numpy().reshape(len(flat), -1), *(flat.field(c).to_numpy() for c in more)


def in_order(q: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The dot products of all rows of q with all of g, each summed from the first value to the last."""
    dots = np.zeros((len(q), len(g)))
    for k in range(q.shape[1]):
        dots += q[:, k, None] * g[None, :, k]
    return dots


def unit_distances(dots: np.ndarray) -> np.ndarray:
    """The L2 distances of unit vectors of these dot products, to twelve decimals; halves go up, as in SQL (numpy's go to even numbers)."""
    return np.floor(np.sqrt(np.maximum(2 - 2 * dots, 0)) * 1e12 + 0.5) / 1e12


def _distances(q: np.ndarray, g: np.ndarray, metric: str) -> np.ndarray:
    """l2: of unit vectors; hamming: the share of differing signs of vectors of 1 and -1."""
    if metric == "hamming":
        return (1 - q @ g.T / q.shape[1]) / 2
    return unit_distances(q @ g.T)


def each(queries: DataFrame, gallery: DataFrame, by: str, found, schema: str, metric: str = "l2", asked_more: tuple[str, ...] = (), held_more: tuple[str, ...] = ()) -> DataFrame:
    """What found gives for each block of queries against each block of the gallery.

    found takes the columns (ids, owners, vectors, then the numbers that are asked for besides) of either and their distances.
    Gallery blocks are dealt once, in at most PARTS groups, and a query block to each group, so what is shuffled grows with the rows
    and not with pairs of blocks. They meet in a merge join: however small a side looks, it isn't collected to be broadcast.
    """
    (asked, _), (held, n) = blocked(queries, "id", BLOCK, asked_more), blocked(gallery, by, GALLERY, held_more)
    parts = min(n, PARTS)
    dealt = asked.select(F.col("rows").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    pairs = dealt.join(held.select((F.col("block") % parts).alias("part"), F.col("rows").alias("g")).hint("merge"), "part").select("q", "g")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                q, g = _matrix(b.column("q").slice(i, 1), asked_more), _matrix(b.column("g").slice(i, 1), held_more)
                yield from found(q, g, _distances(q[2], g[2], metric))

    return pairs.mapInArrow(run, schema)


def parts_met(queries: DataFrame, gallery: DataFrame, work, schema: str) -> DataFrame:
    """What work gives for each part of the gallery and each part of the queries, a task for each two.

    work takes the columns (ids, owners, vectors) of a part of the gallery, by ascending ids, and an iterator of those of the queries,
    some hundred rows at a time. Rows are dealt by hashes of their ids, at most SIDE ways, so each is shuffled at most SIDE times and
    a task holds its part of the gallery only; rows with a null stay out.
    """
    known = "id is not null and owner is not null and v is not null"
    sides = [x.where(known).select("id", "owner", "v") for x in (gallery, queries)]
    held, asked = (max(1, min(SIDE, -(-x.count() // size))) for x, size in zip(sides, (GALLERY, BLOCK), strict=True))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda n: F.expr(f"cast(pmod(xxhash64(id), {n}) as int)")
    left = sides[0].select(mine(held).alias("_g"), every(asked).alias("_q"), F.lit(0).alias("_side"), "*")
    right = sides[1].select(every(held).alias("_g"), mine(asked).alias("_q"), F.lit(1).alias("_side"), "*")
    rows = left.unionByName(right).withColumn("_part", F.col("_g") * asked + F.col("_q")).drop("_g", "_q")

    def run(batches):
        def columns(rows):
            return rows["id"].to_numpy(), rows["owner"].to_numpy(), rows["v"].flatten().to_numpy().reshape(rows.num_rows, -1)

        first, rest = [], iter(batches)
        for b in rest:
            n = int((b["_side"].to_numpy() == 0).sum())
            first.append(b.slice(0, n))
            if n < b.num_rows:
                break
        else:
            return  # no queries
        if not sum(x.num_rows for x in first):
            return
        ids, owners, v = (np.concatenate(x) for x in zip(*(columns(x) for x in first if x.num_rows), strict=True))
        order = np.argsort(ids, kind="stable")

        def asked_blocks():
            for x in chain([b.slice(n)], rest):
                for lo in range(0, x.num_rows, BLOCK):
                    yield columns(x.slice(lo, BLOCK))

        yield from work((ids[order], owners[order], v[order]), asked_blocks())

    return rows.repartitionById(held * asked, "_part").drop("_part").sortWithinPartitions("_side").mapInArrow(run, schema)


def nearest_of_all(queries: DataFrame, gallery: DataFrame, k: int) -> DataFrame:
    """nearest by L2 distance, for as many queries as there are gallery rows: a task keeps each query's k nearest of its part of the
    gallery, and works out the distances of a block only for queries to which it may hold a nearer one."""

    def work(held, asked):
        ids, _, v = held
        for q, _, x in asked:
            d, at = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)
            for lo in range(0, len(ids), GALLERY):
                dots = x @ v[lo : lo + GALLERY].T
                here = ids[lo : lo + GALLERY]
                for i in np.flatnonzero(np.isin(q, here)):
                    dots[i, here == q[i]] = -np.inf
                most = dots.max(1)
                if np.isnan(most).any():
                    dots[np.isnan(dots)] = -np.inf
                    most = dots.max(1)
                open_ = np.flatnonzero(unit_distances(most) < d[:, -1])  # rows are read by ascending ids, so equals come too late
                if not len(open_):
                    continue
                some, rows = unit_distances(dots[open_]), np.arange(len(open_))
                near, places = d[open_], at[open_]
                for _ in range(min(k, some.shape[1])):
                    least = some.argmin(1)
                    near, places = np.column_stack([near, some[rows, least]]), np.column_stack([places, lo + least])
                    some[rows, least] = np.inf
                order = np.argsort(near, axis=1, kind="stable")[:, :k]
                d[open_], at[open_] = np.take_along_axis(near, order, 1), np.take_along_axis(places, order, 1)
            found = np.isfinite(d).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, k)[found]), pa.array(ids[at.ravel()[found]]), pa.array(d.ravel()[found])], ["q", "g", "d"])

    near = parts_met(queries, gallery, work, "q long, g long, d double")
    return near.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("d", "g"))).where(F.col("rank") <= k)


def nearest(queries: DataFrame, gallery: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(q, g, d, rank): the k nearest other gallery rows of each query by L2 distance of unit vectors, or by the share of
    differing bits of codes (hamming; bits as 1 and -1); ties by gallery id."""

    def found(q, g, d):
        d = np.where(q[0][:, None] == g[0][None, :], np.inf, d)
        order = np.lexsort((np.broadcast_to(g[0], d.shape), d), axis=1)[:, :k]
        rows = np.arange(len(d))[:, None]
        at = np.isfinite(d[rows, order]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q[0], order.shape[1])[at]), pa.array(g[0][order].ravel()[at]), pa.array(d[rows, order].ravel()[at])], ["q", "g", "d"])

    near = each(queries, gallery, "id", found, "q long, g long, d double", metric)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("d", "g"))).where(F.col("rank") <= k)


def nearest_both(queries: DataFrame, gallery: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(back, of, to, d, rank): the k nearest gallery rows of each query (back false) and the k nearest queries of each gallery row
    (back true), from one pass over the distances: a block gives the nearest of its rows and of its columns. See nearest."""

    def found(q, g, d):
        d = np.where(q[0][:, None] == g[0][None, :], np.inf, d)
        for back, one, two, m in ((False, q[0], g[0], d), (True, g[0], q[0], d.T)):
            order = np.lexsort((np.broadcast_to(two, m.shape), m), axis=1)[:, :k]
            rows = np.arange(len(m))[:, None]
            at = np.isfinite(m[rows, order]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(at.sum(), back)), pa.array(np.repeat(one, order.shape[1])[at]), pa.array(two[order].ravel()[at]), pa.array(m[rows, order].ravel()[at])], ["back", "of", "to", "d"])

    near = each(queries, gallery, "id", found, "back boolean, of long, to long, d double", metric)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("back", "of").orderBy("d", "to"))).where(F.col("rank") <= k)


def identity_scores(queries: DataFrame, templates: DataFrame, top: int = 3) -> DataFrame:
    """A row per query and identity: (q, q_owner, owner, best, best_id, mean, top_mean) of the similarities 1 - d/2.

    All templates of an identity are in one block, so a block's result is final; their number is bounded by the enrolment.
    """

    def found(q, g, d):
        s = np.round(np.maximum(1 - d / 2, 0), 12)
        for owner in np.unique(g[1]):
            at = np.flatnonzero(g[1] == owner)
            at = at[np.argsort(g[0][at])]
            mine = s[:, at]
            best = mine.argmax(1)
            high = -np.sort(-mine, axis=1)[:, :top]
            yield pa.RecordBatch.from_arrays([pa.array(q[0]), pa.array(q[1]), pa.array(np.full(len(d), owner)), pa.array(mine.max(1)), pa.array(g[0][at][best]), pa.array(mine.mean(1)), pa.array(high.mean(1))], ["q", "q_owner", "owner", "best", "best_id", "mean", "top_mean"])

    schema = "q long, q_owner long, owner long, best double, best_id long, mean double, top_mean double"
    return each(queries, templates, "owner", found, schema).select("q", "q_owner", "owner", "best", "mean", "top_mean", "best_id")
