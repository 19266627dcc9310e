"""Near-duplicate texts by SimHash and a generalised pigeonhole search."""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import arrow_map, spanning, staged, starts, utf8, whole_groups
from ridgeline.llm.components import components

BITS = 64
BUCKET = 2048  # a bucket of more fingerprints is split by further bits
_BIT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of width words of a text, repeats included; of all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    at = np.concatenate([[0], ends[:-width]])
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(at.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(at))


def word_hashes(text: bytes) -> np.ndarray:
    """XXH64 (seed 42) of each different word of a text, in no order."""
    words = set(text.lower().split())
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words))


def packed_majority(h: np.ndarray) -> int:
    """A signed 64-bit number whose bits are 1 where they are in over half of these; 0 for none."""
    if not len(h):
        return 0
    at = h.astype("<u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    ones = (np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BIT).ravel()
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, width: int = 3) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half the shingles; 0 without words."""
    return packed_majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of each row. Only doc_id and text are read, so other columns can't clash; a null text is empty."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, width) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), utf8().alias("text")), rows, "doc_id long, fp long")


def bit_statistics(classes: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, share of ones of each bit, correlation of each two bits), summed over all fingerprints; 64 rows reach the driver."""

    def rows(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            x = np.unpackbits(b.column("fp").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(x), both + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([both.ravel().tolist()])], ["n", "both"])

    part = classes.select("fp").mapInArrow(rows, "n long, both array<double>")
    flat = part.select("n", F.posexplode("both").alias("at", "v")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    got = flat.orderBy("at").collect()
    if not got or not got[0]["n"]:
        return 0, np.full(BITS, 0.5), np.eye(BITS)
    n = got[0]["n"]
    both = np.array([r["v"] for r in got]).reshape(BITS, BITS) / n
    p = both.diagonal()
    s = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return n, p, (both - np.outer(p, p)) / np.outer(s, s)


def correlated_groups(bits: list[int], corr: np.ndarray, m: int) -> list[list[int]]:
    """bits in m groups of even size; each group grows by the bit that is most correlated with it."""
    left, out = sorted(bits), []
    for i in range(m):
        size = len(left) // (m - i)
        group = [left.pop(0)] if left else []
        while len(group) < size:
            best = max(left, key=lambda b: (float(np.abs(corr[b, group]).mean()), -b))
            left.remove(best)
            group.append(best)
        out.append(group)
    return out


def covering_masks(bits: list[int], radius: int, n: float, p: np.ndarray, corr: np.ndarray) -> list[int]:
    """Masks of which any two fingerprints within radius on these bits agree on one.

    Bits are grouped into m partitions, and radius + 1 units are dealt to them: a partition of u units is searched
    within u - 1 differing bits, by one mask for each choice of u - 1 bits left out. Fewer than one unit too few must
    differ somewhere, so one partition always finds the pair. A dynamic programme deals the units, and picks m, for the
    least probes plus estimated candidates, from the share of ones of each bit over all fingerprints.
    """
    agree = 1 - 2 * p * (1 - p)
    best: tuple[float, list[list[int]], list[int]] | None = None
    for m in range(1, min(len(bits), 2 * radius + 2) + 1):
        groups = correlated_groups(bits, corr, m)
        cost = [[0.0] * (radius + 2) for _ in groups]
        for i, g in enumerate(groups):
            alike = float(np.prod(agree[g]))
            for u in range(1, radius + 2):
                masks = comb(len(g), u - 1) if u - 1 <= len(g) else np.inf
                each = alike / float(np.mean(agree[g])) ** (u - 1)
                cost[i][u] = masks * (n + n * n / 2 * each)
        table = [[0.0] + [np.inf] * (radius + 1)]
        for c in cost:
            table.append([min(table[-1][k - u] + c[u] for u in range(k + 1)) for k in range(radius + 2)])
        if best is not None and table[-1][-1] >= best[0]:
            continue
        k, units = radius + 1, []
        for i in range(len(groups) - 1, -1, -1):
            units.append(min(range(k + 1), key=lambda u: table[i][k - u] + cost[i][u]))  # noqa: B023
            k -= units[-1]
        best = table[-1][-1], groups, units[::-1]
    masks = []
    for g, u in zip(*best[1:], strict=True):
        if u:
            whole = sum(1 << b for b in g)
            masks += [whole - sum(1 << b for b in out) for out in combinations(g, u - 1)]
    return sorted(masks)


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(classes: DataFrame, radius: int) -> DataFrame:
    """(a, b): stars that connect distinct fingerprints exactly as links of radius or fewer differing bits do.

    Each fingerprint goes to a bucket per covering mask. A bucket of over 2048 fingerprints is searched again by the same
    pigeonhole on its free bits, until so few bits are free that no bucket can be larger; so no group of like
    fingerprints meets whole in one task. Buckets are verified by population counts and give a star per component.
    Buckets meet their counts in a merge join: Spark takes what explode makes of the fingerprints for small, and would collect
    it, a row for each mask, to be broadcast.
    """
    n, p, corr = bit_statistics(classes)
    level = {m: [m] for m in covering_masks(list(range(BITS)), radius, max(n, 1), p, corr)}
    rows = classes.select("fp", F.explode(F.array(*[F.lit(_long(m)) for m in level])).alias("mask"))
    found = None
    while True:
        keyed = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        counts = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        keyed = staged(keyed.join(counts.hint("merge"), ["mask", "key"]), "buckets")
        small = _verified(keyed.where(F.col("n") <= BUCKET), radius)
        found = small if found is None else found.union(small)
        over = {r["mask"] for r in keyed.where(F.col("n") > BUCKET).select("mask").distinct().collect()}  # masks of this level only
        if not over:
            return found
        child = {}
        for mask in over:
            free = [b for b in range(BITS) if not mask >> b & 1]
            child[mask] = [_long((mask & (2**64 - 1)) | m) for m in covering_masks(free, radius, BUCKET, p, corr)]
        lookup = F.create_map(*[x for m, c in child.items() for x in (F.lit(m), F.array(*[F.lit(v) for v in c]))])
        rows = keyed.where(F.col("n") > BUCKET).select("fp", F.explode(lookup[F.col("mask")]).alias("mask")).distinct()


def _verified(keyed: DataFrame, radius: int) -> DataFrame:
    def pairs(mask, key, fp):
        """Links that connect rows as all links within the groups do, comparing each row with those d places on while any group
        is that long. Links are reduced to stars whenever they are many, so a dense bucket needs little memory."""
        at, d, a, b, held = np.arange(len(fp)), 1, [], [], 0
        while True:
            at = at[at + d < len(fp)]
            at = at[(key[at] == key[at + d]) & (mask[at] == mask[at + d])]
            if not len(at):
                break
            hit = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= radius]
            a.append(hit)
            b.append(hit + d)
            held += len(hit)
            if held > 200_000:
                x, y = spanning(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], len(x)
            d += 1
        none = np.empty(0, np.int64)
        return np.concatenate([none, *a]), np.concatenate([none, *b])

    def run(batches):
        for g in whole_groups(batches, ["mask", "key"]):
            mask, key, fp = g["mask"], g["key"], g["fp"]
            edges = np.append(np.flatnonzero(starts(mask, key)), len(fp))
            work = np.cumsum(np.diff(edges) ** 2)
            at = 0
            while at < len(edges) - 1:  # so many groups at a time that their pairs fit in memory
                to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + 4_000_000)))
                part = slice(edges[at], edges[to])
                x, y = pairs(mask[part], key[part], fp[part].astype(np.int64))
                a, b = spanning(fp[part][x], fp[part][y])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                at = to

    dealt = keyed.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    fp: the SimHash of the lower-cased text's shingles of width words. Texts link at radius or fewer differing bits;
    component_id is the smallest doc_id reachable, itself included. Null and empty texts have fingerprint 0 and link like
    any other. Repeated rows stay repeated; a null doc_id takes part, but is no component_id unless all are null.
    No rows give no rows.
    """
    fps = staged(fingerprints(docs, width), "fps")
    classes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = staged(components(near_links(classes, radius)).withColumnRenamed("node", "fp"), "roots")
    named = classes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    found = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fps.join(found, "fp").select("doc_id", "fp", "component_id")
