"""One text of each group of near copies: SimHash and then parts of shingle sets find candidates, and whole sets decide."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.llm import anchors
from ridgeline.llm.common import sealed, spanning, staged, starts, utf8, whole_groups
from ridgeline.llm.components import components
from ridgeline.llm.simhash import near_links, packed_majority, shingle_hashes, word_hashes

BLOCK = 256  # texts of a group that meet in one unit of work, on each side


class Parts:
    """Sets of shingles cut into parts, so that any two sets of this similarity share a whole part, whatever differs.

    Sets are classed by size, and alike sets are of one class or of neighbouring ones; a set has signatures for its own class
    and for the next. Sizes n and m at this similarity differ in at most (n + m) * (1 - similarity) / (1 + similarity) shingles,
    and each of these spoils one part at most. A class has more parts than that, so the sets share all but so many of the
    larger set's filled parts. Small sets have a part for each shingle. For others shingles are dealt by hash, and there are
    so many parts that with a chance of about 1 in 10 million for 17 to 63 shingles, and far less beyond, too few are filled.
    """

    def __init__(self, similarity: float):
        self.similarity = similarity
        self.least = [1]  # the smallest size of each class: too large to be like that of the class before
        while self.least[-1] < 1 << 31:
            self.least.append(int(self.least[-1] / similarity + 1e-9) + 1)
        if len(self.least) > 1000:
            raise ValueError("a similarity so close to 1 has too many classes of sizes")

    def level(self, n: int) -> int:
        return bisect.bisect_right(self.least, n) - 1

    def number(self, level: int) -> int:
        """How many parts a class has; 0: one for each shingle."""
        most = self.least[level + 1] - 1
        if most <= 16 or self.similarity < 0.8:
            return 0
        spoilt = 2 * most * (1 - self.similarity) / (1 + self.similarity)
        return math.ceil(spoilt * (3 if most < 64 else 2.25 if most < 200 else 1.5 if most < 400 else 1.3))

    def signatures(self, sh: np.ndarray, level: int) -> np.ndarray:
        """A number for each filled part of a set of shingles, with the class in its upper ten bits."""
        number = self.number(level)
        h = anchors.mixed(sh * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level))
        if number:
            at = (anchors.mixed(h) % np.uint64(number)).astype(np.int64)
            held = np.zeros(number, np.uint64)
            np.add.at(held, at, h)
            filled = np.flatnonzero(np.bincount(at, minlength=number))
            h = anchors.mixed((held[filled] + filled.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93))
        return (np.uint64(level) << np.uint64(53) | h >> np.uint64(11)).view(np.int64)


def sketches(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(key, fp, s1, s2, n, level, here, above) of docs (key, text): fp is the SimHash of the set of words; s1 and s2 tell sets of
    shingles apart; n is the set's size, level its class, here and above its filled parts for that class and the next."""
    names = ["key", "fp", "s1", "s2", "n", "level", "here", "above"]

    def run(batches):
        parts = Parts(similarity)
        for b in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for text in b.column("text").to_pylist():
                sh = np.unique(shingle_hashes(text, width))
                s1, s2 = anchors.mixed(sh + np.uint64(1)), sh * np.uint64(0x9E3779B97F4A7C15) ^ (sh >> np.uint64(31))
                level = parts.level(len(sh)) if len(sh) else 0
                sums = (int(x.sum(dtype=np.uint64).view(np.int64)) for x in (s1, s2))
                found = (packed_majority(word_hashes(text)), *sums, len(sh), level, *(len(np.unique(parts.signatures(sh, x))) for x in (level, level + 1)))
                for c, v in zip(cols, found, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(c, pa.int64()) for c in cols)], names)

    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _shingles(members: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("group"), b.column("key"), pa.array(sets, pa.list_(pa.int64()))], ["group", "key", "sh"])

    return members.select("group", "key", "text").mapInArrow(run, "group long, key long, sh array<long>")


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets of numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def _pairs(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a left and a right set that are alike, by the counts of what they share."""
    values = np.concatenate(right)
    of = np.repeat(np.arange(len(right)), [len(x) for x in right])
    order = np.argsort(values, kind="stable")
    values, of = values[order], of[order]
    size = np.array([len(x) for x in right])
    a, b = [], []
    for i, x in enumerate(left):
        lo, hi = np.searchsorted(values, x), np.searchsorted(values, x, side="right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(of[at], minlength=len(right))
        hit = np.flatnonzero(both >= similarity * (len(x) + size - both) - 1e-9)
        a.append(np.full(len(hit), i))
        b.append(hit)
    return np.concatenate(a), np.concatenate(b)


def links(docs: DataFrame, width: int, similarity: float, radius: int) -> tuple[DataFrame, DataFrame]:
    """(classes, links): keys of texts with equal shingle sets have one class; links (a, b) connect classes as alike pairs do.

    First candidates are groups that SimHashes of radius or fewer differing bits connect. In a group each text is compared with
    its first text, and all alike are linked by that. Only what is unlike the first is compared with all others, in pairs
    of blocks, so a large group of copies of one text takes linear work. Pairs that SimHash leaves apart are then found
    by whole parts of their shingle sets.
    """
    drawn = staged(sketches(docs.select("key", "text"), width, similarity), "sketches")
    classes = drawn.groupBy("s1", "s2").agg(F.min("key").alias("class"), F.min("fp").alias("fp"))
    named = staged(drawn.join(classes.drop("fp"), ["s1", "s2"]).join(classes.select("class", F.col("fp").alias("least")), "class").select("key", "class", F.col("least").alias("fp"), "n", "level", "here", "above"), "classes")
    firsts = named.where("key = class").dropDuplicates(["key"]).drop("class")
    texts = docs.select("key", "text")
    found, groups = _links_of(firsts.select("key", "fp"), texts, width, similarity, radius)
    found = staged(found, "near")
    return named.select("key", "class"), found.unionByName(_links_left(firsts.drop("fp").join(groups, "key"), texts, found, width, similarity))


def _links_left(firsts: DataFrame, docs: DataFrame, found: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) that connect what found leaves apart, though alike; firsts: (key, n, level, here, above, group) of a text of each class.
    In a group all is compared already.

    Texts that share a part meet in its bucket. Each is first compared with the one that comes first in most of its buckets,
    which joins most of what is alike by linear work. Pairs that still are apart must share as many parts as the differing
    shingles of an alike pair leave whole, so one of them at least is among the rarest parts of each: only so many of a text's
    parts meet in their buckets as leave that number less one out, the most frequent ones. Those pairs' sets are compared.
    Parts are many rows a text, in small files, so they are never joined by broadcast.
    """

    def cut(batches):
        parts = Parts(similarity)
        for b in batches:
            keys, found = [], []
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                sh = np.unique(shingle_hashes(text, width))
                if len(sh):
                    level = parts.level(len(sh))
                    found += [np.unique(parts.signatures(sh, x)) for x in (level, level + 1)]
                    keys.append(np.full(len(found[-1]) + len(found[-2]), key))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64()), pa.array(np.concatenate(keys), pa.int64())], ["part", "key"])

    def shared(batches):
        for g in whole_groups(batches, ["part"]):
            edge = np.append(np.flatnonzero(starts(g["part"])), len(g["part"]))
            more = np.repeat(np.diff(edge) > 1, np.diff(edge))
            if more.any():
                yield pa.RecordBatch.from_arrays([pa.array(g["part"][more], pa.int64()), pa.array(g["key"][more], pa.int64())], ["part", "key"])

    once = docs.join(firsts.select("key"), "key", "left_semi").dropDuplicates(["key"]).select("key", "text")
    parts = once.mapInArrow(cut, "part long, key long").repartition("part").sortWithinPartitions("part", "key")
    buckets = staged(parts.mapInArrow(shared, "part long, key long"), "buckets")
    level = F.shiftrightunsigned("part", 53)
    parts_ = F.when(level == F.col("level"), F.col("here")).otherwise(F.col("above")).alias("parts")
    held = buckets.join(firsts.hint("merge"), "key").select("part", "key", "group", "n", level.alias("at"), (level == F.col("level")).alias("own"), parts_)
    several = held.groupBy("part").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.max("own").alias("any"), F.count("*").alias("size"), F.min_by(F.struct("key", "group"), "key").alias("lead")).where("lo != hi and any")
    held = staged(held.join(several.select("part", "lead", "size").hint("merge"), "part"), "held")
    pairs = held.where("group != lead.group").groupBy(F.col("key").alias("a"), F.col("lead.key").alias("b")).count().where("count >= 8")  # what shares less is left to the count of all pairs
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
    roots = components(found).withColumnRenamed("node", "key")
    of = staged(firsts.select("key").join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root")), "roots")
    apart = best.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").where("x != y").select("a", "b")
    first = staged(_alike_pairs(apart, docs, width, similarity), "first")
    roots = components(found.unionByName(first)).withColumnRenamed("node", "key")
    now = staged(firsts.select("key").join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root")), "roots")

    def meet(batches):
        for g in whole_groups(batches, ["part"]):
            part, group = starts(g["part"]), starts(g["part"], g["group"])
            ends = lambda new: np.append(np.flatnonzero(new)[1:], len(new))[np.cumsum(new) - 1]
            after = ends(group)  # each row meets those of the part's later groups
            number = ends(part) - after
            total = np.cumsum(number)
            for lo in range(0, int(total[-1]), 1 << 20):
                k = np.arange(lo, min(lo + (1 << 20), int(total[-1])))
                x = np.searchsorted(total, k, side="right")
                y = after[x] + k - (total[x] - number[x])
                n, m = np.minimum(g["n"][x], g["n"][y]), np.maximum(g["n"][x], g["n"][y])
                larger = np.where(g["n"][x] > g["n"][y], x, y)
                ok = (g["root"][x] != g["root"][y]) & g["own"].astype(bool)[larger] & (n >= similarity * m - 1e-9)
                if ok.any():
                    a, b = np.minimum(g["key"][x], g["key"][y])[ok], np.maximum(g["key"][x], g["key"][y])[ok]
                    once = np.unique(np.stack([a, b]).astype(np.int64), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(once[0]), pa.array(once[1])], ["a", "b"])

    spoilt = F.floor(F.col("n") * ((1 + 1 / similarity) * (1 - similarity) / (1 + similarity)) + 1e-6)  # at most, by any alike set
    mine = W.partitionBy("key", "at")
    rank, number = F.row_number().over(mine.orderBy("size", "part")), F.count("*").over(mine)
    rare = held.withColumn("rank", rank).withColumn("left", number - (F.col("parts") - spoilt)).where("rank <= left + 1 and left >= 0 or parts <= 0")
    rare = rare.join(now.hint("merge"), "key").select("part", "group", "key", "root", "n", "own").repartition("part").sortWithinPartitions("part", "group", "key")
    met = rare.mapInArrow(meet, "a long, b long").distinct()
    return first.unionByName(_alike_pairs(met, docs, width, similarity))


def _alike_pairs(pairs: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of keys of docs whose sets are alike."""
    pairs = staged(pairs, "pairs")
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = staged(_shingles(keys.join(docs.dropDuplicates(["key"]), "key").withColumn("group", F.lit(0).cast("long")), width), "shingles")

    def compared(batches):
        for b in batches:
            x, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            near = pa.array([alike(np.asarray(p), np.asarray(q)) >= similarity for p, q in zip(x, y, strict=True)], pa.bool_())
            yield b.select(["a", "b"]).filter(near)

    return pairs.join(sets.select(F.col("key").alias("a"), F.col("sh").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("sh").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(compared, "a long, b long")


def _links_of(firsts: DataFrame, docs: DataFrame, width: int, similarity: float, radius: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of the candidates that SimHash gives, and the group of each key; firsts: (key, fp) of a text of each class."""
    fps = firsts.groupBy("fp").agg(F.count("*").alias("same"))
    roots = components(near_links(staged(fps.select("fp"), "fps"), radius)).withColumnRenamed("node", "fp")
    every = staged(firsts.join(roots, "fp", "left").select("key", F.coalesce("root", "fp").alias("group")), "groups")
    grouped = staged(every.join(every.groupBy("group").agg(F.count("*").alias("n"), F.min("key").alias("first")).where("n > 1"), "group"), "groups")
    sets = staged(_shingles(grouped.select("group", "key").join(docs.select("key", "text"), "key"), width), "shingles")
    lead = sets.join(grouped.select("key", "first"), "key").where("key = first").select("group", F.col("key").alias("first"), F.col("sh").alias("lead"))

    def compared(batches):
        for b in batches:
            near = [alike(np.asarray(x), np.asarray(y)) >= similarity for x, y in zip(b.column("sh").to_numpy(zero_copy_only=False), b.column("lead").to_numpy(zero_copy_only=False), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("group"), b.column("key"), b.column("first"), pa.array(near, pa.bool_())], ["group", "key", "first", "near"])

    judged = staged(sets.join(lead, "group").select("group", "key", "first", "sh", "lead").mapInArrow(compared, "group long, key long, first long, near boolean"), "compared")
    far = judged.groupBy("group").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("m")).where("m > 0")
    blocks = far.select("group", F.ceil(F.col("m") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("n") / BLOCK).cast("int").alias("cols"))
    parted = sets.join(judged.select("key", "near"), "key").join(blocks, "group")
    mine = lambda n: F.expr(f"cast(pmod(xxhash64(key), `{n}`) as int)")
    left = parted.where("not near").select("group", mine("rows").alias("i"), F.explode(F.expr("sequence(0, cols - 1)")).alias("j"), F.lit(0).alias("side"), "key", "sh")
    right = parted.select("group", F.explode(F.expr("sequence(0, rows - 1)")).alias("i"), mine("cols").alias("j"), F.lit(1).alias("side"), "key", "sh")

    def verified(batches):
        for g in whole_groups(batches, ["group", "i", "j"]):
            edge = np.append(np.flatnonzero(np.append(True, (np.diff(g["group"]) != 0) | (np.diff(g["i"]) != 0) | (np.diff(g["j"]) != 0))), len(g["key"]))
            out_a, out_b = [], []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                cut = lo + int(np.searchsorted(g["side"][lo:hi], 1))
                if lo < cut < hi:
                    a, b = _pairs(list(g["sh"][lo:cut]), list(g["sh"][cut:hi]), similarity)
                    x, y = g["key"][lo:cut][a], g["key"][cut:hi][b]
                    x, y = spanning(x[x != y], y[x != y])
                    out_a.append(x)
                    out_b.append(y)
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a), pa.int64()), pa.array(np.concatenate(out_b), pa.int64())], ["a", "b"])

    units = left.unionByName(right).repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "side", "key")
    found = units.mapInArrow(verified, "a long, b long")
    direct = judged.where("near and key != first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    return found.unionByName(direct), every


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 7) -> DataFrame:
    """docs without near copies, columns as they are: of each group that chains of alike texts connect, the row of the
    smallest doc_id stays. Texts are alike if their sets of lower-cased shingles of width words have a Jaccard similarity of
    similarity or more, whatever differs (for the chance of a miss see Parts). Texts without words are alike. Null texts are empty; a null doc_id counts as smallest; of rows alike in doc_id
    and text one stays. No rows give no rows.
    """
    keyed, distinct = anchors.document_keys(sealed(docs, "doc_id", "text"))
    texts = distinct.select("key", utf8().alias("text"))
    classes, found = links(texts, width, similarity, radius)
    roots = staged(components(found), "roots").withColumnRenamed("node", "class")
    gone = classes.join(roots, "class", "left").where("root is not null or key != class").select("key")
    left = keyed.select("key", "row").join(gone, "key", "left_anti")
    repeated = keyed.groupBy("key").count().where("count > 1").limit(1).count() > 0
    return (left.dropDuplicates(["key"]) if repeated else left).select("row.*")
