"""Mixing sources to target weights, by exact block quotas split among output shards. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.llm.common import WORD, sealed, staged

BLOCK_DIGITS = 2  # a source's documents fall into 16**2 blocks by the first hex digits of their keys
PART_DIGITS = 4  # the block in which the last reading ends is cut in 16**4 parts by the next ones


def _key(*parts) -> Column:
    """A repeatable random key of a row: md5 of its parts."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def _uniform(*parts) -> Column:
    """A repeatable number in [0, 1)."""
    return F.conv(F.substring(_key(*parts), 1, 13), 16, 10).cast("double") / float(16**13)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def hypergeometric(u: Column, good: Column, bad: Column, draws: Column) -> Column:
    """How many of draws, taken without return from good + bad items, are good: the inverse of the distribution at u.

    Log-weights follow from the ratio of neighbours; one pass lists them, one finds the quantile.
    """

    def inverse(x: Column) -> Column:
        low, high = F.greatest(F.lit(0).cast("long"), x["draws"] - x["bad"]), F.least(x["draws"], x["good"])
        ratio = lambda k: F.log((x["good"] - k + 1) * (x["draws"] - k + 1) / (k * (x["bad"] - x["draws"] + k)).cast("double"))
        logs = F.transform(F.sequence(low, high), lambda k: F.when(k == low, 0.0).otherwise(ratio(k)))
        pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
        top = F.aggregate(logs, pair(F.lit(0.0), F.lit(0.0)), lambda a, r: pair(a["a"] + r, F.greatest(a["b"], a["a"] + r)))["b"]
        total = lambda m: F.aggregate(logs, pair(F.lit(0.0), F.lit(0.0)), lambda a, r: pair(a["a"] + r, a["b"] + F.exp(a["a"] + r - m)))["b"]
        state = lambda a, b, n: F.struct(a.alias("a"), b.alias("b"), n.alias("n"))
        walk = lambda goal, m: F.aggregate(logs, state(F.lit(0.0), F.lit(0.0), low), lambda a, r: state(a["a"] + r, a["b"] + F.exp(a["a"] + r - m), F.when(a["b"] + F.exp(a["a"] + r - m) <= goal, F.least(a["n"] + 1, high)).otherwise(a["n"])))["n"]
        return _let(top, lambda m: _let(total(m) * x["u"], lambda goal: walk(goal, m)))

    return _let(F.struct(u.alias("u"), good.alias("good"), bad.alias("bad"), draws.alias("draws")), inverse)


def targets(sized: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) of each source: share of all sizes dealt by weight; a target stops at cap times its
    source's size and the excess is dealt anew by weight until none is above.

    One row a source, all of them in one window: for a recipe of thousands of sources, not for millions of hosts. Without rows
    there is no source. Sources by code point, null last, take the weights in turn. Ordered by cap / weight, the level at which no more
    sources fill up is the largest of (what is left) / (weights left), so no loop is needed.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (order % len(weights) + 1).cast("int")).cast("double"))
    by = by.withColumn("most", F.col("source_size") * float(cap))
    every = W.partitionBy(F.lit(1))
    rank = W.partitionBy(F.lit(1)).orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(rank), F.lit(0.0))
    by = by.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(rank), F.lit(0.0))))
    return by.select("source", "source_size", F.least("most", F.max("level").over(every) * F.col("weight")).alias("target"))


def shard_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, shard, start, n): how many of a source's permuted blocks go to each shard, and from which place on.

    A tree of halvings: each node gives half of its blocks to the left, and the number from each source is a multivariate
    hypergeometric draw, one source after another. Only counts move: a node is one row with a count for each source of the
    recipe. shards is a power of two. A source without blocks gets none anywhere; no rows give no rows.
    """
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", "source", "blocks"))).alias("q")).select(F.lit(0).alias("node"), "q")
    level = 1
    while level < shards:
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["blocks"])
        first = F.struct(F.expr("cast(array() as array<bigint>)").alias("left"), total.alias("rest"), F.floor((total + 1) / 2).cast("long").alias("draws"))

        u = lambda x, at=level: _uniform(seed, at, F.col("node"), x["rank"])

        def draw(a, x):
            n = hypergeometric(u(x), x["blocks"], a["rest"] - x["blocks"], a["draws"])
            return _let(n, lambda n: F.struct(F.concat(a["left"], F.array(n)).alias("left"), (a["rest"] - x["blocks"]).alias("rest"), (a["draws"] - n).alias("draws")))

        node = node.withColumn("left", F.aggregate("q", first, draw)["left"])
        half = lambda left: F.zip_with("q", "left", lambda x, n: F.struct(x["rank"].alias("rank"), x["source"].alias("source"), (n if left else x["blocks"] - n).alias("blocks")))
        node = node.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), half(True).alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), half(False).alias("q")))).alias("x")).select("x.*")
        level *= 2
    each = node.select(F.col("node").alias("shard"), F.explode("q").alias("x")).select("shard", "x.source", F.col("x.blocks").alias("n"))
    before = W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return each.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, shards: int = 16, seed: int = 11) -> DataFrame:
    """Each row's part in the mix: (doc_id, source, key, size, source_size, target, taken, draws).

    size: words of the text (null: 0). A source's documents are permuted by md5 of seed and doc_id and fall into blocks in
    that order. A source is read whole target / size times, then in order up to the target's rounded rest: the document in
    which the rest ends gives its leading words only. So many blocks are a source's quota; the splitting tree deals the quotas
    to the shards, and a shard draws the blocks at its places in the source's permuted list, which no other shard has.
    draws lists a document's (shard, words) from these blocks, and taken is their sum, so each source's taken words equal
    its rounded target. A document is drawn at most ceil(cap) times and gives at most cap times its size. Rows of equal
    doc_id take places next to each other (ties by size, equal rows arbitrarily); null doc_ids and null sources are values of
    their own. Sources without words get target 0. No rows give no rows.
    """
    named = docs.select(F.col("doc_id").cast("long"), F.col("doc_id").cast("long").alias("id"), "text", F.col("source").cast("string"))
    return _mixed(named, weights, share, cap, shards, seed).drop("id")


def _mixed(docs: DataFrame, weights, share: float, cap: float, shards: int, seed: int) -> DataFrame:
    """mix of docs (id, doc_id, text, source), with the column id kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("id", "doc_id", "source", F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("size"))
    docs = docs.withColumn("key", _key(seed, F.col("doc_id")))
    sized = staged(docs.withColumn("block", F.conv(F.substring("key", 1, BLOCK_DIGITS), 16, 10).cast("int")), "sized")
    goal = targets(sized, list(weights), share, cap)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = staged(goal.withColumn("rest", (F.round("target") - F.col("whole") * F.col("source_size")).cast("long")), "goal")
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    blocks = sized.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("block_size").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.alias("b").join(goal.alias("g"), same("b", "g")).select("b.*", "source_size", "target", "whole", "rest")
    partly = F.col("before") < F.col("rest")
    reads = F.col("whole") + F.when(partly, 1).otherwise(0)
    blocks = staged(blocks.withColumn("reads", reads.cast("long")).withColumn("cut", partly & (F.col("before") + F.col("block_size") > F.col("rest"))), "blocks")
    drawn = drawn_blocks(blocks, shards, seed).groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("reading", "shard"))).alias("to"))
    blocks = staged(blocks.alias("b").join(drawn.alias("d"), same("b", "d") & (F.col("b.block") == F.col("d.block")), "left").select("b.*", "to"), "drawn")
    rows = sized.alias("s").join(blocks.alias("b"), same("s", "b") & (F.col("s.block") == F.col("b.block"))).select("s.id", "s.doc_id", "s.source", "key", "size", "b.block", "source_size", "target", "whole", "before", "rest", "cut", "to", "reads")
    inner = rows.where("cut").withColumn("part", F.conv(F.substring("key", BLOCK_DIGITS + 1, PART_DIGITS), 16, 10).cast("int"))
    parts = inner.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    parts = parts.withColumn("part_before", F.coalesce(F.sum("part_size").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = inner.alias("c").join(parts.alias("p"), same("c", "p") & (F.col("c.part") == F.col("p.part"))).select("c.*", "part_size", (F.col("rest") - F.col("before") - F.col("part_before")).alias("room"))
    ends_here = (F.col("room") > 0) & (F.col("room") < F.col("part_size"))
    in_part = W.partitionBy("source", "part").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    inside = F.least(F.greatest(F.col("room") - F.coalesce(F.sum("size").over(in_part), F.lit(0)), F.lit(0)), F.col("size"))
    ending = inner.where(ends_here).withColumn("last", inside)
    others = inner.where(~ends_here).withColumn("last", F.when(F.col("room") > 0, F.col("size")).otherwise(0))
    rest = rows.where("not cut").withColumn("last", F.when(F.col("reads") > F.col("whole"), F.col("size")).otherwise(0))
    out = ending.unionByName(others).drop("part", "part_size", "room").unionByName(rest)
    draws = F.transform(F.coalesce("to", F.expr("cast(array() as array<struct<reading:bigint,shard:int>>)")), lambda x: F.struct(x["shard"].alias("shard"), F.when(x["reading"] <= F.col("whole"), F.col("size")).otherwise(F.col("last")).cast("long").alias("words")))
    out = out.withColumn("draws", F.filter(draws, lambda x: x["words"] > 0))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return out.select("id", "doc_id", "source", "key", "size", F.col("source_size").cast("long"), F.col("target").cast("double"), taken.alias("taken"), "draws")


def drawn_blocks(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, block, reading, shard) of each reading of each block (source, block, reads): a source's readings are permuted, and
    each shard draws those at the places that the splitting tree gives it."""
    same = F.col("b.source").eqNullSafe(F.col("d.source"))
    quotas = blocks.groupBy("source").agg(F.sum("reads").alias("blocks"))
    dealt = shard_quotas(quotas.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))), shards, seed)
    place = F.row_number().over(W.partitionBy("source").orderBy(_key(seed, "place", F.col("reading"), F.col("block")))) - 1
    readings = blocks.where("reads > 0").withColumn("reading", F.explode(F.sequence(F.lit(1).cast("long"), "reads"))).select("source", "block", "reading").withColumn("place", place)
    found = readings.alias("b").join(dealt.alias("d"), same & (F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("n")))
    return found.select("b.source", "block", "reading", "shard")


def drawn_rows(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, shards: int = 16, seed: int = 11) -> DataFrame:
    """(shard, at, row, part, new) of each draw of a row of docs (doc_id, text, source and others): its columns as the struct row, the
    text cut to the words drawn, whether it is cut, and its place at in the shard's own shuffle. Rows alike in doc_id
    are drawn each for itself; null and empty texts, which have no words, are never drawn."""
    keyed = sealed(docs, "doc_id", "text", "source")
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        keyed = staged(keyed.withColumn("id", F.monotonically_increasing_id()), "rows")  # numbered once
    else:
        keyed = keyed.withColumn("id", F.col("doc_id").cast("long"))
    plan = _mixed(keyed.select("id", F.col("doc_id").cast("long"), "text", F.col("source").cast("string")), weights, share, cap, shards, seed)
    draws = plan.select("id", "size", F.posexplode("draws").alias("copy", "d"))
    rows = keyed.select("id", "row").join(draws, "id")
    part = F.col("d.words") < F.col("size")
    new = F.when(part, _leading(F.col("row.text"), F.col("d.words"))).otherwise(F.col("row.text"))
    return rows.select("d.shard", _key(seed, F.col("d.shard"), F.col("copy"), F.col("id")).alias("at"), "row", part.alias("part"), new.alias("new"))


def mixed_rows(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, shards: int = 16, seed: int = 11) -> DataFrame:
    """docs, columns as they are, with a row for each draw of a row by mix, its text cut to the words drawn (n_chars, if there, is
    counted anew), dealt by shard and shuffled within it. Rows that the mix doesn't draw, such as null and empty texts, are left
    out; repeated rows are drawn each for itself. No rows give no rows."""
    rows = _shuffled(drawn_rows(docs, weights, share, cap, shards, seed))
    return rows.select(*_columns(docs))


def _shuffled(rows: DataFrame) -> DataFrame:
    """Rows by shard, in tasks of a part of a shard each, and in random order within a shard."""
    return rows.repartition("shard", F.substring("at", 1, 2)).sortWithinPartitions("shard", "at")


def _columns(docs: DataFrame) -> list[Column]:
    made = {"text": F.col("new"), "n_chars": F.when(F.col("part"), F.length("new")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None)).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return [(made[c] if c in made else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]


def write_shards(docs: DataFrame, path: str, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, shards: int = 16, seed: int = 11) -> None:
    """The rows of mixed_rows as a table at path, one folder (shard=...) for each shard; docs has no column shard."""
    rows = _shuffled(drawn_rows(docs, weights, share, cap, shards, seed))
    rows.select("shard", *_columns(docs)).write.partitionBy("shard").parquet(path)


def _leading(text: Column, words: Column) -> Column:
    """A text up to the end of its first so many words; the whole text, white space included, if it has no more words."""
    found = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    return F.when(F.size(found) <= words, text).otherwise(F.array_join(F.slice(found, 1, words.cast("int")), ""))
