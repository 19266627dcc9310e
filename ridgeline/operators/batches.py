"""Training and validation batches as tables: owners and pairs by cyclic shuffles, quotas, distinct points, all by a seed."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.operators.numbering import dense_numbers
from ridgeline.sources.tables import written

WARN_SLOTS, MOST_SLOTS = 100_000, 10_000_000  # fixed values


def shuffled(*parts: Column | int | str) -> Column:
    """The key of a seeded shuffle."""
    return F.md5(F.concat_ws("|", *[(x if isinstance(x, Column) else F.lit(x)).cast("string") for x in parts]))


def cyclic_pairs(pairs: DataFrame, batches: int, seed: int) -> DataFrame:
    """(batch, owner, pair): each owner's pairs in seeded order, all of them once before any comes again in a new order.

    pairs: (owner, pair), each once. An owner of more pairs than batches is cut to the first of its order before the shuffle.
    """
    c = F.col
    n = pairs.groupBy("owner").agg(F.count("*").alias("n"))
    cycles = pairs.join(n, "owner").withColumn("cycle", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((batches - 1) / c("n")))))
    place = F.row_number().over(W.partitionBy("owner", "cycle").orderBy(shuffled(seed, c("cycle"), c("owner"), c("pair")), "pair"))
    return cycles.withColumn("place", place).where(c("place") <= batches).withColumn("batch", c("cycle") * c("n") + c("place") - 1).where(c("batch") < batches).select("batch", "owner", "pair")


def cyclic_owners(owners: DataFrame, batches: int, count: int, seed: int) -> DataFrame:
    """(batch, owner): `count` different owners a batch. A shuffle of all owners is cut into batches, then the next; those left at
    its end, fewer than count, wait for another. All shuffles are numbered in one pass."""
    c = F.col
    n = owners.count()
    each = n // count
    if not each:
        raise ValueError(f"{count} owners a batch are asked for, there are {n}")
    rows = owners.select("owner", F.explode(F.sequence(F.lit(0), F.lit(-(-batches // each) - 1))).alias("cycle"))
    placed = dense_numbers(rows.withColumn("k", shuffled(seed, c("cycle"), c("owner"))), ["cycle", "k", "owner"], "at").withColumn("at", c("at") - c("cycle") * n)
    return placed.where(c("at") < each * count).select((F.floor(c("at") / count) + c("cycle") * each).alias("batch"), "owner").where(c("batch") < batches)


def random_pairs(scheduled: DataFrame, pairs: DataFrame, seed: int) -> DataFrame:
    """(batch, owner, pair): for each scheduled (batch, owner) one of the owner's pairs, by a seeded hash."""
    drawn = scheduled.join(pairs, "owner").groupBy("batch", "owner")
    return drawn.agg(F.min_by("pair", F.struct(shuffled(seed, F.col("batch"), F.col("owner"), F.col("pair")), "pair")).alias("pair"))


def filled(scheduled: DataFrame, records: DataFrame, batch_size: int, owners: int, seed: int) -> DataFrame:
    """(batch, place, owner, pair, point, id, again) of batches of batch_size records, from each scheduled (batch, owner, pair).

    Each owner of a batch gives batch_size div owners records, and one more where its seeded rank in the batch is within the
    rest. A pair's records are shuffled by seed and batch; of each point the first counts; a pair of too few points gives its
    own again, in turn (again). Only as many as are needed of a pair leave their task. Places shuffle the batch.
    """
    c = F.col
    base, rest = divmod(batch_size, owners)
    rank = F.row_number().over(W.partitionBy("batch").orderBy(shuffled(seed, c("batch"), c("owner")), "owner"))
    quota = scheduled.withColumn("quota", F.lit(base) + F.when(rank <= rest, 1).otherwise(0))
    met = quota.join(records.select("owner", "pair", "point", "id"), ["owner", "pair"]).withColumn("k", shuffled(seed, c("batch"), c("id")))
    one = met.groupBy("batch", "owner", "pair", "point", "quota").agg(F.min(F.struct("k", "id")).alias("r"))
    chosen = one.withColumn("i", F.row_number().over(W.partitionBy("batch", "owner", "pair").orderBy("r", "point")) - 1).where(c("i") < base + 1).where(c("i") < c("quota"))
    m = F.count("*").over(W.partitionBy("batch", "owner", "pair"))
    slots = chosen.withColumn("m", m).withColumn("slot", F.explode(F.sequence(c("i").cast("long"), (c("quota") - 1).cast("long"), c("m"))))
    place = F.row_number().over(W.partitionBy("batch").orderBy(shuffled(seed, c("batch"), c("owner"), c("slot")), "owner", "slot")) - 1
    return slots.select("batch", place.alias("place"), "owner", "pair", "point", c("r.id").alias("id"), (c("slot") >= c("m")).alias("again"))


def training_batches(records: DataFrame, batch_size: int, owners: int, batches: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """An epoch's batches (see filled) of records (owner, pair, point, id): different owners, one random pair of each. Other epochs
    have other batches. Rows with a null are left out; fewer owners than a batch takes are an error."""
    if not 1 <= owners <= batch_size:
        raise ValueError("owners must be from 1 to batch_size")
    records = records.dropna(subset=["owner", "pair", "point", "id"])
    pairs = written(records.select("owner", "pair").distinct(), "pairs")
    scheduled = cyclic_owners(pairs.select("owner").distinct(), batches, owners, seed + epoch)
    return filled(random_pairs(scheduled, pairs, seed + epoch), records, batch_size, owners, seed + epoch)


def validation_batches(records: DataFrame, batch_size: int, batches: int, owners: int | str = "auto", seed: int = 42) -> DataFrame:
    """Fixed batches (see filled) of records (owner, pair, point, id): the same owners in each, their pairs in cyclic shuffles (see cyclic_pairs).

    Refused before any row is made: fewer than one batch or two records a batch, more than MOST_SLOTS records in all (over
    WARN_SLOTS warns), more owners than there are or than a batch has records. owners "auto": as many as both allow. The plan
    is written once; what is returned reads it.
    """
    if batches < 1 or batch_size < 2:
        raise ValueError("a plan needs one batch or more, of two records or more")
    if batches * batch_size > MOST_SLOTS:
        raise ValueError(f"{batches * batch_size} records are planned; {MOST_SLOTS} is the limit")
    if batches * batch_size > WARN_SLOTS:
        warnings.warn(f"{batches * batch_size} records are planned; time grows with them", RuntimeWarning, stacklevel=2)
    if owners != "auto" and not 1 <= int(owners) <= batch_size:
        raise ValueError("owners must be from 1 to batch_size, or auto")
    records = records.dropna(subset=["owner", "pair", "point", "id"])
    pairs = written(records.select("owner", "pair").distinct(), "pairs")
    there = pairs.select("owner").distinct()
    n = there.count()
    count = min(n, batch_size) if owners == "auto" else int(owners)
    if not n or count > n:
        raise ValueError(f"{count} owners are asked for, there are {n}")
    chosen = there.orderBy(shuffled(seed, F.col("owner")), "owner").limit(count)  # batch_size at most
    scheduled = cyclic_pairs(pairs.join(chosen, "owner", "left_semi"), batches, seed)
    return written(filled(scheduled, records, batch_size, count, seed), "validation_plan")
