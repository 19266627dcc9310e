"""Expressions on arrays of numbers: normalisation, statistics of patches, bits in bytes; and on measures of a run."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once for a row. A lambda that holds it as an expression works it out for each element."""
    return F.transform(F.array(value), use)[0]


def unit(v: Column, least: float = 1e-12) -> Column:
    """The vector at length 1; divided by `least` if it is shorter."""
    norm = F.sqrt(total(F.transform(v, lambda x: x * x)))
    return once(F.greatest(norm, F.lit(least)), lambda n: F.transform(v, lambda x: x / n))


def rootsift(v: Column) -> Column:
    """Values from 0 on as shares of their sum, their roots, at length 1."""
    shares = once(total(v) + 1e-12, lambda n: F.transform(v, lambda x: F.sqrt(x / n)))
    return once(shares, lambda r: once(F.sqrt(total(F.transform(r, lambda y: y * y))) + 1e-12, lambda n: F.transform(r, lambda x: x / n)))


def mean_std(v: Column) -> tuple[Column, Column]:
    """The mean and the population's standard deviation of an array; null without values."""
    n = F.nullif(F.size(v), F.lit(0))
    mean = total(v) / n
    return mean, F.sqrt(F.greatest(total(F.transform(v, lambda x: x * x)) / n - mean * mean, F.lit(0.0)))


def standardised(v: Column) -> Column:
    """Values less their mean, by their standard deviation, 1e-6 at least."""
    mean, std = mean_std(v)
    return once(F.struct(mean.alias("mean"), F.greatest(std, F.lit(1e-6)).alias("std")), lambda s: F.transform(v, lambda x: (x - s["mean"]) / s["std"]))


def share_above(v: Column, threshold: float) -> Column:
    """The share of values above the threshold, which is what a patch shows of its motif; the others are blank."""
    return F.size(F.filter(v, lambda x: x > threshold)) / F.nullif(F.size(v), F.lit(0))


def bits_of(v: Column, zero_is_one: bool = True) -> Column:
    """1 for values above 0, and for 0 itself as told; else 0."""
    return F.transform(v, lambda x: (x >= 0 if zero_is_one else x > 0).cast("int"))


def packed(bits: Column, size: int, order: str = "little") -> Column:
    """Bits as bytes from 0 to 255, the first bit of eight in the lowest place (little) or the highest (big); zeros fill the last byte."""
    if order not in ("little", "big"):
        raise ValueError(f"unknown bit order {order!r}")
    place = lambda i: F.pow(F.lit(2.0), i if order == "little" else 7 - i).cast("int")
    byte = lambda j: F.aggregate(F.transform(F.slice(bits, j * 8 + 1, 8), lambda b, i: b * place(i)), F.lit(0), lambda a, x: a + x)
    return F.transform(F.sequence(F.lit(0), F.lit((size - 1) // 8)), byte)


def transform_id(name: str, order: int, bits: str, zero_is_one: bool) -> str:
    """A name for a transform of this length, bit order and sign of zero: equal settings, equal name. The layout of what is hashed is fixed."""
    told = name.encode() + struct.pack("<q", order) + bits.encode() + (b"1" if zero_is_one else b"0")
    return f"{name}-{hashlib.sha256(told).hexdigest()[:24]}"


def core_time(whole: Column, *excluded: Column) -> Column:
    """What is left of a time without the parts that don't count, 0 at least; null parts take nothing."""
    left = whole
    for x in excluded:
        left = left - F.coalesce(x, F.lit(0.0))
    return F.greatest(F.lit(0.0), left)


#: What a checkpoint's measures weigh.
CHECKPOINT = {"loss": 0.30, "gap": 0.20, "fpr": 0.35, "p95": 0.15}


def checkpoint_score(loss: Column, pos_mean: Column, neg_mean: Column, fpr: Column, pos_p95: Column, cap: float = 2.0, margin: float = 1.0) -> Column:
    """The weighted share of what a checkpoint could reach, from 0 to 1; cap: the largest distance. Measures that are missing or not finite count as 0."""
    inside = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    parts = {"loss": ([loss], 1 - inside(loss / (cap + margin))), "gap": ([pos_mean, neg_mean], inside((neg_mean - pos_mean) / cap)), "fpr": ([fpr], 1 - inside(fpr)), "p95": ([pos_p95], 1 - inside(pos_p95 / cap))}
    score = F.lit(0.0)
    for name, weight in CHECKPOINT.items():
        needed, value = parts[name]
        known = F.lit(True)
        for x in needed:
            known = known & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        score = score + weight * F.when(known, value).otherwise(0.0)
    return score
