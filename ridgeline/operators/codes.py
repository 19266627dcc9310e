"""Binary codes of vectors: Walsh-Hadamard transform, signs, Hamming distance and bit statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coefficients(vectors: DataFrame, size: int) -> DataFrame:
    """(id, w): the unnormalised Walsh-Hadamard transform (Sylvester order) of each v, one projection per butterfly level so that no level is evaluated twice."""
    if size < 2 or size & (size - 1):
        raise ValueError("the length must be a power of two, 2 or more")
    df, h = vectors.select("id", F.col("v").alias("w")), 1
    while h < size:
        df = df.select("id", _butterfly(F.col("w"), h).alias("w"))
        h *= 2
    return df


def _butterfly(w: Column, h: int) -> Column:
    return F.transform(w, lambda x, i: F.when(i.bitwiseAND(F.lit(h)) == 0, x + w[i + h]).otherwise(w[i - h] - x))


def packed_bytes(bits: Column, size: int) -> Column:
    """0/1 values as bytes 0..255, the first value in the lowest bit; zeros fill the last byte."""
    return F.transform(F.sequence(F.lit(0), F.lit((size - 1) // 8)), lambda j: F.aggregate(F.slice(bits, j * 8 + 1, 8), F.struct(F.lit(0).alias("x"), F.lit(1).alias("m")), lambda a, b: F.struct((a["x"] + b * a["m"]).alias("x"), (a["m"] * 2).alias("m")))["x"])


def signs(v: Column) -> Column:
    """1 where a value is 0 or more, else 0."""
    return F.transform(v, lambda x: F.when(x >= 0, 1).otherwise(0))


def bit_statistics(bits: DataFrame) -> DataFrame:
    """Over rows with an array bits: mean share of ones, mean distance of that share from a half, and share of constant bits."""
    by = bits.select(F.posexplode("bits").alias("bit", "b")).groupBy("bit").agg(F.avg("b").alias("p"))
    return by.agg(F.round(F.avg("p"), 6).alias("one_fraction"), F.round(F.avg(F.abs(F.col("p") - 0.5)), 6).alias("balance_error"), F.round(F.avg(F.col("p").isin(0.0, 1.0).cast("double")), 6).alias("constant_ratio"))
