"""Order, sampling and encoding helpers as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def argsort(v: Column) -> Column:
    """The positions (from 0) of an array's elements in ascending order; ties by position."""
    pairs = F.transform(v, lambda x, k: F.struct(x.alias("x"), k.alias("k")))
    return F.transform(F.array_sort(pairs), lambda p: p["k"])


def take(v: Column, order: Column) -> Column:
    """An array's elements in the given order of positions."""
    return F.transform(order, lambda k: F.element_at(v, k + 1))


def split_keeping_empty(text: Column, separators: str) -> Column:
    """Text split at any of some characters; empty parts stay, the last one too."""
    escaped = "".join("\\" + c if not c.isalnum() else c for c in separators)
    return F.split(text, f"[{escaped}]", -1)


def base100_id(text: Column, length: int = 4) -> Column:
    """A short id's first characters as one number, each a digit in base 100 (its code less 38)."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda k: F.ascii(F.substring(text, k, F.lit(1))) - 38)
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda s, d: s * 100 + d)


def sampled(df: DataFrame, by: str, item: str, size: int, seed: int) -> DataFrame:
    """At most ``size`` rows for each ``by``, those of smallest seeded hash; the same in each run."""
    order = Window.partitionBy(by).orderBy(F.xxhash64(by, item, F.lit(seed)), item)
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= size).drop("__r")
