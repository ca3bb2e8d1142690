"""Search keys: dense positions in key order, and key ranges as position ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut


def rank(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``pos``, its row number (from 0) in the order of some columns.

    The rows are dealt by ranges of the order, numbered within each partition, and shifted by the sizes
    of the partitions before; only those sizes meet in one place.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")  # one column, so that columns may have any names
    dealt = cut(df.repartitionByRange(parts, *order).select(row, F.spark_partition_id().alias("part")))
    within = Window.partitionBy("part").orderBy(*[f"row.{c}" for c in order])
    sizes = dealt.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    numbered = dealt.withColumn("number", F.row_number().over(within)).join(F.broadcast(shift), "part")  # a row a partition
    return numbered.select(*[F.col(f"row.`{c}`") for c in df.columns if c != "pos"], (F.col("number") - 1 + F.col("shift")).cast("bigint").alias("pos"))


def vectors(df: DataFrame, key: str, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """pos, id, search_key, embedding: the vectors in the order of their key, ties by id; null keys first. A vector that cannot be compared keeps its position."""
    named = df.select(F.col(id).cast("bigint").alias("id"), F.col(key).alias("search_key"), F.col(embedding).alias("embedding"))
    return rank(named, "search_key", "id").select("pos", "id", "search_key", "embedding")


def position_range(ranked: DataFrame, low, high) -> DataFrame:
    """One row (l, r): the positions of the keys from ``low`` to ``high``, both nulls if there is none. Equal keys stay together."""
    return ranked.where(F.col("search_key").between(F.lit(low), F.lit(high))).agg(F.min("pos").alias("l"), F.max("pos").alias("r"))
