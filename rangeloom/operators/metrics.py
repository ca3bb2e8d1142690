"""Quality of graphs and search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph_recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row: hits, recall (of the true edges), precision (of the found ones)."""
    t, f = truth.select("node", "nbr").distinct(), found.select("node", "nbr").distinct()
    both = t.withColumn("t", F.lit(1)).join(f.withColumn("f", F.lit(1)), ["node", "nbr"], "full_outer")
    hits = F.sum(F.when(F.col("t").isNotNull() & F.col("f").isNotNull(), 1).otherwise(0))
    return both.agg(hits.alias("hits"), (hits / F.count("t")).alias("recall"), (hits / F.count("f")).alias("precision"))


def precision(truth, found):
    """Of two array columns, the share of the first that the second has; 0 of an empty one."""
    return F.when(F.size(truth) > 0, F.size(F.array_intersect(truth, found)) / F.size(truth)).otherwise(0.0)


def approximation_ratio(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Per qid: the largest found distance over the largest true one among as many nearest; 0 if nothing is found, -1 if that true one is 0."""
    many = found.groupBy("qid").agg(F.max("dist").alias("far"), F.count(F.lit(1)).alias("n"))
    cut = truth.join(many, "qid", "left").where(F.col("n").isNull() | (F.col("rank") <= F.col("n")))
    per = cut.groupBy("qid").agg(F.max("dist").alias("true_far"), F.first("far").alias("far"))
    return per.select("qid", F.when(F.col("far").isNull(), 0.0).when(F.col("true_far") == 0, -1.0).otherwise(F.col("far") / F.col("true_far")).alias("ratio"))


def distance_recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Per node: recall by merging the two lists of distances, each found one meeting one true one at most, and ``unstable``, the found ones that are smaller than the largest true one without being any (there should be none)."""
    t = truth.groupBy("node", "dist").agg(F.count(F.lit(1)).alias("t"))
    f = found.groupBy("node", "dist").agg(F.count(F.lit(1)).alias("f"))
    far = truth.groupBy("node").agg(F.max("dist").alias("far"), F.count(F.lit(1)).alias("n"))
    met = t.join(f, ["node", "dist"], "full_outer").join(far, "node")
    hits = F.sum(F.least(F.coalesce("t", F.lit(0)), F.coalesce("f", F.lit(0))))
    wrong = F.sum(F.when(F.col("t").isNull() & (F.col("dist") < F.col("far")), F.col("f")).otherwise(0))
    return met.groupBy("node").agg((hits / F.first("n")).alias("recall"), wrong.alias("unstable"))


def accuracy(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row, means over nodes: the relative distance error over the ranks that both have (true distances of 0 left out; 0 if none remains), and whether the nearest distances are equal."""
    met = truth.select("node", "rank", F.col("dist").alias("td")).join(found.select("node", "rank", "dist"), ["node", "rank"])
    error = F.coalesce(F.avg(F.when(F.col("td") > 0, F.abs(F.col("dist") - F.col("td")) / F.col("td"))), F.lit(0.0))
    first = F.max(F.when(F.col("rank") == 1, (F.col("td") == F.col("dist")).cast("int")))
    per = met.groupBy("node").agg(error.alias("error"), first.alias("one"))
    return per.agg(F.avg("error").alias("error"), F.avg("one").alias("one_recall"))


def delta(graph: DataFrame, k: int) -> DataFrame:
    """One row: the mean over nodes of the share (of ``k``) of new edges among each one's first ``k``."""
    per = graph.where(F.col("rank") <= k).groupBy("node").agg((F.sum(F.col("is_new").cast("int")) / F.lit(k)).alias("share"))
    return per.agg(F.avg("share").alias("delta"))
