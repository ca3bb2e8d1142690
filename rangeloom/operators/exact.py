"""Exact nearest neighbours: of a free query, of every node, within a key range, within a radius.

Vectors that cannot be compared (``blocks.valid``) are nobody's neighbours and have none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distance import metric, unrolled
from .blocks import nearest_of, valid


def between(vectors: DataFrame, low: int | None, high: int | None) -> DataFrame:
    if low is not None:
        vectors = vectors.where(F.col("pos") >= low)
    return vectors if high is None else vectors.where(F.col("pos") <= high)


def query(vectors: DataFrame, point: Sequence[float], k: int, low: int | None = None, high: int | None = None, radius: float | None = None, name: str = "l2sqr") -> DataFrame:
    """The ``k`` vectors nearest to a point, nearest first: pos, dist, rank. With a radius, none farther."""
    where = F.array(*[F.lit(float(x)) for x in point])
    dist = unrolled(F.col("embedding"), where, len(point)) if name == "l2sqr" else metric(name)(F.col("embedding"), where)
    found = valid(between(vectors, low, high)).select("pos", dist.alias("dist"))
    if radius is not None:
        found = found.where(F.col("dist") <= radius)
    found = found.orderBy("dist", "pos").limit(k)
    return found.withColumn("rank", F.row_number().over(Window.orderBy("dist", "pos")))


def top(edges: DataFrame, k: int) -> DataFrame:
    """Each node's ``k`` nearest of its edges, ranked; an edge that repeats counts once."""
    order = Window.partitionBy("node").orderBy("dist", "nbr")
    return edges.dropDuplicates(["node", "nbr"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def graph(vectors: DataFrame, k: int, low: int | None = None, high: int | None = None, radius: float | None = None, name: str = "l2sqr", with_self: bool = False, nodes: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """The exact K-NN graph of a key range: node, nbr, dist, rank. ``nodes`` restricts for whom, not among whom."""

    own = None if nodes is None else between(nodes, low, high).select("pos", "embedding")
    data = between(vectors, low, high)
    if radius is None:
        return nearest_of(own, data, k, name, with_self, rows=rows)
    own = (data if own is None else own).select("pos", "embedding", F.lit(float(radius)).alias("radius"))
    return nearest_of(own, data, k, name, with_self, "radius", rows)


def rerank(edges: DataFrame, vectors: DataFrame, k: int, name: str = "l2sqr") -> DataFrame:
    """The ``k`` nearest of each node's listed neighbours, their distances computed anew."""
    of = lambda a, v: vectors.select(F.col("pos").alias(a), F.col("embedding").alias(v))
    vectors = valid(vectors)
    far = edges.select("node", "nbr").join(of("node", "x"), "node").join(of("nbr", "y"), "nbr").select("node", "nbr", metric(name)(F.col("x"), F.col("y")).alias("dist"))
    return top(far, k)


def hybrid(vectors: DataFrame, point: Sequence[float], k: int, low: int, high: int, many: int) -> DataFrame:
    """Nearest first, range second: of the ``many`` nearest anywhere, the ``k`` nearest within the range. May miss some."""
    found = query(vectors, point, many).where(F.col("pos").between(low, high)).orderBy("dist", "pos").limit(k)
    return found.withColumn("rank", F.row_number().over(Window.orderBy("dist", "pos")))


def pages(vectors: DataFrame, point: Sequence[float], size: int, low: int | None = None, high: int | None = None, name: str = "l2sqr") -> Iterator[DataFrame]:
    """The nearest vectors to a point page by page, each computed when it is asked for: pos, dist, rank (counted on). A page reads on behind the last one's end, so none is held."""
    where = F.array(*[F.lit(float(x)) for x in point])
    every = valid(between(vectors, low, high)).select("pos", metric(name)(F.col("embedding"), where).alias("dist"))
    after, done = None, 0
    while True:
        rest = every if after is None else every.where((F.col("dist") > after[0]) | ((F.col("dist") == after[0]) & (F.col("pos") > after[1])))
        page = rest.orderBy("dist", "pos").limit(size)
        last = page.agg(F.max_by(F.struct("dist", "pos"), F.struct("dist", "pos")).alias("x"), F.count(F.lit(1)).alias("n")).first()
        if not last["n"]:
            return
        yield page.withColumn("rank", F.row_number().over(Window.orderBy("dist", "pos")) + F.lit(done))
        after, done = (last["x"]["dist"], last["x"]["pos"]), done + last["n"]
