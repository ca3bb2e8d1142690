"""Layered navigable graphs: grown by insertion, searched, and repaired after changes.

A graph is a table (level, node, nbr, dist). A node is on the levels up to one that its position's hash draws,
exponentially fewer on higher ones, so a level's nodes need no table of their own. A batch of new vectors walks down from the highest
node, all at once; on each level that a new node is on, the walk's beam are its candidates, and new ones that
share a candidate are each other's. It chooses diverse ones among them, edges are made mutual, and a node with
more than its level allows chooses again. Only nodes that got an edge are touched, and no pairs of all nodes are
ever met: a batch costs its walks. A table without a graph is inserted in batches that double, the first of which,
of a fixed size, meets itself in cells of hashing. Where a scan is cheaper than the walks (``SCAN_PAIRS``), batches
meet the old nodes, and one far larger than these meets itself, by a scan, and they grow faster.

Vectors that cannot be compared (``blocks.valid``) are in no graph.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut
from . import nndescent
from .blocks import nearest_of, valid
from .search import _scanned, along, asked, best, judged, one, prepared, walk

#: Pairs of queries and nodes that a level is scanned for rather than walked. A walk of 51,282 queries over as many vectors took 190 s of eight cores, 30 ms of one
#: for each; the screened scan of ``blocks`` takes some 7 ns of one a pair. So many pairs are an hour of a core, and by that reckoning a scan is cheaper up to four million nodes.
SCAN_PAIRS = 1 << 39
#: What a batch that is scanned grows the graph by: its new nodes meet each other too, so it may be larger than all before it, and a batch costs some thirty jobs whatever its rows.
STRIDE = 8
SCHEMA = "level int, node bigint, nbr bigint, dist double"


@dataclass(frozen=True)
class Layers:
    """Neighbours a node (M; twice as many in the lowest layer) and candidates for them default to those in common use."""

    m: int = 16
    candidates: int = 200
    seed: int = 23
    name: str = "l2sqr"
    #: Vectors of the first batch.
    first: int = 256

    def most(self, level: int) -> int:
        return self.m * (1 if level else 2)


def tops(vectors: DataFrame, p: Layers) -> DataFrame:
    """``vectors`` with the highest level of each."""
    drawn = (F.pmod(F.xxhash64("pos", F.lit(p.seed)), F.lit(1 << 40)) + 1) / float(1 << 40)
    return vectors.withColumn("top", F.floor(-F.log(drawn) / math.log(p.m)).cast("int"))


def _none(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def _ready(vectors: DataFrame, p: Layers) -> DataFrame:
    return cut(tops(valid(vectors.select(F.col("pos").cast("bigint").alias("pos"), "embedding")), p))


def _siblings(found: DataFrame, vectors: DataFrame, p: Layers) -> DataFrame:
    """New nodes that share a candidate, with their distances: node, nbr, dist. Of a candidate's new nodes the nearest so many meet."""
    near = Window.partitionBy("nbr").orderBy("dist", "node")
    members = found.withColumn("place", F.row_number().over(near)).where(F.col("place") <= 2 * p.m).select(F.col("nbr").alias("hub"), F.col("node").alias("pos"), F.lit(True).alias("is_new"))
    return nndescent._local_join(members, vectors.select("pos", "embedding").withColumn("worst", F.lit(float("inf"))), p.name)


def _linked(edges: DataFrame, candidates: DataFrame, vectors: DataFrame, most: int | Callable[[int], int], p: Layers) -> DataFrame:
    """A level's edges (node, nbr, dist) after some nodes have chosen among their candidates; ``most`` of a node at last."""
    chosen = cut(nndescent.diverse(candidates.where("node <> nbr").dropDuplicates(["node", "nbr"]), vectors, p.m, name=p.name).select("node", "nbr", "dist"))
    come = nndescent._both(chosen)
    touched = come.select("node").distinct()
    lists = edges.join(touched, "node", "left_semi").unionByName(come).dropDuplicates(["node", "nbr"])
    return edges.join(touched, "node", "left_anti").unionByName(nndescent.diverse(lists, vectors, most, name=p.name).select("node", "nbr", "dist"))


def insert(layers: DataFrame, vectors: DataFrame, new: DataFrame, p: Layers = Layers(), info: list | None = None) -> DataFrame:
    """The graph of ``vectors`` (pos, embedding) after ``new`` ones of other positions are put in. ``info`` is given a row a hop."""
    return _put(layers, _ready(vectors, p), _ready(new, p), p, info)


def _meets_itself(before: int, many: int) -> bool:
    """Whether a batch that is scanned is so large beside the nodes before it that its own are most nodes' nearest."""
    return many > 2 * before


def _scanned_in(layers: DataFrame, old: DataFrame, come: DataFrame, below: int, before: int, many: int, p: Layers) -> DataFrame:
    """``_put`` where a scan is cheaper on every level. No level waits for another then, so all are one: a node of a level is a position of its own, levels after one another."""
    first, last = old.select("pos").unionByName(come.select("pos")).agg(F.min("pos"), F.max("pos")).first()
    wide = int(last) - int(first) + 1
    at = lambda c: (F.col("level").cast("bigint") * wide + F.col(c) - first).alias(c)
    each = lambda v, low: v.where(F.col("top") >= low).withColumn("level", F.explode(F.sequence(F.lit(low), F.col("top")))).select(at("pos"), "embedding")
    own = each(come, 0)
    # Above the old nodes' levels, and where a batch is far larger than all before it, new ones meet each other, so they need no candidate in common.
    apart = -1 if _meets_itself(before, many) else below
    there = each(old, 0).unionByName(each(come, apart + 1))
    upper = F.col("pos") >= wide
    begin = F.col("pos") - F.pmod("pos", F.lit(wide))
    ranged = own.where(upper).withColumn("l", begin).withColumn("r", begin + (wide - 1))
    near = [nearest_of(own.where(~upper), there.where(~upper), p.candidates, p.name), nearest_of(ranged, there.where(upper), p.candidates, p.name)]
    found = cut(near[0].unionByName(near[1]).select("node", "nbr", "dist"))
    if apart >= 0:
        found = found.unionByName(_siblings(found.where(F.col("nbr") < (apart + 1) * wide), own, p))
    edges = layers.select(at("node"), at("nbr"), "dist")
    linked = _linked(edges, found, each(old, 0).unionByName(own), lambda node: p.most(node // wide), p)
    back = lambda c: (F.pmod(c, F.lit(wide)) + first).alias(c)
    return cut(linked.select(F.floor(F.col("node") / wide).cast("int").alias("level"), back("node"), back("nbr"), "dist"))


def _put(layers: DataFrame, old: DataFrame, come: DataFrame, p: Layers, info: list | None = None) -> DataFrame:
    """``insert`` for vectors as ``_ready`` gives them."""
    high, many = come.agg(F.max("top"), F.count(F.lit(1))).first()
    if high is None:
        return layers
    below, before = old.agg(F.coalesce(F.max("top"), F.lit(-1)), F.count(F.lit(1))).first()
    if (before + many if _meets_itself(before, many) else max(before, many)) * many <= SCAN_PAIRS:
        return _scanned_in(layers, old, come, below, before, many, p)
    every = cut(old.unionByName(come).withColumn("ok", F.lit(True)))
    held = {r["top"]: r["n"] for r in old.groupBy("top").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a level
    nodes = [sum(n for top, n in held.items() if top >= level) for level in range(below + 1)]
    # The lowest level of no more nodes than a beam holds, or than a scan is cheaper for: there, and above, the candidates are the nearest of all.
    small = next((level for level, n in enumerate(nodes) if n <= p.candidates or n * many <= SCAN_PAIRS), below + 1)
    doors = None
    if small > below >= 0:
        door = old.orderBy(F.desc("top"), "pos").first()["pos"]
        doors = come.select(F.col("pos").alias("qid"), F.lit(int(door)).cast("bigint").alias("pos"))
    out = layers.where(F.col("level") > high)
    for level in range(max(high, below), -1, -1):
        edges = layers.where(F.col("level") == level).drop("level")
        own = come.where(F.col("top") >= level)
        if level > below:
            # None of the old nodes is up here.
            linked = _linked(edges, nndescent.hashed_edges(own, p.candidates, name=p.name), every, p.most(level), p)
        else:
            there = old.where(F.col("top") >= level).select("pos", "embedding", F.lit(True).alias("ok"))
            if level > small:
                if level > high:
                    continue
                beams = cut(_scanned(there, asked(own.select(F.col("pos").alias("qid"), "embedding"), p.candidates), p.candidates, p.name))
            else:
                rows = [] if info is not None else None
                widths = F.when(F.col("top") >= level, p.candidates).otherwise(1)
                queries = asked(come.select(F.col("pos").alias("qid"), "embedding", widths.alias("width")), 1)
                beams = cut(_scanned(there, queries, p.candidates, p.name) if level == small else walk(queries, there, along(edges), doors, p.name, rows))
                doors = best(beams, 4).select("qid", "pos")
                if info is not None:
                    info += [{"level": level, **r} for r in rows]
                if level > high:
                    continue
            found = beams.join(own.select(F.col("pos").alias("qid")), "qid", "left_semi").select(F.col("qid").alias("node"), F.col("pos").alias("nbr"), "dist")
            linked = _linked(edges, found.unionByName(_siblings(found, every, p)), every, p.most(level), p)
        out = out.unionByName(linked.select(F.lit(level).alias("level"), "node", "nbr", "dist"))
    return cut(out)


def build(vectors: DataFrame, p: Layers = Layers(), info: list | None = None) -> DataFrame:
    """The graph of all vectors, put in by batches that double, or grow by ``STRIDE`` as long as a scan is cheaper, in the order of a hash of their positions."""
    own = cut(tops(valid(vectors.select(F.col("pos").cast("bigint").alias("pos"), "embedding")), p).withColumn("draw", F.pmod(F.xxhash64("pos", F.lit(p.seed + 1)), F.lit(1 << 40))))
    n = own.count()
    layers, past, share = _none(vectors.sparkSession), 0, min(1.0, p.first / max(n, 1))
    while n:
        bound = 1 << 40 if share >= 1 else int(share * (1 << 40))
        old, new = own.where(F.col("draw") < past), own.where((F.col("draw") >= past) & (F.col("draw") < bound))
        layers = _put(layers, old.drop("draw"), new.drop("draw"), p, info)
        if share >= 1:
            break
        wider = min(1.0, share * STRIDE)
        past, share = bound, wider if (wider - share) * n * wider * n <= SCAN_PAIRS else share * 2
    return layers


def repair(layers: DataFrame, vectors: DataFrame, changed: DataFrame, p: Layers = Layers(), info: list | None = None) -> DataFrame:
    """The graph after the vectors at some positions (``changed``: pos) were replaced or taken away; ``vectors`` are those of now.

    Changed nodes lose their edges. A node that had one of them as neighbour chooses anew, among the neighbours it
    keeps and those that the lost one led to, two hops away; all other lists stay. Then the changed nodes that
    are still there are inserted.
    """
    now = _ready(vectors, p)
    gone = cut(changed.select(F.col("pos").cast("bigint").alias("pos")).distinct())
    rest = now.join(gone, "pos", "left_anti")
    from_, to = gone.withColumnRenamed("pos", "node"), gone.withColumnRenamed("pos", "nbr")
    kept = cut(layers.join(from_, "node", "left_anti").join(to, "nbr", "left_anti").select("level", "node", "nbr", "dist"))
    lost = layers.join(from_, "node", "left_anti").join(to, "nbr", "left_semi").select("level", "node", F.col("nbr").alias("mid"))
    behind = layers.join(from_, "node", "left_semi").join(to, "nbr", "left_anti").select("level", F.col("node").alias("mid"), "nbr")
    bridges = cut(lost.join(behind, ["level", "mid"]).select("level", "node", "nbr").where("node <> nbr").distinct().join(kept, ["level", "node", "nbr"], "left_anti"))
    # A pair may be met on several levels; its distance is one.
    far = nndescent.measured(bridges.select("node", "nbr").distinct(), rest, p.name)
    out = _none(layers.sparkSession)
    for (level,) in sorted(r[0:1] for r in layers.select("level").distinct().collect()):
        edges = kept.where(F.col("level") == level).drop("level")
        own = bridges.where(F.col("level") == level).join(far, ["node", "nbr"]).select("node", "nbr", "dist")
        touched = lost.where(F.col("level") == level).select("node").distinct()
        lists = edges.join(touched, "node", "left_semi").unionByName(own)
        again = edges.join(touched, "node", "left_anti").unionByName(nndescent.diverse(lists, rest, p.most(level), name=p.name).select("node", "nbr", "dist"))
        out = out.unionByName(again.select(F.lit(level).alias("level"), "node", "nbr", "dist"))
    return insert(cut(out), rest.drop("top"), now.join(gone, "pos", "left_semi").drop("top"), p, info)


def search_many(layers: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, width: int = 64, name: str = "l2sqr", dead: DataFrame | None = None, info: list | None = None) -> DataFrame:
    """Search of all queries (qid, embedding; l, r) from the highest level down, each beginning where the one above ended: qid, pos, dist, rank.

    Nodes that are ``dead`` (pos) or outside a query's range are walked through and never found. Large batches are ``search.judged``.
    """
    own, wanted = prepared(vectors, dead), asked(queries, max(width, k))
    per = {r["level"]: r["n"] for r in layers.groupBy("level").agg(F.count_distinct("node").alias("n")).collect()}  # a row a level
    if not per:  # a single vector, or none
        return best(_scanned(own, wanted, k, name), k)
    return judged(lambda some: _walked(layers, own, some, per, k, width, name, info), own, wanted, k, name, whole=info is not None)


def _walked(layers: DataFrame, own: DataFrame, wanted: DataFrame, per: dict[int, int], k: int, width: int, name: str, info: list | None) -> DataFrame:
    """The walks of ``search_many``; ``per`` has the nodes of each level."""
    free = wanted.withColumn("width", F.lit(1).cast("bigint")).withColumns({c: F.lit(None).cast("bigint") for c in "lr"})
    # The walk begins on the lowest level, above the last, of no more nodes than its beam holds or than a scan is cheaper for, at the nearest of them; where there is none, at the top.
    many = wanted.count()
    near = lambda level: per[level] <= width or per[level] * many <= SCAN_PAIRS
    begin = next((level for level in range(1, max(per) + 1) if near(level)), max(per))
    there = layers.where(F.col("level") == begin).select(F.col("node").alias("pos")).distinct()
    if begin and near(begin):
        doors = best(_scanned(own.withColumn("ok", F.lit(True)).join(there, "pos", "left_semi"), free, 1, name), 1).select("qid", "pos")
    else:
        doors = wanted.select("qid", F.lit(int(there.agg(F.min("pos")).first()[0])).cast("bigint").alias("pos"))
        begin += 1
    for level in range(begin - 1 if begin else 0, -1, -1):
        edges, rows = layers.where(F.col("level") == level).select("node", "nbr"), []
        # Above, any node may be the door to the level below, and one is enough.
        if level:
            doors = best(walk(free, own.withColumn("ok", F.lit(True)), along(edges), doors, name, rows), 1).select("qid", "pos")
        else:
            found = walk(wanted, own, along(edges), doors, name, rows)
        if info is not None:
            info += [{"level": level, **r} for r in rows]
    return best(found, k)


def search(layers: DataFrame, vectors: DataFrame, point, k: int, width: int = 64, low: int | None = None, high: int | None = None, name: str = "l2sqr", dead: DataFrame | None = None) -> DataFrame:
    """``search_many`` for one point: pos, dist, rank."""
    return search_many(layers, vectors, one(vectors, point, low, high), k, width, name, dead).drop("qid")
