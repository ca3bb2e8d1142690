"""Stabbing by an equality join: the interval index under the dyadic segments of its intervals.

A row of the interval index holds for range starts in (sub, nbr] (left) or range ends in [nbr, sub) (right). Here it
is stored under the canonical dyadic segments of that interval, (level, prefix), of which there are at most two a
level; a bound lies in one segment a level, its path, and meets a row in at most one of them. So a batch of ranges
meets exactly the rows that hold for each by a hash or sort-merge join, without a comparison that fails but for the
node, and Spark plans it as any other join.

The node has to lie in the range as well. Rows are therefore kept by zones of nodes, in several grains: zones
of 64 nodes, 1,024, 16,384 and so on. A range is answered in the one grain in which it covers at most
17 zones, so it becomes at most 17 paths whatever its width, and only the two zones at its ends hold nodes outside.
A grain answers ranges of a bounded width, so it needs only rows whose neighbour is that near, and of their
intervals only that stretch: fine grains are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store

#: Bits of the nodes of a zone in the finest grain, and how many more bits each further grain has.
FIRST_BITS, STEP_BITS = 6, 4
#: Nodes of a folder of a saved layout, and folders that a batch names one by one; beyond, the join alone decides.
NODES_A_FOLDER, MOST_FOLDERS = 1 << 16, 10_000
COLUMNS = ("grain", "side", "zone", "level", "prefix", "node", "nbr", "dist")


def grains(positions: int) -> list[int]:
    """The zone bits of each grain for so many positions; the last answers any range."""
    out = [FIRST_BITS]
    while (1 << (out[-1] + STEP_BITS)) < positions:
        out.append(out[-1] + STEP_BITS)
    return out


def canonical(first: Column, past: Column, levels: int) -> Column:
    """The dyadic segments (level, prefix) that make up [first, past); at most two a level."""

    def at(h: Column) -> Column:
        # The stretch's ends in units of the level: whatever is left over there is an odd end.
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), h)
        a, b = F.floor((first + size - 1) / size).cast("bigint"), F.floor(past / size).cast("bigint")
        part = lambda on, prefix: F.when(on & (a < b), F.struct(h.alias("level"), prefix.alias("prefix")))
        return F.array(part(a % 2 == 1, a), part(b % 2 == 1, b - 1))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)), lambda x: x.isNotNull())


def path(bound: Column, levels: int) -> Column:
    """The dyadic segments (level, prefix) that hold a position, one a level."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda h: F.struct(h.alias("level"), F.call_function("shiftright", bound, h).alias("prefix")))


def layout(index: DataFrame, positions: int) -> DataFrame:
    """The index (node, side, nbr, dist, sub) of ``positions`` positions, a row a segment: grain, side, zone, level, prefix, node, nbr, dist."""
    out = None
    for grain, bits in enumerate(grains(positions)):
        reach = 1 << (bits + STEP_BITS)
        left = F.col("side") == "L"
        # Range starts above node - reach, range ends below node + reach, and no position beyond the last.
        first = F.when(left, F.greatest(F.col("sub") + 1, F.col("node") - reach + 1, F.lit(0))).otherwise(F.col("nbr"))
        past = F.when(left, F.col("nbr") + 1).otherwise(F.least(F.col("sub"), F.col("node") + reach, F.lit(positions)))
        levels = max(0, min(reach, max(positions, 1)).bit_length())
        own = index.where(F.abs(F.col("nbr") - F.col("node")) < reach).select(F.lit(grain).alias("grain"), "side", F.shiftright("node", bits).alias("zone"), F.explode(canonical(first, past, levels)).alias("x"), "node", "nbr", "dist")
        own = own.select("grain", "side", "zone", "x.level", "x.prefix", "node", "nbr", "dist")
        out = own if out is None else out.unionByName(own)
    return out


def paths(ranges: DataFrame, positions: int) -> DataFrame:
    """What a range (qid, l, r) looks for: grain, side, zone, level, prefix, qid, l, r. Ranges that hold no position look for nothing."""
    bits = grains(positions)
    inside = ranges.select("qid", F.greatest(F.col("l").cast("bigint"), F.lit(0)).alias("l"), F.least(F.col("r").cast("bigint"), F.lit(positions - 1)).alias("r")).where("l <= r")
    width = F.col("r") - F.col("l") + 1
    grain = F.lit(len(bits) - 1)
    for g in reversed(range(len(bits) - 1)):
        grain = F.when(width <= (1 << (bits[g] + STEP_BITS)), g).otherwise(grain)
    levels = max(0, max(positions, 1).bit_length())
    shift = grain * STEP_BITS + FIRST_BITS
    zones = F.sequence(F.call_function("shiftright", F.col("l"), shift), F.call_function("shiftright", F.col("r"), shift))
    spread = inside.select("qid", "l", "r", grain.alias("grain"), F.explode(zones).alias("zone"))
    sides = F.array(F.struct(F.lit("L").alias("side"), F.col("l").alias("bound")), F.struct(F.lit("R").alias("side"), F.col("r").alias("bound")))
    bound = spread.select("qid", "l", "r", "grain", "zone", F.explode(sides).alias("s")).select("qid", "l", "r", "grain", "zone", "s.side", "s.bound")
    return bound.select("qid", "l", "r", "grain", "zone", "side", F.explode(path(F.col("bound"), levels)).alias("x")).select("grain", "side", "zone", "x.level", "x.prefix", "qid", "l", "r")


def graphs(rows: DataFrame, ranges: DataFrame, k: int, positions: int) -> DataFrame:
    """The K-NN graphs of many ranges (qid, l, r) from a layout: qid, node, nbr, dist, rank."""
    met = rows.join(paths(ranges, positions), ["grain", "side", "zone", "level", "prefix"]).where(F.col("node").between(F.col("l"), F.col("r")))
    order = Window.partitionBy("qid", "node").orderBy("dist", "nbr")
    return met.select("qid", "node", "nbr", "dist").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _folder(node: Column) -> Column:
    return F.concat(F.col("grain").cast("string"), F.lit("-"), F.floor(node / NODES_A_FOLDER).cast("string"))


def save(index: DataFrame, positions: int, path: str) -> None:
    """The layout by folders of a grain and a stretch of nodes, sorted by zone and segment, so that a batch reads the folders and row groups that its zones are in."""
    store.save(layout(index, positions).withColumn("positions", F.lit(positions).cast("bigint")).withColumn("folder", _folder(F.col("node"))), path, "dyadic index", "folder", ("side", "zone", "level", "prefix", "node"))


def load(spark: SparkSession, path: str, check: bool = False) -> tuple[DataFrame, int]:
    """A saved layout and how many positions it is of."""
    rows = store.load(spark, path, "dyadic index", check)
    first = rows.select("positions").first()
    return rows.drop("positions"), int(first[0]) if first else 0


def saved_graphs(spark: SparkSession, path: str, ranges: DataFrame, k: int) -> DataFrame:
    """``graphs`` of a saved layout, of which only the folders that the ranges' zones are in are read."""
    rows, positions = load(spark, path)
    own = paths(ranges, positions).where("level = 0 AND side = 'L'")
    start = F.call_function("shiftleft", F.col("zone"), F.col("grain") * STEP_BITS + FIRST_BITS)
    last = F.least(start + F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("grain") * STEP_BITS + FIRST_BITS) - 1, F.lit(positions - 1).cast("bigint"))
    span = F.explode(F.sequence(F.floor(start / NODES_A_FOLDER), F.floor(last / NODES_A_FOLDER)))
    needed = [r[0] for r in own.select("grain", span.alias("stretch")).distinct().select(F.concat_ws("-", F.col("grain").cast("string"), F.col("stretch").cast("string"))).limit(MOST_FOLDERS + 1).collect()]
    if len(needed) <= MOST_FOLDERS:
        rows = rows.where(F.col("folder").isin(needed))
    return graphs(rows, ranges, k, positions)
