"""The interval index: for which range bounds one vector is among another's K nearest.

A row (node, side, nbr, dist, sub) says: nbr, left of node, is one of node's K nearest left neighbours
for every range that begins after ``sub`` and not after nbr; on the right, for every range that ends
from nbr on and before ``sub``. On the left ``sub`` is the K-th largest position among the left points
nearer to node, -1 if there are fewer; on the right the K-th smallest, or ``OPEN``. A row exists if
fewer than K nearer points lie between nbr and node.

Build: a group of nodes meets the vectors block by block, outwards on both sides, and remembers each node's K
nearest so far on either side; what is nearer than the last of them may be a row, and is exactly measured. A point that
K nearer points separate from the node can be no row, and never the K-th for any other, so walking through the rest in
order of distance gives the whole index, in the same task. Vectors that cannot be
compared (``blocks.valid``) are in no row. Any metric of ``functions.distance`` will do.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distance import metric
from ..plans.lineage import cut
from .blocks import STEP, Screen, grouped, lessen, met, valid

OPEN = 2**63 - 1
#: Nodes whose candidates a task merges at a time; each has about K log(blocks) survivors a side.
NODES_A_GROUP = 128
SCHEMA = "node bigint, side string, nbr bigint, dist double, sub bigint"


def walk(keys: np.ndarray, there: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of keys in order of distance (``there``: which cells count), the K-th largest key so far, and whether the key is above it."""
    n, width = keys.shape
    best = np.full((n, k), -1, dtype=np.int64)
    sub, keep = np.full((n, width), -1, dtype=np.int64), np.zeros((n, width), dtype=bool)
    rows = np.arange(n)
    for c in range(width):
        least = best.argmin(axis=1)
        bound = best[rows, least]
        sub[:, c] = bound
        on = there[:, c] & (keys[:, c] > bound)
        keep[:, c] = on
        best[rows[on], least[on]] = keys[on, c]
    return sub, keep


class Walk:
    """A group's nodes and what of the vectors that they have met may be a row of theirs, on the left and on the right."""

    #: Which pairs of nodes and positions count; all.
    allowed = None

    def __init__(self, node, x, l, r, most, k: int, name: str, sides: str = "LR"):
        order = np.argsort(node)
        self.node, self.k = node[order], k
        self.screens = {s: Screen(x[order], most[order], name) for s in sides}
        self.most = most[order]
        self.best = {s: np.full((len(node), k), np.inf) for s in sides}
        self.rows = {s: [] for s in sides}
        self.own = []

    def add(self, pos: np.ndarray, y: np.ndarray, own: bool) -> None:
        if own:
            self.own.append((pos, y))
            return
        self._own()
        # A whole block lies on one side, of all nodes of the group.
        self._meet("L" if pos[0] < self.node[0] else "R", pos, y, 0, len(self.node))

    def _own(self) -> None:
        """The group's own stretch of positions, in small steps away from each node."""
        if not self.own:
            return
        pos, y = (np.concatenate(c) for c in zip(*self.own, strict=True))
        order = np.argsort(pos)
        pos, y, self.own = pos[order], y[order], []
        steps = range(0, len(pos), STEP)
        for side in self.rows:
            for a in reversed(steps) if side == "L" else steps:
                p, z = pos[a : a + STEP], y[a : a + STEP]
                if side == "L":
                    self._meet(side, p, z, int(np.searchsorted(self.node, p[0], side="right")), len(self.node))
                else:
                    self._meet(side, p, z, 0, int(np.searchsorted(self.node, p[-1])))

    def _meet(self, side: str, p: np.ndarray, z: np.ndarray, first: int, past: int) -> None:
        if side not in self.rows or first >= past:
            return
        screen = self.screens[side]
        near = screen.within(first, past, screen.block(z))
        if self.allowed is not None:
            near &= self.allowed(first, past, p)
        i, c = divmod(np.flatnonzero(near), len(p))
        i += first
        there = p[c] < self.node[i] if side == "L" else p[c] > self.node[i]
        i, c = i[there], c[there]
        d = screen.measured(i, z, c)
        # On the left the smaller position, which comes later, is the nearer of equal ones.
        on = ((d <= screen.bound[i]) if side == "L" else (d < screen.bound[i])) & np.isfinite(d)
        if on.any():
            i, c, d = i[on], c[on], d[on]
            self.rows[side].append((i, p[c], d))
            changed = lessen(self.best[side], i, d)
            screen.set(changed, np.minimum(self.best[side][changed].max(axis=1), self.most[changed]))

    def close(self):
        self._own()
        for side, rows in self.rows.items():
            if not rows:
                continue
            i, p, d = (np.concatenate(c) for c in zip(*rows, strict=True))
            order = np.argsort(i, kind="stable")
            i, p, d = i[order], p[order], d[order]
            for a in range(0, len(self.node), NODES_A_GROUP * 4):
                own = slice(*np.searchsorted(i, [a, a + NODES_A_GROUP * 4]))
                if own.start == own.stop:
                    continue
                left = np.full(own.stop - own.start, side == "L")
                yield settled(self.node[i[own]], left, p[own], d[own], self.k)


def build(vectors: DataFrame, k: int, rows: int | None = None, name: str = "l2sqr") -> DataFrame:
    """The index of (pos, embedding) for K = ``k``."""
    return met(None, vectors, lambda *group: Walk(*group, k, name), SCHEMA, rows)


def settled(node: np.ndarray, left: np.ndarray, nbr: np.ndarray, dist: np.ndarray, k: int) -> pa.Table:
    """The index rows among candidates that hold all that survive; all of a node are there."""
    order = np.lexsort((nbr, dist, ~left, node))
    node, nbr, dist, left = node[order], nbr[order], dist[order], left[order]
    group = np.cumsum(np.diff(node, prepend=node[0]).astype(bool) | np.diff(left.astype(int), prepend=int(left[0])).astype(bool))
    first = np.searchsorted(group, np.arange(group[-1] + 2))
    sizes = np.diff(first)
    at = np.arange(len(node)) - first[group]
    sub, keep = np.empty(len(node), dtype=np.int64), np.zeros(len(node), dtype=bool)
    # Groups of like size share a matrix.
    for width in np.unique(1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)):
        own = np.flatnonzero((sizes <= width) & (sizes > width // 2))
        rows = np.flatnonzero(np.isin(group, own))
        r = np.searchsorted(own, group[rows])
        keys, there = np.full((len(own), width), -1, dtype=np.int64), np.zeros((len(own), width), dtype=bool)
        keys[r, at[rows]] = np.where(left[rows], nbr[rows], OPEN - nbr[rows])
        there[r, at[rows]] = True
        s, kept = walk(keys, there, k)
        sub[rows], keep[rows] = s[r, at[rows]], kept[r, at[rows]]
    sub = np.where(left, sub, np.where(sub < 0, OPEN, OPEN - sub))
    return pa.table({"node": pa.array(node[keep]), "side": pa.array(np.where(left[keep], "L", "R").astype(object), pa.string()), "nbr": pa.array(nbr[keep]), "dist": pa.array(dist[keep]), "sub": pa.array(sub[keep])})


def settle(candidates: DataFrame, k: int) -> DataFrame:
    """The index rows among candidates (node, side, nbr, dist) that hold all that survive."""
    many = candidates.select("node", "side", "nbr", "dist", F.floor(F.col("node") / NODES_A_GROUP).alias("part"))

    def run(t: pa.Table) -> pa.Table:
        node, nbr, dist = (t.column(c).to_numpy() for c in ("node", "nbr", "dist"))
        return settled(node, pc.equal(t.column("side"), "L").to_numpy(), nbr, dist, k)

    return grouped(many, "part").applyInArrow(run, SCHEMA)


def build_by_windows(vectors: DataFrame, k: int, name: str = "l2sqr") -> DataFrame:
    """The same index by window functions over all pairs; each node's list of nearer points is held, so for small tables."""
    vectors = valid(vectors)
    of = lambda a, v: vectors.select(F.col("pos").alias(a), F.col("embedding").alias(v))
    every = of("node", "x").join(of("nbr", "y"), F.col("node") != F.col("nbr")).select("node", "nbr", F.when(F.col("nbr") < F.col("node"), "L").otherwise("R").alias("side"), metric(name)(F.col("x"), F.col("y")).alias("dist"))
    before = Window.partitionBy("node", "side").orderBy("dist", "nbr").rowsBetween(Window.unboundedPreceding, -1)
    near = every.withColumn("nearer", F.collect_list("nbr").over(before))
    sub = F.when(F.col("side") == "L", F.coalesce(F.try_element_at(F.sort_array("nearer", False), F.lit(k)), F.lit(-1).cast("bigint"))).otherwise(F.coalesce(F.try_element_at(F.sort_array("nearer", True), F.lit(k)), F.lit(OPEN)))
    kept = near.withColumn("sub", sub).where("(side = 'L' AND sub < nbr) OR (side = 'R' AND nbr < sub)")
    return kept.select("node", "side", "nbr", "dist", F.col("sub").cast("bigint").alias("sub"))


def stabbed(index: DataFrame, low: int, high: int) -> DataFrame:
    """The index rows that hold for the range; two branches, so that each side's bounds reach the files' statistics."""
    own = index.where(F.col("node").between(low, high))
    left = own.where((F.col("side") == "L") & (F.col("sub") < low) & (F.col("nbr") >= low))
    right = own.where((F.col("side") == "R") & (F.col("sub") > high) & (F.col("nbr") <= high))
    return left.unionByName(right)


def graph(index: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """The K-NN graph of a key range, from the index: node, nbr, dist, rank."""
    order = Window.partitionBy("node").orderBy("dist", "nbr")
    return stabbed(index, low, high).select("node", "nbr", "dist").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lookup(index: DataFrame, node: int, low: int, high: int) -> DataFrame:
    """One node's neighbours on both sides for a range: side, nbr, dist, sub."""
    return stabbed(index.where(F.col("node") == node), low, high).select("side", "nbr", "dist", "sub")


def raw(index: DataFrame) -> DataFrame:
    """The index without its bounds: neighbours in order of distance, to be replayed."""
    return index.select("node", "side", "nbr", "dist")


def replayed_graph(raw_index: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """The K-NN graph of a range from the index without bounds: in each side, the K nearest inside the range."""
    own = raw_index.where(F.col("node").between(low, high) & F.col("nbr").between(low, high))
    side = Window.partitionBy("node", "side").orderBy("dist", "nbr")
    order = Window.partitionBy("node").orderBy("dist", "nbr")
    near = own.withColumn("__r", F.row_number().over(side)).where(F.col("__r") <= k)
    return near.select("node", "nbr", "dist").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def windows(index: DataFrame, k: int) -> DataFrame:
    """Per node, side and bound, the neighbours that hold from that bound on: node, side, bound, pts (nearest first).

    On the left a window holds for range starts in (previous bound, bound]; the bounds are the positions
    where the K nearest change, that is, the neighbours themselves.
    """
    at = index.select("node", "side", F.col("nbr").alias("bound")).distinct()
    holds = F.when(F.col("side") == "L", (F.col("sub") < F.col("bound")) & (F.col("bound") <= F.col("nbr"))).otherwise((F.col("nbr") <= F.col("bound")) & (F.col("bound") < F.col("sub")))
    met = at.join(index, ["node", "side"]).where(holds)
    pts = F.transform(F.array_sort(F.collect_list(F.struct("dist", "nbr"))), lambda p: p["nbr"])
    return met.groupBy("node", "side", "bound").agg(pts.alias("pts"))


#: Nodes of a block by which a batch of ranges meets the index.
BLOCK = 64


def graphs(index: DataFrame, ranges: DataFrame, k: int) -> DataFrame:
    """The K-NN graphs of many ranges (qid, l, r) at once: qid, node, nbr, dist, rank.

    Each range is exploded into the blocks of nodes it covers and joined on the block, so the join has a
    key; the bounds decide within it.
    """
    covered = ranges.select("qid", "l", "r", F.explode(F.sequence(F.floor(F.col("l") / BLOCK), F.floor(F.col("r") / BLOCK))).alias("block"))
    blocked = index.withColumn("block", F.floor(F.col("node") / BLOCK))
    holds = F.col("node").between(F.col("l"), F.col("r")) & (
        ((F.col("side") == "L") & (F.col("sub") < F.col("l")) & (F.col("nbr") >= F.col("l"))) | ((F.col("side") == "R") & (F.col("sub") > F.col("r")) & (F.col("nbr") <= F.col("r")))
    )
    order = Window.partitionBy("qid", "node").orderBy("dist", "nbr")
    return blocked.join(covered, "block").where(holds).select("qid", "node", "nbr", "dist").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Nodes of a group at most and at least whose ranges a task adds up, and ranges that it holds at a time.
TOTAL_NODES, LEAST_TOTAL, RANGES_HELD = 4096, 64, 1 << 20
_SPREAD = "group int, kind int, a binary, b binary, c binary, left binary, dist binary"
_TOTALS = "qid bigint, n_edges bigint, checksum bigint, dist double"


def totals(index: DataFrame, ranges: DataFrame, k: int, weights: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """What the K-NN graphs of many ranges (qid, l, r) add up to, a row a range with edges: qid, n_edges, checksum (the sum of node, nbr and rank, each times its weight), dist.

    The same as sums over ``graphs``, whose edges, ranges times their widths, are never rows. A node's K nearest change only where
    l or r passes one of its index rows' bounds, so what it adds is a small table, in which a range looks up one cell. A
    group of nodes is one task: it gets its own index rows and, packed, the ranges that it lies in, and gives a row a range.
    """
    spark = index.sparkSession
    low, high = index.agg(F.min("node"), F.max("node")).first()
    if low is None:
        return spark.createDataFrame([], _TOTALS)
    size = min(TOTAL_NODES, max(LEAST_TOTAL, -(-(high - low + 1) // (8 * spark.sparkContext.defaultParallelism))))
    groups = (high - low) // size + 1

    def rows_of(batches):
        for b in batches:
            if not b.num_rows:
                continue
            node, nbr, sub, dist = (b.column(c).to_numpy() for c in ("node", "nbr", "sub", "dist"))
            left = pc.equal(b.column("side"), "L").to_numpy(zero_copy_only=False)
            group = (node - low) // size
            order = np.argsort(group, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                yield from _table(_SPREAD, [{"group": group[own[0]], "kind": 0, "a": node[own].tobytes(), "b": nbr[own].tobytes(), "c": sub[own].tobytes(), "left": left[own].tobytes(), "dist": dist[own].tobytes()}]).to_batches()

    def ranges_of(batches):
        for b in batches:
            if not b.num_rows:
                continue
            qid, l, r = (b.column(c).to_numpy() for c in ("qid", "l", "r"))
            for g in range(max(0, (int(l.min()) - low) // size), min(groups - 1, (int(r.max()) - low) // size) + 1):
                own = np.flatnonzero((l < low + (g + 1) * size) & (r >= low + g * size))
                if len(own):
                    yield from _table(_SPREAD, [{"group": g, "kind": 1, "a": qid[own].tobytes(), "b": l[own].tobytes(), "c": r[own].tobytes()}]).to_batches()

    def run(batches):
        here, rows, asked, held = None, [], [], 0

        def added():
            if rows and asked:
                qid, l, r = (np.concatenate(c) for c in zip(*asked, strict=True))
                many, check, far = _added([np.concatenate(c) for c in zip(*rows, strict=True)], l, r, k, weights)
                on = many > 0
                yield from pa.table({"qid": qid[on], "n_edges": many[on], "checksum": check[on], "dist": far[on]}).to_batches(max_chunksize=1 << 16)

        for b in batches:
            c = {name: b.column(name) for name in b.schema.names}
            for i in range(b.num_rows):
                of = lambda name, kind=np.int64: np.frombuffer(c[name][i].as_buffer(), dtype=kind).copy()  # noqa: B023, E731
                group, new = c["group"][i].as_py(), c["kind"][i].as_py() == 1
                if group != here or held >= RANGES_HELD:
                    yield from added()
                    here, rows, asked, held = group, rows if group == here else [], [], 0
                if new:
                    asked.append((of("a"), of("b"), of("c")))
                    held += len(asked[-1][0])
                else:
                    rows.append((of("a"), of("b"), of("c"), of("left", bool), of("dist", np.float64)))
        yield from added()

    spread = index.select(F.col("node").cast("bigint").alias("node"), F.col("nbr").cast("bigint").alias("nbr"), F.col("sub").cast("bigint").alias("sub"), "side", "dist").mapInArrow(rows_of, _SPREAD)
    wanted = ranges.select(F.col("qid").cast("bigint").alias("qid"), F.greatest(F.col("l").cast("bigint"), F.lit(0)).alias("l"), F.col("r").cast("bigint").alias("r")).where("l <= r").mapInArrow(ranges_of, _SPREAD)
    met_ = spread.unionByName(wanted).repartitionById(int(groups), F.col("group")).sortWithinPartitions("group", "kind").mapInArrow(run, _TOTALS)
    return met_.groupBy("qid").agg(*[F.sum(c).alias(c) for c in ("n_edges", "checksum", "dist")])


def _added(rows: list[np.ndarray], l: np.ndarray, r: np.ndarray, k: int, weights: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ranges, the edges, check sum and distances of some nodes' index rows (node, nbr, sub, left, dist) that hold for them."""
    node, nbr, sub, left, dist = rows
    order = np.lexsort((nbr, dist, node))
    node, nbr, sub, left, dist = (c[order] for c in (node, nbr, sub, left, dist))
    by_l, by_r = np.argsort(l, kind="stable"), np.argsort(r, kind="stable")
    starts, ends = l[by_l], r[by_r]
    # Ranges in the order of l; the place of each one's r among all.
    place = np.empty(len(r), dtype=np.int64)
    place[by_r] = np.arange(len(r))
    place = place[by_l]
    many, check, far = np.zeros(len(l), dtype=np.int64), np.zeros(len(l), dtype=np.int64), np.zeros(len(l))
    cuts = np.append(np.flatnonzero(np.diff(node, prepend=node[0] - 1)), len(node))
    for a, b in zip(cuts, cuts[1:], strict=False):
        own, p = slice(a, b), int(node[a])
        # From each of these on, other rows hold; the last stretch on the left and the first on the right do not hold the node.
        lefts = np.unique(np.concatenate([sub[own][left[own]] + 1, nbr[own][left[own]] + 1, [p + 1]]))
        rights = np.unique(np.concatenate([sub[own][~left[own]], nbr[own][~left[own]], [p]]))
        begin, end = np.concatenate([[-1], lefts]), np.concatenate([[-1], rights])
        one = _holding(left[own] & (sub[own] < begin[:, None]) & (begin[:, None] <= nbr[own]), k)
        other = _holding(~left[own] & (nbr[own] <= end[:, None]) & (end[:, None] < sub[own]), k)
        # Of the k nearest of both, so many are of the left: its i-th is, if it comes before the right's (k - 1 - i)-th.
        taken = np.zeros((len(begin), len(end)), dtype=np.int64)
        for i in range(k):
            taken += one[:, i, None] < other[None, :, k - 1 - i]
        i, j = np.arange(len(begin))[:, None] * (k + 1) + taken, np.arange(len(end)) * (k + 1) + k - taken
        there, sums, lengths = (_sums(c, one)[i] + _sums(c, other)[j] for c in (np.ones(b - a, dtype=np.int64), nbr[own], dist[own]))
        codes = weights[0] * p * there + weights[1] * sums + weights[2] * (there * (there + 1) // 2)
        for c in (there, codes, lengths):
            c[-1], c[:, 0] = 0, 0
        cell = np.repeat(np.arange(len(begin)) * len(end), np.diff(np.searchsorted(starts, lefts), prepend=0, append=len(starts)))
        cell += np.repeat(np.arange(len(end)), np.diff(np.searchsorted(ends, rights), prepend=0, append=len(ends)))[place]
        many += there.ravel()[cell]
        check += codes.ravel()[cell]
        far += lengths.ravel()[cell]
    back = np.empty(len(l), dtype=np.int64)
    back[by_l] = np.arange(len(l))
    return many[back], check[back], far[back]


def _sums(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sums over the first 0, 1, ... of each row's places, row by row; places past the values count nothing."""
    out = np.zeros((len(places), places.shape[1] + 1), dtype=values.dtype)
    np.cumsum(np.append(values, 0)[places], axis=1, out=out[:, 1:])
    return out.ravel()


def _holding(holds: np.ndarray, k: int) -> np.ndarray:
    """The places of the first ``k`` true cells of each row; past the last, the number of columns."""
    i, c = np.nonzero(holds)
    at = np.arange(len(i)) - np.searchsorted(i, i)
    out = np.full((len(holds), k), holds.shape[1], dtype=np.int16 if holds.shape[1] < 1 << 15 else np.int64)
    out[i[at < k], at[at < k]] = c[at < k]
    return out


#: Bytes of a row as it is held: three positions, a distance, a side.
ROW_BYTES = 33


def sizes(index: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Rows, nodes, rows a node, and bytes of the index (rows times what a row holds)."""
    return index.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("node").alias("n_nodes")).select("n_rows", "n_nodes", (F.col("n_rows") / F.col("n_nodes")).alias("rows_per_node"), (F.col("n_rows") * row_bytes).alias("n_bytes"))


def appended(open_rows: DataFrame, old: DataFrame, new: DataFrame, k: int, name: str = "l2sqr") -> DataFrame:
    """Index rows after vectors (pos, embedding) of larger keys than all old ones are added: all rows of the new nodes, and the right rows of old nodes that a new one may reach, in the place of their open rows.

    Of an old node only the open right rows, its K nearest on that side, can change: a new point is
    among the K nearest for some range only if fewer than K of them are nearer, and it can bound only them.
    """
    old, new = (valid(v.select("pos", "embedding")) for v in (old, new))
    anew = met(new, old.unionByName(new), lambda *group: Walk(*group, k, name), SCHEMA)
    # What of the new ones is nearer to an old node than its K-th nearest on the right.
    last = open_rows.groupBy("node").agg(F.max("dist").alias("dist"), F.count(F.lit(1)).alias("n")).select(F.col("node").alias("pos"), F.when(F.col("n") >= k, F.col("dist")).alias("most"))
    bounded = old.join(last, "pos", "left")
    come = cut(met(bounded, new, lambda *group: Walk(*group, k, name, "R"), SCHEMA, most="most").drop("sub"))
    touched = come.select("node").distinct()
    before = open_rows.join(touched, "node", "left_semi").select("node", "side", "nbr", "dist")
    return anew.unionByName(settle(come.unionByName(before), k))


def is_open():
    return (F.col("side") == "R") & (F.col("sub") == OPEN)


def append(index: DataFrame, vectors: DataFrame, new: DataFrame, k: int, name: str = "l2sqr") -> DataFrame:
    """The index after any number of vectors (pos, embedding) of the largest keys are added."""
    rows = cut(appended(index.where(is_open()), vectors, new, k, name))
    changed = rows.select("node").distinct()
    return index.where(~is_open()).unionByName(index.where(is_open()).join(changed, "node", "left_anti")).unionByName(rows)


def repair(index: DataFrame, vectors: DataFrame, changed: DataFrame, k: int, name: str = "l2sqr") -> DataFrame:
    """The index after the vectors at some positions (``changed``: pos) were replaced or taken away; ``vectors`` are those of now.

    Nodes that changed, or have a changed neighbour, are worked out anew; in the lists of all others a
    changed vector can only come in.
    """
    vectors = valid(vectors.select("pos", "embedding"))
    changed = changed.select("pos").distinct()
    anew = cut(index.join(changed.withColumnRenamed("pos", "nbr"), "nbr", "left_semi").select(F.col("node").alias("pos")).unionByName(changed).distinct())
    now = vectors.join(changed, "pos", "left_semi")

    walks = lambda *group: Walk(*group, k, name)
    whole = met(vectors.join(anew, "pos", "left_semi"), vectors, walks, SCHEMA)
    others = vectors.join(anew, "pos", "left_anti")
    come = cut(met(others, now, walks, SCHEMA).drop("sub"))
    kept = index.join(anew.withColumnRenamed("pos", "node"), "node", "left_anti")
    reached = come.select("node").distinct()
    again = settle(come.unionByName(kept.join(reached, "node", "left_semi").select("node", "side", "nbr", "dist")), k)
    return whole.unionByName(again).unionByName(kept.join(reached, "node", "left_anti"))


#: Steps that a node's candidates may be away in the graph at most, where its frontier does not end them before.
HOPS = 10
#: A neighbour in a range of w of n keys is near in keys if w is small, and else among some K n / w nearest of all. So
#: this many times the root of K n keys on either side, and about as many near ones, miss few in ranges of any width.
REACH = 1.5


def frontier(vectors: DataFrame, graph: DataFrame, k: int, hops: int = HOPS, reach: float = REACH, info: list | None = None) -> DataFrame:
    """Each node's candidates from a graph (node, nbr): node, l, r, found (packed positions): what some steps lead to, and the positions between which all are to be looked at.

    A node goes on, step by step, until the stretch of keys between its K-th left and its K-th right candidate is
    shorter than what a further step would bring (its last step's nodes times the graph's mean degree): looking at all
    of the stretch is then cheaper. It goes on as well while it has fewer candidates than ``reach`` times the root of
    ``k`` times all, and at least so many keys on either side are looked at. Only nodes that go on are joined again.
    ``info`` is given a row a step.
    """
    ends = vectors.agg(F.min("pos"), F.max("pos"), F.count(F.lit(1))).first()
    first, last = int(ends[0] or 0), int(ends[1] or 0)
    edges = cut(graph.select(F.col("node").cast("bigint").alias("node"), F.col("nbr").cast("bigint").alias("nbr")).where("node <> nbr").distinct())
    mean, least = edges.count() / max(ends[2], 1), math.ceil(reach * math.sqrt(k * ends[2]))
    enough = min(least, ends[2] - 1)
    legs, parts, span = _legs(edges, first, last, ends[2])
    done, going = [], None
    for hop in range(1, hops + 1):
        own = cut(_stepped(vectors, edges, going, None if hop == 1 else _reached(going, legs, parts, first, span), k, first, last, least, enough, mean, hop < hops))
        seen = own.agg(F.coalesce(F.sum(F.col("on").cast("bigint")), F.lit(0)).alias("going"), F.coalesce(F.sum(F.when(~F.col("on"), F.octet_length("found") / 8 + F.col("r") - F.col("l") - 1)), F.lit(0)).cast("bigint").alias("candidates")).first()
        done.append(own.where("NOT on").select("node", "l", "r", "found"))
        if info is not None:
            info.append({"hop": hop, "going": seen["going"], "candidates": seen["candidates"]})
        if not seen["going"]:
            break
        going = own.where("on")
    return reduce(DataFrame.unionByName, done)


#: Nodes of a part of the edges at most, and parts of a large graph at least.
LEGS_A_PART, LEAST_PARTS = 1 << 16, 16
_LEGS = "part int, kind int, node binary, many binary, pos binary"
_STEP = "node bigint, found binary, last binary, l bigint, r bigint, on boolean"


def _legs(edges: DataFrame, first: int, last: int, n: int) -> tuple[DataFrame, int, int]:
    """The edges packed by parts of positions, how many parts there are, and the positions of each."""
    parts = max(-(-n // LEGS_A_PART), min(LEAST_PARTS, n // 512), 1)
    span = -(-(last - first + 1) // parts)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("node", "ascending"), ("nbr", "ascending")])
        node, many = np.unique(t.column("node").to_numpy(), return_counts=True)
        return _table(_LEGS, [{"part": t.column("part")[0].as_py(), "kind": 0, "node": node.tobytes(), "many": many.astype(np.int64).tobytes(), "pos": t.column("nbr").to_numpy().tobytes()}])

    dealt = edges.select("node", "nbr", F.floor((F.col("node") - first) / span).cast("int").alias("part"), F.floor(F.col("node") / 4096).alias("block"))
    return cut(grouped(dealt, "part", "block").applyInArrow(run, _LEGS)), parts, span


def _table(schema: str, rows: list[dict]) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.table({c: pa.array([r.get(c) for r in rows], kinds[kind]) for c, kind in (f.split() for f in schema.split(", "))})


def _runs(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places of runs of so many from each start, one after another."""
    ends = np.cumsum(many)
    return np.repeat(start - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)


def _reached(going: DataFrame, legs: DataFrame, parts: int, first: int, span: int) -> DataFrame:
    """What the nodes of each one's last step lead to, each once a part: node, nbrs (packed). Nodes ask each part of the edges once."""

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            last = [np.frombuffer(v.as_buffer(), dtype=np.int64) for v in b.column("last")]
            node, mid = np.repeat(b.column("node").to_numpy(), [len(v) for v in last]), np.concatenate(last)
            part = (mid - first) // span
            order = np.argsort(part, kind="stable")
            for a in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else ():
                for own in np.split(a, range(1 << 16, len(a), 1 << 16)):
                    yield from _table(_LEGS, [{"part": part[own[0]], "kind": 1, "node": node[own].tobytes(), "pos": mid[own].tobytes()}]).to_batches()

    def run(batches):
        held, at = [], None
        for b in batches:
            c = {name: b.column(name) for name in b.schema.names}
            for i in range(b.num_rows):
                of = lambda name: np.frombuffer(c[name][i].as_buffer(), dtype=np.int64)  # noqa: B023, E731
                if c["kind"][i].as_py() == 0:
                    held.append([of(name).copy() for name in ("node", "many", "pos")])
                    continue
                if at is None:
                    if not held:
                        return
                    held.sort(key=lambda h: h[0][0])
                    at, many, to = (np.concatenate(v) for v in zip(*held, strict=True))
                    start, held = np.cumsum(many) - many, []
                node, mid = of("node"), of("pos")
                row = np.searchsorted(at, mid).clip(max=len(at) - 1)
                node, row = node[at[row] == mid], row[at[row] == mid]
                ids, own = np.unique(node, return_inverse=True)
                wide = to.max() + 1 if len(to) else 1
                key = np.repeat(own, many[row]) * wide + to[_runs(start[row], many[row])]
                key = np.sort(key)
                key = key[np.diff(key, prepend=-1) > 0]
                nbr, ends = key % wide, np.searchsorted(key, np.arange(1, len(ids)) * wide)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([v.tobytes() for v in np.split(nbr, ends)] if len(ids) else [], pa.binary())], names=["node", "nbrs"])

    asked = going.select("node", "last").mapInArrow(deal, _LEGS)
    return legs.unionByName(asked).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind").mapInArrow(run, "node bigint, nbrs binary")


def _stepped(vectors: DataFrame, edges: DataFrame, going: DataFrame | None, reached: DataFrame | None, k: int, first: int, last: int, least: int, enough: int, mean: float, more: bool) -> DataFrame:
    """Each node's candidates after a step (``found``, and ``last``, those of this step; both packed), its stretch of keys, and whether it goes on. The first step is that of the edges."""

    def settled_(node: int, found: np.ndarray, new: np.ndarray) -> dict:
        own = np.sort(np.concatenate([found, new]))
        at = int(np.searchsorted(own, node))
        l = max(min(int(own[at - k]) if at >= k else first - 1, node - least), first - 1)
        r = min(max(int(own[at + k - 1]) if len(own) - at >= k else last + 1, node + least), last + 1)
        on = more and len(new) > 0 and ((r - l) >= len(new) * mean or len(own) < enough)
        return {"node": node, "found": own.tobytes(), "last": new.tobytes() if on else b"", "l": l, "r": r, "on": on}

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("node", "ascending"), ("kind", "ascending")])
        node, found, nbrs = t.column("node").to_numpy(), t.column("found").combine_chunks(), t.column("nbrs").combine_chunks()
        cuts = np.append(np.flatnonzero(np.diff(node, prepend=node[0] - 1)), len(node))
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if t.column("kind")[int(a)].as_py():  # an edge of a vector that is not there
                continue
            old = np.frombuffer(found[int(a)].as_buffer(), dtype=np.int64)
            come = [np.frombuffer(nbrs[int(i)].as_buffer(), dtype=np.int64) for i in range(a + 1, b)]
            new = np.unique(np.concatenate(come)) if come else np.zeros(0, dtype=np.int64)
            new = new[new != node[a]]
            if len(old) and len(new):
                new = new[old[np.searchsorted(old, new).clip(max=len(old) - 1)] != new]
            out.append(settled_(int(node[a]), old, new))
        return _table(_STEP, out)

    none = F.lit(None).cast("binary")
    if going is None:
        listed = edges.groupBy("node").agg(F.collect_list("nbr").alias("nbr"))

        def packed(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([np.array(v.values.to_numpy(), dtype=np.int64).tobytes() for v in b.column("nbr")], pa.binary())], names=["node", "nbrs"])

        own, reached = vectors.select(F.col("pos").alias("node"), F.lit(b"").alias("found")), listed.mapInArrow(packed, "node bigint, nbrs binary")
    else:
        own = going.select("node", "found")
    both = own.select("node", F.lit(0).alias("kind"), "found", none.alias("nbrs")).unionByName(reached.select("node", F.lit(1).alias("kind"), none.alias("found"), "nbrs"))
    return grouped(both.withColumn("home", F.floor(F.col("node") / NODES_A_GROUP)), "home").applyInArrow(run, _STEP)


#: Candidates of the graph that a group of nodes holds at most, about.
HELD = 1 << 24


class Among(Walk):
    """``Walk`` for which each node meets only what is between ``l`` and ``r`` and what it has ``found``."""

    def __init__(self, node, x, l, r, most, found, k: int, name: str):
        super().__init__(node, x, l, r, most, k, name)
        order = np.argsort(node)
        self.l, self.r = l[order], r[order]
        lists = [np.frombuffer(found[i], dtype=np.int64) for i in order]
        pos, row = np.concatenate(lists), np.repeat(np.arange(len(order), dtype=np.int32), [len(v) for v in lists])
        order = np.argsort(pos, kind="stable")
        self.pos, self.row = pos[order], row[order]

    def allowed(self, first: int, past: int, p: np.ndarray) -> np.ndarray:
        on = (p > self.l[first:past, None]) & (p < self.r[first:past, None])
        order = np.argsort(p)
        own = slice(*np.searchsorted(self.pos, [p[order[0]], p[order[-1]] + 1]))
        pos, row = self.pos[own], self.row[own]
        at = order[np.searchsorted(p[order], pos).clip(max=len(p) - 1)]
        there = (p[at] == pos) & (row >= first) & (row < past)
        on[row[there] - first, at[there]] = True
        return on


def build_near(vectors: DataFrame, graph: DataFrame, k: int, hops: int = HOPS, reach: float = REACH, name: str = "l2sqr", info: list | None = None) -> DataFrame:
    """The index from candidates only: what a graph's steps lead to, as far as ``frontier`` takes each node, and every position between its K-th left and K-th right of them.

    Near keys are exact, since all of them are looked at; far ones are as good as the graph. Only candidates are measured;
    a group of nodes screens all vectors for them, as ``build`` does, since its nodes' candidates together are most of these.
    A node's candidates travel packed, and only their own nodes' lists and the parts of the graph meet.
    """
    vectors = cut(valid(vectors.select(F.col("pos").cast("bigint").alias("pos"), "embedding")))
    nodes = cut(frontier(vectors, graph, k, hops, reach, info))
    held, n = nodes.agg(F.sum(F.octet_length("found") / 8), F.count(F.lit(1))).first()
    rows = max(NODES_A_GROUP, min(-(-n // (4 * vectors.sparkSession.sparkContext.defaultParallelism)), int(HELD * n // max(held or 1, 1)))) if n else None
    own = vectors.join(nodes.withColumnRenamed("node", "pos"), "pos")
    return met(own, vectors, lambda *group: Among(*group, k, name), SCHEMA, rows, found="found")
