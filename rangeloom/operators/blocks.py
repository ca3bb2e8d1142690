"""All of one table with all of another: a nested loop over vectors, in pieces that fit a task.

Nodes are cut into groups by position, the data into packed blocks. A group is one task: it meets every block
in turn, outwards from its own positions, and keeps what it needs of it (a few neighbours for each node). So
nothing but vectors travels, each as often as there are groups, and no task ever holds more than
its group and a block. A matrix product screens a block; what may count is measured exactly.

``valid`` says which vectors an operator works on: those that are not null, not empty, hold neither nulls
nor NaN nor infinities, and are all of one length. The first three kinds are left out everywhere (they are
near to nothing); vectors of several lengths are refused.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import metric, row_distances


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a list column as rows of doubles; nulls, null components and several lengths are refused."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    values = column.flatten()
    sizes = np.diff(column.offsets.to_numpy())
    if column.null_count or values.null_count or (sizes != sizes[0]).any():
        raise ValueError("vectors must not be null, hold no nulls, and be of one length; leave out the others first (blocks.valid)")
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def is_valid(embedding="embedding"):
    """Whether a vector can be compared: not null, not empty, all components finite."""
    x = F.col(embedding)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)), F.lit(False))


def valid(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """The rows whose vectors can be compared."""
    return vectors.where(is_valid(embedding))


def grouped(df: DataFrame, *keys: str):
    """``df`` grouped by some columns, in as many partitions as the session's shuffles have, whatever its bytes: what is done with a group costs far more than reading it, so small partitions are not put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).groupBy(*keys)


#: Nodes of a group at most and at least; between these the groups keep every core busy some times.
GROUP_ROWS, LEAST_GROUP = 8192, 128
#: Vectors of a packed block, and of a step within a group's own stretch, where bounds still change much.
PACK_ROWS, STEP = 512, 64
#: Pairs of vectors that are measured at a time.
STRIP = 1 << 16
_PACKED = "block bigint, dim int, pos binary, x binary, l binary, r binary, most binary, found array<binary>"
_LOWEST, _HIGHEST = -(2**63), 2**63 - 1


class Screen:
    """Nodes, and for each a bound that is to be beaten: which (node, vector) pairs may be within it.

    One matrix product in single precision says so for a whole block; its rounding is allowed for, so no pair is lost, and the
    few that are left are measured exactly (``row_distances``). A higher bound lets more through.
    """

    def __init__(self, x: np.ndarray, bound: np.ndarray, name: str):
        metric(name)
        self.name, self.angle = name, name in ("ip", "cosine")
        self.slack = (x.shape[1] + 16) * 2.0**-22
        self.x, self.bound = x, bound.astype(np.float64)
        own, size = self._sized(x)
        self.wide = not self._safe(size)
        self.kind = np.float64 if self.wide else np.float32
        self.side = np.empty((len(x), x.shape[1] + 2), dtype=self.kind)
        self.side[:, :-2] = -own if self.angle else -2 * own
        self.side[:, -2] = 1
        self.least = (1 - self.slack * (size + 1) if self.angle else size * (1 - 2 * self.slack)) - 1e-30
        self.set(np.arange(len(x)), self.bound)

    def _sized(self, x):
        size = np.einsum("ij,ij->i", x, x)
        if self.name != "cosine":
            return x, size
        length = np.sqrt(size)[:, None]
        return np.divide(x, length, out=np.zeros(x.shape), where=length > 0), np.minimum(size, 1.0)

    @staticmethod
    def _safe(size) -> bool:
        """Whether squares are well within the range of single precision."""
        return not len(size) or bool(np.isfinite(size).all() and 1e-20 < size.max() < 1e30)

    def set(self, rows: np.ndarray, bound: np.ndarray) -> None:
        """New bounds of some nodes."""
        self.bound[rows] = bound
        # A bound of none lets everything through, also where squares overflow.
        with np.errstate(over="ignore", invalid="ignore"):
            far = bound * bound if self.name == "l2" else bound
            self.side[rows, -1] = np.maximum(self.least[rows] - far - self.slack * np.abs(far), -np.finfo(self.kind).max / 2)

    def block(self, y: np.ndarray) -> np.ndarray:
        """What ``within`` takes of some vectors."""
        own, size = self._sized(y)
        if not self.wide and not self._safe(size):
            self.wide, self.kind = True, np.float64
            self.side = self.side.astype(np.float64)
            self.side[:, :-2] = (-1 if self.angle else -2) * self._sized(self.x)[0]
            self.set(np.arange(len(self.x)), self.bound)
        out = np.empty((len(y), y.shape[1] + 2), dtype=self.kind)
        out[:, :-2], out[:, -1] = own, 1
        out[:, -2] = -self.slack * size if self.angle else size * (1 - 2 * self.slack)
        return out

    def within(self, first: int, past: int, y: np.ndarray) -> np.ndarray:
        """For nodes from ``first`` to before ``past`` and a block, which pairs may be within the bounds."""
        with np.errstate(over="ignore", invalid="ignore"):
            return ~((self.side[first:past] @ y.T) > 0)

    def measured(self, rows: np.ndarray, y: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Exact distances of some pairs."""
        if not len(rows):
            return np.zeros(0)
        return np.concatenate([row_distances(self.x[rows[k : k + STRIP]], y[columns[k : k + STRIP]], self.name) for k in range(0, len(rows), STRIP)])


def firsts(rows: np.ndarray, far: np.ndarray, ties: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest entries of each row, in order, and their places (from 0); equal ones by ``ties``."""
    order = np.lexsort((ties, far, rows))
    place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
    return order[place < k], place[place < k]


def lessen(best: np.ndarray, rows: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Distances put into their rows' ``k`` least; which rows there are."""
    k = best.shape[1]
    order, place = firsts(rows, far, far, k)
    own, at = np.unique(rows[order], return_inverse=True)
    come = np.full((len(own), k), np.inf)
    come[at, place] = far[order]
    best[own] = np.partition(np.concatenate([best[own], come], axis=1), k - 1, axis=1)[:, :k]
    return own


class Nearest:
    """A group's nodes and the ``k`` nearest of the vectors that they have met so far, within ``most`` and among the positions from l to r."""

    def __init__(self, node, x, l, r, most, k: int, name: str, with_self: bool):
        self.node, self.l, self.r, self.most, self.k, self.with_self = node, l, r, most, k, with_self
        self.ranged = bool((l > _LOWEST).any() or (r < _HIGHEST).any())
        self.screen, self.best = Screen(x, most, name), np.full((len(node), k), np.inf)
        self.rows, self.held = [], 0

    def add(self, pos: np.ndarray, y: np.ndarray, own: bool) -> None:
        for a in range(0, len(pos), STEP if own else PACK_ROWS):
            p, z = (c[a : a + (STEP if own else PACK_ROWS)] for c in (pos, y))
            near = self.screen.within(0, len(self.node), self.screen.block(z))
            if self.ranged:
                near &= (p >= self.l[:, None]) & (p <= self.r[:, None])
            i, c = divmod(np.flatnonzero(near), len(p))
            if not self.with_self:
                other = self.node[i] != p[c]
                i, c = i[other], c[other]
            d = self.screen.measured(i, z, c)
            on = (d <= self.screen.bound[i]) & np.isfinite(d)
            if on.any():
                i, c, d = i[on], c[on], d[on]
                self.rows.append((i, p[c], d))
                self.held += len(i)
                changed = lessen(self.best, i, d)
                self.screen.set(changed, np.minimum(self.best[changed].max(axis=1), self.most[changed]))
                if self.held > 64 * self.k * len(self.node):
                    self._first()

    def _first(self) -> np.ndarray:
        i, p, d = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        order, place = firsts(i, d, p, self.k)
        self.rows, self.held = [(i[order], p[order], d[order])], len(order)
        return place

    def close(self):
        if self.rows:
            place = self._first()
            i, p, d = self.rows[0]
            yield pa.table({"node": pa.array(self.node[i]), "nbr": pa.array(p), "dist": pa.array(d), "rank": pa.array(place + 1, pa.int32())})


def met(nodes: DataFrame | None, data: DataFrame, start: Callable, schema: str, rows: int | None = None, most: str | None = None, found: str | None = None) -> DataFrame:
    """Every group of nodes meets all data: ``start(node, x, l, r, most)`` makes what is given the data block by block (``add(pos, y, own)``, outwards from the group's own positions, blocks among these first) and then yields the group's tables (``close()``).

    Both are (pos, embedding); without ``nodes``, all data are nodes too. Nodes may have l and r (positions, null for none) and
    a bound of distance in the column ``most``; a packed list a node in the column ``found`` is given to ``start`` as well. Vectors are packed, and a block is sent once to each group, of which
    there are n / ``GROUP_ROWS`` and some a core at least; a task holds its group and one block, and what
    leaves it is done with: no candidates travel.
    """
    spark, same = data.sparkSession, nodes is None
    data = valid(data.select(F.col("pos").cast("bigint").alias("pos"), "embedding"))
    if same:
        nodes = data
    else:
        given = lambda c, kind: (F.col(c) if c in nodes.columns else F.lit(None)).cast(kind).alias(c)
        nodes = valid(nodes.select(F.col("pos").cast("bigint").alias("pos"), "embedding", given("l", "bigint"), given("r", "bigint"), (F.col(most) if most else F.lit(None)).cast("double").alias("most"), *([F.col(found).alias("found")] if found else [])))
    first, last, n = nodes.agg(F.min("pos"), F.max("pos"), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], schema)
    spread = max(1, round((last - first + 1) / n))  # positions a node
    size = rows or min(GROUP_ROWS, max(LEAST_GROUP, -(-n // (4 * spark.sparkContext.defaultParallelism))))
    pack = min(PACK_ROWS, size)
    group = -(-size // pack) * pack * spread
    low = first // group
    groups = last // group - low + 1

    def packed(df, span):
        one = {f.name: f.dataType for f in df.schema.fields}["embedding"].elementType.simpleString()
        kind = "<f4" if one == "float" else "<f8"

        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by("pos")
            x, out = matrix(t.column("embedding")), []
            filled = lambda c, other: pc.fill_null(t.column(c), other).to_numpy().tobytes() if c in t.column_names else b""
            l, r, far = filled("l", _LOWEST), filled("r", _HIGHEST), filled("most", np.inf)
            out = {"block": [t.column("block")[0].as_py()], "dim": [x.shape[1]], "pos": [t.column("pos").to_numpy().tobytes()], "x": [x.astype(kind).tobytes()], "l": [l], "r": [r], "most": [far]}
            out["found"] = [t.column("found").to_pylist() if "found" in t.column_names else None]
            return pa.table({c: pa.array(v, _ARROW[c]) for c, v in out.items()})

        return grouped(df.withColumn("block", F.floor(F.col("pos") / span).cast("bigint")), "block").applyInArrow(run, _PACKED), kind

    span = pack * spread
    own, own_kind = packed(nodes, span)
    theirs, their_kind = (own, own_kind) if same else packed(data, span)
    at = F.col("block") * F.lit(span).cast("bigint")
    own = own.select((F.floor(at / group) - low).cast("int").alias("group"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("away"), *[c.split()[0] for c in _PACKED.split(", ")])
    begin = (F.col("group").cast("bigint") + low) * F.lit(group).cast("bigint")
    away = F.greatest(begin - at, at - begin - group + span, F.lit(0)).cast("bigint")
    theirs = theirs.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(F.col("group").cast("int").alias("group"), F.lit(1).alias("kind"), away.alias("away"), *[c.split()[0] for c in _PACKED.split(", ")])

    def run(batches):
        here = task = None
        members = []
        for b in batches:
            c = {name: b.column(name) for name in b.schema.names}
            for i in range(b.num_rows):
                group_ = c["group"][i].as_py()
                if group_ != here:
                    if task is not None:
                        yield from _batches(task)
                    here, task, members = group_, None, []
                mine = c["kind"][i].as_py() == 0
                pos = np.frombuffer(c["pos"][i].as_buffer(), dtype=np.int64)
                x = np.frombuffer(c["x"][i].as_buffer(), dtype=own_kind if mine else their_kind).astype(np.float64).reshape(len(pos), c["dim"][i].as_py())
                if mine:
                    rest = [np.frombuffer(c[k][i].as_buffer(), dtype=kind) for k, kind in (("l", np.int64), ("r", np.int64), ("most", np.float64))]
                    rest = [v if len(v) else np.full(len(pos), other, dtype=v.dtype) for v, other in zip(rest, (_LOWEST, _HIGHEST, np.inf), strict=True)]
                    members.append((pos.copy(), x, *[v.copy() for v in rest], *([np.array(c["found"][i].as_py(), dtype=object)] if found else [])))
                    continue
                if task is None:
                    if not members:
                        continue
                    if len({m[1].shape[1] for m in members}) > 1:
                        raise ValueError("vectors of several lengths")
                    task = start(*[np.concatenate(v) for v in zip(*members, strict=True)])
                    wide = members[0][1].shape[1]
                if x.shape[1] != wide:
                    raise ValueError("vectors of several lengths")
                task.add(pos, x, c["away"][i].as_py() == 0)
        if task is not None:
            yield from _batches(task)

    return own.unionByName(theirs).repartitionById(int(groups), F.col("group")).sortWithinPartitions("group", "kind", "away", "block").mapInArrow(run, schema)


_ARROW = {"block": pa.int64(), "dim": pa.int32(), "pos": pa.binary(), "x": pa.binary(), "l": pa.binary(), "r": pa.binary(), "most": pa.binary(), "found": pa.list_(pa.binary())}


def _batches(task):
    for t in task.close():
        yield from t.combine_chunks().to_batches(max_chunksize=1 << 16)


def nearest_of(nodes: DataFrame | None, data: DataFrame, k: int, name: str = "l2sqr", with_self: bool = False, most: str | None = None, rows: int | None = None) -> DataFrame:
    """The ``k`` nearest of all data to each node, exactly: node, nbr, dist, rank."""
    return met(nodes, data, lambda node, x, l, r, far: Nearest(node, x, l, r, far, k, name, with_self), "node bigint, nbr bigint, dist double, rank int", rows, most)


def nearest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` smallest finite entries of each row, nearest first, ties by column."""
    if not d.size:
        return (np.zeros(0, dtype=np.int64),) * 2
    least = min(k, d.shape[1]) - 1
    bound = np.partition(d, least, axis=1)[:, least]
    r, c = np.nonzero((d <= bound[:, None]) & np.isfinite(d))
    order = np.lexsort((c, d[r, c], r))
    r, c = r[order], c[order]
    on = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[on], c[on]
