"""The two-sided window table: for which (L, R) a set of K points is a node's K nearest.

A row (node, l_lo, l_hi, r_lo, r_hi, pts) holds for l_lo < L <= l_hi and r_lo <= R < r_hi. For each
point in order of distance and each split of K into a left and b right points, the rectangle is that of
the a largest left and b smallest right positions so far, if the point is one of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import interval_index
from .blocks import grouped

SCHEMA = "node bigint, l_lo bigint, l_hi bigint, r_lo bigint, r_hi bigint, pts array<bigint>"


def _rectangles(node: np.ndarray, nbr: np.ndarray, k: int, open_: int) -> list[np.ndarray]:
    """Columns of ``SCHEMA`` (the points as a matrix) for a group's neighbours, ordered by node and nearest first.

    The nodes go on together, a neighbour of each at a time; of those met so far a node keeps the k + 1
    nearest to it by position on either side, of which every rectangle's sides and points are some.
    """
    starts = np.flatnonzero(np.diff(node, prepend=node[:1] - 1))
    sizes, own = np.diff([*starts, len(node)]), node[starts]
    left, right = np.full((len(starts), k + 1), -1), np.full((len(starts), k + 1), open_)
    out = []
    for t in range(sizes.max(initial=0)):
        at = np.flatnonzero(sizes > t)
        p = nbr[starts[at] + t]
        on_left = p < own[at]
        left[at] = -np.sort(-np.column_stack([left[at], np.where(on_left, p, -1)]), axis=1)[:, : k + 1]
        right[at] = np.sort(np.column_stack([right[at], np.where(on_left, open_, p)]), axis=1)[:, : k + 1]
        for a in range(k + 1):
            b = k - a
            l_hi = left[at, a - 1] if a else own[at]
            r_lo = right[at, b - 1] if b else own[at]
            holds = (l_hi >= 0) & (r_lo < open_) & np.where(on_left, p >= l_hi, p <= r_lo)
            x = at[holds]
            out.append((own[x], left[x, a], l_hi[holds], r_lo[holds], right[x, b], np.column_stack([left[x, :a][:, ::-1], right[x, :b]])))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5 + [np.zeros((0, k), np.int64)]


def build(vectors: DataFrame, k: int) -> DataFrame:
    """The table for K = ``k``, from the interval index: a point that is in no one-sided list is in no two-sided one.

    A node's rows come from its index rows alone, so a task holds the lists of its nodes, never pairs.
    """
    index = interval_index.build(vectors, k).select("node", "nbr", "dist")

    def run(t: pa.Table) -> pa.Table:
        node, nbr, dist = (t.column(c).to_numpy() for c in ("node", "nbr", "dist"))
        order = np.lexsort((nbr, dist, node))
        *numbers, points = _rectangles(node[order], nbr[order], k, interval_index.OPEN)
        names = ["node", "l_lo", "l_hi", "r_lo", "r_hi"]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, points.size + 1, k), pa.int32()), pa.array(points.ravel(), pa.int64()))
        return pa.table({**{n: pa.array(c, pa.int64()) for n, c in zip(names, numbers, strict=True)}, "pts": lists})

    return grouped(index.withColumn("part", F.floor(F.col("node") / interval_index.NODES_A_GROUP)), "part").applyInArrow(run, SCHEMA)


def lookup(table: DataFrame, low: int, high: int) -> DataFrame:
    """The K nearest points of each node for a range: node, pts. A node with fewer than K others inside has none."""
    return table.where((F.col("node").between(low, high)) & (F.col("l_lo") < low) & (F.col("l_hi") >= low) & (F.col("r_lo") <= high) & (F.col("r_hi") > high)).select("node", "pts")
