"""Distances between vectors as columns, and numpy kernels for blocks of them.

The column forms stay inside the JVM. ``unrolled`` writes one term a dimension, which whole-stage
code generation compiles; the higher-order forms take vectors of any length. All arithmetic is double.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms that generated code still holds in one method's reach.
MOST_TERMS = 128


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def l2sqr(a: Column, b: Column, start: int = 0, length: int | None = None) -> Column:
    """Squared L2, over all dimensions or ``length`` of them from ``start`` (from 0)."""
    if length is not None:
        a, b = F.slice(a, start + 1, length), F.slice(b, start + 1, length)
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm2(a: Column) -> Column:
    """The squared norm."""
    return _sum(F.transform(doubles(a), lambda x: x * x))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2sqr(a, b))


def inner_product_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b)


def integer_l2sqr(a: Column, b: Column) -> Column:
    """Squared L2 of whole-number vectors, as a whole number."""
    whole = lambda v: v.cast("array<bigint>")
    return F.aggregate(F.zip_with(whole(a), whole(b), lambda x, y: (x - y) * (x - y)), F.lit(0).cast("bigint"), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """The vector over its norm; a zero vector stays zero."""
    size = F.sqrt(norm2(v))
    return F.transform(doubles(v), lambda x: F.when(size == 0, x).otherwise(x / size))


def unrolled(a: Column, b: Column, dimensions: int) -> Column:
    """Squared L2 of vectors of a known length, one term a dimension; longer ones the higher-order way."""
    if dimensions > MOST_TERMS:
        return l2sqr(a, b)
    out = F.lit(0.0)
    for k in range(dimensions):
        gap = F.get(a, F.lit(k)).cast("double") - F.get(b, F.lit(k)).cast("double")
        out = out + gap * gap
    return out


def cosine_distance(a: Column, b: Column) -> Column:
    """One less the cosine; 1 where either vector is zero."""
    size = F.sqrt(norm2(a) * norm2(b))
    return 1 - F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


METRICS: dict[str, Callable[[Column, Column], Column]] = {"l2sqr": l2sqr, "l2": l2, "ip": inner_product_distance, "cosine": cosine_distance}


def metric(name: str) -> Callable[[Column, Column], Column]:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {sorted(METRICS)}")
    return METRICS[name]


def block_distances(x: np.ndarray, y: np.ndarray, name: str = "l2sqr") -> np.ndarray:
    """All distances between the rows of two blocks."""
    metric(name)
    if name == "ip":
        return 1 - x @ y.T
    if name == "cosine":
        size = np.sqrt(np.einsum("ij,ij->i", x, x)[:, None] * np.einsum("ij,ij->i", y, y))
        return 1 - np.divide(x @ y.T, size, out=np.zeros(size.shape), where=size > 0)
    out = np.empty((len(x), len(y)))
    step = max(1, (1 << 22) // max(1, y.size))
    for k in range(0, len(x), step):
        gap = x[k : k + step, None, :] - y[None, :, :]
        out[k : k + step] = np.einsum("ijk,ijk->ij", gap, gap)
    return np.sqrt(out) if name == "l2" else out


def row_distances(x: np.ndarray, y: np.ndarray, name: str = "l2sqr") -> np.ndarray:
    """The distances between rows of the same number."""
    metric(name)
    if name in ("ip", "cosine"):
        dots = np.einsum("ij,ij->i", x, y)
        if name == "ip":
            return 1 - dots
        size = np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        return 1 - np.divide(dots, size, out=np.zeros(len(size)), where=size > 0)
    gap = x - y
    out = np.einsum("ij,ij->i", gap, gap)
    return np.sqrt(out) if name == "l2" else out
