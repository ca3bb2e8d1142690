"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints that differ in at most two of 64 bits agree in at least two of four 16-bit blocks, so each
of the six pairs of blocks deals the different fingerprints into groups that agree in 32 bits. In a
group, sorted by Gray rank, runs of eight make a node, runs of eight nodes the node above, and so on;
a node knows which bits all below it share. Two nodes are compared on the bits that both share, and a
pair of nodes that already differs in more than two is dropped with all pairs below it; what remains
at the leaves are exact links. Only as many links as connect a group leave it, never its pairs.

A group of more than ``LARGE`` fingerprints is dealt again, by pairs of 8-bit blocks of the bits still
free; then 16 bits are free, so no group can hold more than 65,536 different fingerprints.

Components come from alternating large-star and small-star steps over the links, each written to the
checkpoint folder.

Defined results: a null text counts as empty; a text of no words has fingerprint zero and is linked
like any other; null doc_ids get a component but are nobody's smallest id, and null where all are null;
equal fingerprints of any number collapse before the search; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, chunks, lowered, table, texts_of, words_of

WORDS = 3
SEED = 42
MOST = 2
LARGE = 20_000
_FAN = 8
#: Rows that a task turns into an index at a time, if the last group ends there; pairs that it holds at a time.
_ROWS, _PAIRS = 200_000, 1 << 20


#: The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of spans of bytes, all at once: step by step of the algorithm, for the spans that are long enough for it."""
    data = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    halves = np.ndarray((len(data) - 7,), dtype="<u4", buffer=data, strides=(1,))
    start = np.uint64(seed)
    with np.errstate(over="ignore"):
        at, left = starts.astype(np.int64), (ends - starts).astype(np.int64)
        out = np.full(len(at), start + _P5)
        long = np.flatnonzero(left >= 32)
        if len(long):
            lanes = [np.full(len(long), x) for x in (start + _P1 + _P2, start + _P2, start, start - _P1)]
            todo = np.arange(len(long))
            while len(todo):
                rows = long[todo]
                for k, v in enumerate(lanes):
                    v[todo] = _turned(v[todo] + words[at[rows] + 8 * k] * _P2, 31) * _P1
                at[rows] += 32
                left[rows] -= 32
                todo = todo[left[rows] >= 32]
            total = _turned(lanes[0], 1) + _turned(lanes[1], 7) + _turned(lanes[2], 12) + _turned(lanes[3], 18)
            for v in lanes:
                total = (total ^ (_turned(v * _P2, 31) * _P1)) * _P1 + _P4
            out[long] = total
        out += (ends - starts).astype(np.uint64)
        for _ in range(3):
            rows = np.flatnonzero(left >= 8)
            out[rows] = _turned(out[rows] ^ (_turned(words[at[rows]] * _P2, 31) * _P1), 27) * _P1 + _P4
            at[rows] += 8
            left[rows] -= 8
        rows = np.flatnonzero(left >= 4)
        out[rows] = _turned(out[rows] ^ (halves[at[rows]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[rows] += 4
        left[rows] -= 4
        for _ in range(3):
            rows = np.flatnonzero(left > 0)
            out[rows] = _turned(out[rows] ^ (data[at[rows]].astype(np.uint64) * _P5), 11) * _P1
            at[rows] += 1
            left[rows] -= 1
        out = (out ^ (out >> np.uint64(33))) * _P2
        out = (out ^ (out >> np.uint64(29))) * _P3
        return out ^ (out >> np.uint64(32))


def fingerprints_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of each row."""
    data = lowered(data)
    starts, ends, before = words_of(data, offsets)
    n = len(offsets) - 1
    if not len(starts):
        return np.zeros(n, dtype=np.uint64)
    # The words of all rows, each followed by one blank.
    sizes = ends - starts + 1
    place = np.cumsum(sizes) - sizes
    source = np.repeat(starts - place, sizes) + np.arange(sizes.sum())
    text = data[np.minimum(source, len(data) - 1)]
    text[place + sizes - 1] = 0x20
    counts = np.diff(before)
    made = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(made)])
    a = np.arange(first[-1]) - np.repeat(first[:-1] - before[:-1], made)
    b = np.minimum(a + WORDS, np.repeat(before[1:], made)) - 1
    low, high = place[a], place[b] + sizes[b] - 1
    out = np.zeros(n, dtype=np.uint64)
    some = np.flatnonzero(made)
    # Bits are counted a stretch of shingles at a time, and of those up to 255 of a row, eight counts in a number; a long row's add up.
    counted = np.zeros((n, 64), dtype=np.int64)
    rows = np.repeat(np.arange(n), made)
    for k in range(0, len(low), 1 << 16):
        hashes = xxh64(text, low[k : k + (1 << 16)], high[k : k + (1 << 16)])
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        own = rows[k : k + (1 << 16)]
        begins = np.flatnonzero(np.diff(own, prepend=-1))
        at = np.flatnonzero((np.arange(len(own)) - np.repeat(begins, np.diff(np.append(begins, len(own))))) % 255 == 0)
        sums = np.add.reduceat(bits.view(np.uint64), at, axis=0).view(np.uint8)
        few = np.flatnonzero(np.diff(own[at], prepend=-1))
        counted[own[at[few]]] += np.add.reduceat(sums, few, axis=0, dtype=np.int64)
    out[some] = np.packbits(counted[some] * 2 > made[some][:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and fp, the fingerprint as a signed 64-bit number."""
    docs = docs.select(*keep, "text")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in chunks(batches, "text"):
            found = fingerprints_of(*texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found.view(np.int64))], names=[*keep, "fp"])

    return docs.mapInArrow(run, schema)


def gray_rank(x):
    """The rank of a 64-bit number in Gray order."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return x


def _masks(bits: list[int], blocks: int) -> list[int]:
    """For each pair of equal blocks of these bits, a mask of its bits, as a signed number."""
    size = len(bits) // blocks
    parts = [sum(1 << b for b in bits[k * size : (k + 1) * size]) for k in range(blocks)]
    return [m - (1 << 64) if m >> 63 else m for m in (x | y for x, y in itertools.combinations(parts, 2))]


_COARSE = _masks(list(range(64)), 4)
_FINE = [_masks([b for b in range(64) if not (m >> b) & 1], 4) for m in _COARSE]


def groups(distinct: DataFrame) -> DataFrame:
    """fp and the group keys (g, key) under which it meets others."""
    coarse = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _COARSE])).alias("g", "key"))
    large = coarse.groupBy("g", "key").count().where(F.col("count") > LARGE).select("g", "key", F.lit(True).alias("large"))
    marked = coarse.join(large, ["g", "key"], "left")
    fine = F.coalesce(
        *[F.when(F.col("g") == g, F.array(*[F.struct(F.lit(10 + g * 6 + k).alias("g"), F.col("fp").bitwiseAND(F.lit(_signed(_COARSE[g] | m))).alias("key")) for k, m in enumerate(ms)])) for g, ms in enumerate(_FINE)]
    )
    own = F.array(F.struct(F.col("g").alias("g"), F.col("key").alias("key")))
    return marked.select("fp", F.explode(F.when(F.coalesce("large", F.lit(False)), fine).otherwise(own)).alias("x")).select("fp", "x.g", "x.key")


def _signed(m: int) -> int:
    m &= (1 << 64) - 1
    return m - (1 << 64) if m >> 63 else m


def index_links(fps: np.ndarray, group: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within ``most`` bits of each other in the same group. ``group`` ascends; within it ``fps`` are different and in Gray order."""
    # Levels, leaves first: bits set in all below and bits set in any below, the group, and where each node's children begin.
    every, any_, of = [fps], [fps], [group]
    children: list[np.ndarray] = []
    while True:
        n = len(of[-1])
        new = np.flatnonzero(np.diff(of[-1], prepend=of[-1][:1] - 1))
        if len(new) == n:
            break
        place = np.arange(n) - np.repeat(new, np.diff(np.append(new, n)))
        starts = np.flatnonzero(place % _FAN == 0)
        children.append(np.append(starts, n))
        every.append(np.bitwise_and.reduceat(every[-1], starts))
        any_.append(np.bitwise_or.reduceat(any_[-1], starts))
        of.append(of[-1][starts])
    top = len(of) - 1
    found_a, found_b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    if not top:
        return found_a[0], found_b[0]
    roots = np.arange(len(of[top]))
    stack = [(top, roots, roots)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > _PAIRS // 64:
            half = len(a) // 2
            stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        cut = children[level - 1]
        na, nb = cut[a + 1] - cut[a], cut[b + 1] - cut[b]
        many = na * nb
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        width = np.repeat(nb, many)
        x, y = np.repeat(cut[a], many) + k // width, np.repeat(cut[b], many) + k % width
        level -= 1
        own = x < y if level == 0 else x <= y
        x, y = x[own], y[own]
        # Bits that both nodes share below them; at the leaves, all bits.
        shared = ~(every[level][x] ^ any_[level][x]) & ~(every[level][y] ^ any_[level][y])
        near = np.bitwise_count((every[level][x] ^ every[level][y]) & shared) <= most
        x, y = x[near], y[near]
        if level == 0:
            found_a.append(x)
            found_b.append(y)
        elif len(x):
            stack.append((level, x, y))
    return np.concatenate(found_a), np.concatenate(found_b)


def _connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n positions, the smallest position that the pairs connect it with."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        on = low < high
        if not on.any():
            break
        np.minimum.at(root, high[on], low[on])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        a, b = a[on], b[on]
    return root


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (u, v) of fingerprints that link, as many as connect what the links connect."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def done(rows: list[pa.RecordBatch]):
            t = pa.Table.from_batches(rows)
            fps = t.column("fp").to_numpy().view(np.uint64)
            g, key = t.column("g").to_numpy(), t.column("key").to_numpy()
            group = np.cumsum(np.diff(g, prepend=g[:1]).astype(bool) | np.diff(key, prepend=key[:1]).astype(bool))
            many = np.bincount(group, minlength=1)[group] > 1
            fps, group = fps[many], group[many]
            a, b = index_links(fps, group)
            root = _connected(len(fps), a, b)
            moved = np.flatnonzero(root != np.arange(len(fps)))
            return pa.RecordBatch.from_arrays([pa.array(fps[moved].view(np.int64)), pa.array(fps[root[moved]].view(np.int64))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < _ROWS:
                continue
            # Up to where the last group begins.
            t = pa.Table.from_batches(held).combine_chunks()
            g, key = t.column("g").to_numpy(), t.column("key").to_numpy()
            change = np.flatnonzero(np.diff(g).astype(bool) | np.diff(key).astype(bool))
            if len(change):
                cut = int(change[-1]) + 1
                yield done(t.slice(0, cut).to_batches())
                held, size = t.slice(cut).to_batches(), t.num_rows - cut
        if held:
            yield done(held)

    met = groups(distinct).repartition("g", "key").sortWithinPartitions("g", "key", gray_rank(F.col("fp")))
    return met.select("fp", "g", "key").mapInArrow(run, "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u and v for each node u of the edges (u, v) that is not the smallest of its component, which is v."""
    tidy = lambda df: df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())
    edges = checkpointed(tidy(edges))
    was = state(edges)
    while was[0]:
        # Large star: all larger neighbours of a node move to its smallest neighbour (or itself).
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("__v")).select("u", F.least("u", "__v").alias("m"))
        edges = tidy(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # Small star: all smaller neighbours of a node, and the node, move to the smallest of them.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(tidy(moved.unionByName(least.select("u", F.col("m").alias("v")))))
        now = state(edges)
        if now == was:
            break
        was = now
    return edges


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, fp, component_id and top (the component's smallest fp) of each document; few numbers a document cross any shuffle."""
    marked = checkpointed(fingerprints(docs, keep))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = components(links(distinct.select("fp")))
    named = distinct.join(found.select(F.col("u").alias("fp"), F.col("v").alias("top")), "fp", "left").withColumn("top", F.coalesce("top", "fp"))
    smallest = named.groupBy("top").agg(F.min("rep").alias("component_id"))
    by_fp = named.join(smallest, "top").select("fp", "component_id", "top")
    return marked.join(by_fp, "fp").select(*keep, "fp", "component_id", "top")


def first_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without near-duplicates: of each component, the row of smallest doc_id stays (of rows that repeat it, one)."""
    mark = F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")
    found = near_duplicates(docs.select("doc_id", "text", mark), ("doc_id", "mark"))
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("top").agg(F.min("mark").alias("kept"), F.first("component_id").alias("id")).select("id", "kept")
    # A row travels as one column, so its columns may have any names.
    wide = docs.select("doc_id", mark, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = wide.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("kept")), "left_semi")
    return own.dropDuplicates(["doc_id", "mark"]).select("row.*")


def op7_simhash(spark, sf_dir) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
