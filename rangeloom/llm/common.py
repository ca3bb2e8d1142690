"""What the operators share: reading tables, cutting lineage, and texts as byte arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, shared_folder

#: Bytes of text that a worker turns into arrays at a time; a single longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder's checkpoints."""
    return cut(df)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder (a new place, or one that is named) and read again."""
    spark = df.sparkSession
    path = path or new_place(spark)
    df.write.parquet(path)
    return spark.read.parquet(path)


def new_place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def added(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind as keep it apart from the columns of ``df`` (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def below_share(mark, share: float):
    """Whether a 64-bit hash is among the smallest ``share`` of all hashes."""
    return mark < F.lit(min(int(share * 2**64) - 2**63, 2**63 - 1)) if share < 1 else F.lit(True)


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0] if len(offsets) else offsets


def chunks(batches: Iterator[pa.RecordBatch], *columns: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes in ``columns`` at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        for name in columns:
            sizes += np.diff(texts_of(batch.column(name))[1])
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z made lower case."""
    return _LOWER[data]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and how many words stand before each row (rows + 1 numbers)."""
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[firsts[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
    return out[:n]


#: Bytes of text whose words are hashed at a time; hashing needs about 40 bytes for each of them.
STRETCH = 1 << 20


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; spans ascend. A stretch of bytes at a time, each by one prefix sum, so that a very long text needs little more than itself (but a span longer than a stretch is hashed at once)."""
    out = np.empty(len(starts), dtype=np.uint64)
    cuts = np.append(np.flatnonzero(np.diff(starts // STRETCH, prepend=-1)), len(starts))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        low, high = int(starts[a]), int(ends[b - 1])
        own = data[low:high]
        first, past = starts[a:b] - low, ends[a:b] - low
        with np.errstate(over="ignore"):
            sums = np.zeros(len(own) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_CODE[own] * powers(_BASE, len(own)), out=sums[1:])
            back = powers(_BASE_INVERSE, len(own) + 1)
            out[a:b] = mixed((sums[past] - sums[first]) * back[first] + (past - first).astype(np.uint64))
    return out


def shingle_hashes(words: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` neighbouring words, and how many shingles stand before each row. A row of fewer words makes one shingle of all its words, a row of none makes none."""
    counts = np.diff(before)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.zeros(len(made) + 1, dtype=np.int64)
    np.cumsum(made, out=first[1:])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - before[:-1], made)
    total = np.zeros(len(at), dtype=np.uint64)
    long = np.repeat(counts >= width, made)
    reach = np.repeat(before[1:], made)
    with np.errstate(over="ignore"):
        for k in range(width):
            there = at + k
            ok = there < reach
            total[ok] = total[ok] * np.uint64(_BASE) + words[there[ok]]
        del long
        return mixed(total), first
