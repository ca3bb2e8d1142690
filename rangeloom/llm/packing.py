"""Best-fit packing of token sequences: best-two-fit.

Every document becomes its ids and an end token; one longer than a sequence is cut into pieces of a whole
sequence, the first of them shorter. What counts for packing is a piece's length alone, so the packing is
planned on the number of pieces of each length, of which there are as many as a sequence has tokens,
whatever the table's size:

* A bin takes the longest pieces left that fit, one after the other (greedily, best fit).
* If a gap remains, the bin's smallest piece gives way to two unpacked ones that together are longer and
  still fit the gap it leaves, the two that fill it most; and so on until no two fill it better.
* The bin found is repeated as often as its lengths last, which is what packing bin by bin would do, so
  a plan of some thousand lines stands for any number of bins.

Pieces of one length are numbered (a running number in the task that encoded them, behind those of the
tasks before), and the number says which bin of the plan is theirs: no group is ever held or sorted.

Defined results: a null text counts as empty, and a document without tokens is its end token alone; a null
doc_id, and rows that repeat, are documents of their own; an empty table gives no rows. A very long text is
encoded in parts; its pieces are rows of their own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import chunks, stored, table
from .tokens import ByteTokens, shared

CAPACITY = 2048
END = 0


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 (and ids), and task and nth: which one of its length it is in the task that made it. Write it before use: task and nth hold for one run."""
    vocabulary = shared(docs.sparkSession, ByteTokens, path)
    key = docs.schema[doc_id].dataType
    fields = [T.StructField("doc_id", key), *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("task", T.IntegerType()), ("nth", T.LongType())))]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches):
        encode, task = vocabulary.value.ids, TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in chunks(batches, text):
            rows, part, start, length, crc, nth, held = [], [], [], [], [], [], []
            for row, x in enumerate(batch.column(text).to_pylist()):
                ids = np.append(encode(x or ""), np.uint32(END)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = ids[a:b]
                    rows.append(row)
                    part.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(own.tobytes()))
                    nth.append(seen[b - a])
                    seen[b - a] += 1
                    held.append(own)
            columns = [batch.column(doc_id).take(pa.array(rows, pa.int64())), pa.array(part, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(np.full(len(rows), task), pa.int32()), pa.array(nth, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, held)]), pa.int32()), pa.array(np.concatenate(held).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(doc_id, text).mapInArrow(run, T.StructType(fields))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Bins for so many pieces of each length: (first bin, how many alike, [(length, pieces of it in each)]), the longest first."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out, bins, top = [], 0, capacity
    sizes = np.flatnonzero(left)
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        own: dict[int, int] = {top: 1}
        gap = capacity - top
        sizes = sizes[left[sizes] > 0]
        at = np.searchsorted(sizes, gap, side="right") - 1
        while gap and at >= 0:
            size = int(sizes[at])
            n = min(gap // size, int(left[size]) - own.get(size, 0))
            if n:
                own[size] = own.get(size, 0) + n
                gap -= n * size
            at = min(at - 1, np.searchsorted(sizes, gap, side="right") - 1)
        while gap and sum(own.values()) > 1:
            small = min(own)
            pair = _two(sizes, left, own, gap + small)
            if pair is None or sum(pair) <= small:
                break
            own[small] -= 1
            if not own[small]:
                del own[small]
            for size in pair:
                own[size] = own.get(size, 0) + 1
            gap += small - sum(pair)
        times = min(int(left[size]) // n for size, n in own.items())
        for size, n in own.items():
            left[size] -= n * times
        out.append((bins, times, sorted(own.items(), reverse=True)))
        bins += times


def _two(sizes: np.ndarray, left: np.ndarray, own: dict[int, int], room: int) -> tuple[int, int] | None:
    """Two unpacked pieces that fill the room most, the longer one first; None if no two fit."""
    free = left[sizes].copy()
    for size, n in own.items():
        free[np.searchsorted(sizes, size)] -= n
    on = sizes[(free > 0) & (sizes < room)]
    if not len(on):
        return None
    single = on[left[on] - np.array([own.get(int(s), 0) for s in on]) < 2]
    # To each the longest that still fits, not longer than itself; one that is there once is no pair of its own.
    most = np.minimum(on, room - on)
    at = np.searchsorted(on, most, side="right") - 1
    at = np.where((at >= 0) & (on[at.clip(0)] == on) & np.isin(on, single), at - 1, at)
    ok = at >= 0
    if not ok.any():
        return None
    total = np.where(ok, on + on[at.clip(0)], 0)
    best = int(total.argmax())
    return int(on[best]), int(on[at[best]])


def placed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``pieces`` (written before), with sequence_id and offset in the place of task and nth."""
    per_task = found.groupBy("length", "task").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    # At most one row a length.
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    lines, used = [], dict.fromkeys(counts, 0)
    for bin_, times, own in plan(counts, capacity):
        at = 0
        for size, n in own:
            lines.append((size, used[size], bin_, n, at))
            used[size] += n * times
            at += n * size
    lines = np.array(sorted(lines), dtype=np.int64).reshape(-1, 5)
    keys = (lines[:, 0] << 44) + lines[:, 1]
    names = [f.name for f in found.schema.fields if f.name not in ("task", "nth")]
    schema = T.StructType([*(found.schema[n] for n in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            number = batch.column("nth").to_numpy() + batch.column("__first").to_numpy()
            line = lines[np.searchsorted(keys, (length << 44) + number, side="right") - 1]
            behind = number - line[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(line[:, 2] + behind // line[:, 3]), pa.array(line[:, 4] + behind % line[:, 3] * length)], names=schema.names)

    return found.join(first, ["length", "task"]).select(*names, "nth", "__first").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of every document and its place: doc_id, piece, start, length, ids_crc32 (ids), sequence_id, offset."""
    return placed(stored(pieces(docs, path, capacity, with_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (array), starts (array: where each document begins in it). A group is one sequence, of a bounded length."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(own.alias("own")).select("sequence_id", F.flatten(F.transform("own", lambda x: x["ids"])).alias("ids"), F.transform("own", lambda x: x["offset"]).alias("starts"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_packing(spark, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_path())
