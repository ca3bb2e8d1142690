"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash (five words, A-Z lower-cased, 48 bits) below a fixed fraction of all
hashes. So that short documents keep something, the ``FLOOR`` smallest hashes always stay, whatever the
fraction; the sketch then states the bound below which it is complete (for a document of at most
``FLOOR`` different shingles, no bound). Two sketches compare below the smaller of their bounds, where
both are complete, so documents of very unequal sizes compare too, and sketches merge: the union below
the smaller bound is the sketch of the documents' union.

Serialised: base64 of six bytes for the bound and six for each hash, in order.

Defined results: a null text counts as empty; a text of no words has an empty sketch, which is like
another empty one (1.0) and unlike any other (0.0); rows of null doc_id come last in descending order;
rows that repeat a doc_id follow each other in the order of a hash of their texts, so that rows of one id
(or of none), however many, are dealt out by their texts, and only rows that repeat both stay together; the
only row of a table is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lowered, shingle_hashes, shuffle_partitions, span_hashes, table, texts_of, words_of

WORDS = 5
FRACTION = 1 / 16
FLOOR = 64
BITS = 48
OPEN = (1 << BITS) - 1  # the bound of a sketch that has every hash


class Sketch(NamedTuple):
    hashes: np.ndarray  # different, ascending
    bound: int  # every hash below it is there

    def dumps(self) -> str:
        numbers = np.concatenate([[self.bound], self.hashes]).astype(">u8")
        return base64.b64encode(numbers.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()

    @classmethod
    def loads(cls, text: str) -> Sketch:
        raw = np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, 6)
        numbers = np.concatenate([np.zeros((len(raw), 2), dtype=np.uint8), raw], axis=1).copy().view(">u8").ravel().astype(np.int64)
        return cls(numbers[1:], int(numbers[0]))

    def below(self, bound: int) -> np.ndarray:
        return self.hashes if bound >= OPEN else self.hashes[: np.searchsorted(self.hashes, bound)]

    def merge(self, other: Sketch) -> Sketch:
        bound = min(self.bound, other.bound)
        return Sketch(np.union1d(self.below(bound), other.below(bound)), bound)

    def _common(self, other: Sketch) -> tuple[int, int, int]:
        bound = min(self.bound, other.bound)
        a, b = self.below(bound), other.below(bound)
        if not len(a) or not len(b):
            return 0, len(a), len(b)
        at = np.searchsorted(b, a)
        return int((b[np.minimum(at, len(b) - 1)] == a).sum()), len(a), len(b)

    def likeness(self, other: Sketch) -> float:
        """The estimated Jaccard similarity of the documents' shingles."""
        both, a, b = self._common(other)
        return both / (a + b - both) if a + b else 1.0

    def containment(self, other: Sketch) -> float:
        """The estimated share of this document's shingles that the other has."""
        both, a, b = self._common(other)
        return both / a if a else float(not b)


def sketches(data: np.ndarray, offsets: np.ndarray) -> list[Sketch]:
    """The sketch of each row of a string column."""
    data = lowered(data)
    starts, ends, before = words_of(data, offsets)
    hashes, first = shingle_hashes(span_hashes(data, starts, ends), before, WORDS)
    hashes = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    threshold = int(FRACTION * (1 << BITS))
    made = np.diff(first)
    # Of a long row, far fewer hashes can matter; a row where that keeps too few is done again whole.
    ample = np.maximum(threshold, np.where(made > 0, (1 << BITS) / np.maximum(made, 1) * (4 * FLOOR), 0))
    near = hashes < ample[rows]
    out: list[Sketch] = []
    kept_rows, kept = rows[near], hashes[near]
    order = np.lexsort((kept, kept_rows))
    kept_rows, kept = kept_rows[order], kept[order]
    new = np.ones(len(kept), dtype=bool)
    new[1:] = (kept[1:] != kept[:-1]) | (kept_rows[1:] != kept_rows[:-1])
    kept_rows, kept = kept_rows[new], kept[new]
    cuts = np.searchsorted(kept_rows, np.arange(len(made) + 1))
    for k in range(len(made)):
        own = kept[cuts[k] : cuts[k + 1]]
        if ample[k] < OPEN and len(own) <= FLOOR:
            own = np.unique(hashes[first[k] : first[k + 1]])
        if len(own) <= FLOOR:
            out.append(Sketch(own, OPEN))
        else:
            bound = max(threshold, int(own[FLOOR - 1]) + 1)
            out.append(Sketch(own[: np.searchsorted(own, bound)], bound))
    return out


_NULL_ID, _TOP = -(1 << 63), (1 << 63) - 1


def _marked(docs: DataFrame) -> DataFrame:
    """id (never null), mark and text: rows of one id stand in the order of their marks, hashes of their texts of so few bits that percentiles are exact."""
    return docs.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("id"), F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 12).alias("mark"), "text")


def _edges(docs: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Places (id, mark), ascending, that cut the table into about equal parts; the last is the largest.

    An id of so many rows that several cuts fall on it (a null one, say) is cut by marks as well; each of
    these places is a row. Any other cut is behind all rows of its id, of which there is one at least.
    """
    rows = _marked(docs)
    found = rows.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)] or [0.5], 10_000).alias("cuts"), F.max("id").alias("top")).first()
    if found["top"] is None:
        return []
    counts = Counter([*(found["cuts"] or []), found["top"]])
    hot = {id: n for id, n in counts.items() if n > 2}
    edges = [(id, _TOP) for id in counts if id not in hot]
    if hot:
        most = max(hot.values())
        marks = rows.where(F.col("id").isin(list(hot))).groupBy("id").agg(F.percentile_approx("mark", [k / most for k in range(1, most)], 10_000).alias("cuts"), F.max("mark").alias("top"))
        for r in marks.collect():
            step = max(1, most // hot[r["id"]])
            edges += [(r["id"], m) for m in {*r["cuts"][step - 1 :: step], r["top"]}]
    # A cut's id may not be in the table; the largest one below it stands for it.
    plain = sorted(id for id, m in edges if m == _TOP)
    there = {r[0] for r in rows.where(F.col("id").isin(plain)).select("id").distinct().collect()}
    return sorted((id, m) for id, m in edges if m != _TOP or id in there)


def _part_of(edges: list[tuple[int, int]], ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows, the number of the first edge that is not before them, and whether they may be the last row before that edge."""
    edge_ids, edge_marks = (np.array(x, dtype=np.int64) for x in zip(*(edges or [(_TOP, _TOP)]), strict=True))
    part, past = np.searchsorted(edge_ids, ids, side="left"), np.searchsorted(edge_ids, ids, side="right")
    for k in np.unique(part[past > part]):
        own = np.flatnonzero((part == k) & (past > part))
        part[own] = k + np.searchsorted(edge_marks[k : past[own[0]]], marks[own], side="left")
    part = np.minimum(part, len(edge_ids) - 1)
    return part, (edge_ids[part] == ids) & ((edge_marks[part] == _TOP) | (edge_marks[part] == marks))


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, mark, packed text and flags, dealt so that each partition holds a stretch of descending (doc_id, mark) and, as a guest, the first document of the next stretch.

    The texts cross one shuffle, packed. Of the cuts only the places come to the driver, one a partition.
    """
    parts = shuffle_partitions(docs.sparkSession)
    edges = _edges(docs, parts)
    many = max(len(edges), 1)

    def pack(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in chunks(batches, "text"):
            ids, marks = batch.column("id").to_numpy(), batch.column("mark").to_numpy()
            part, last = _part_of(edges, ids, marks)
            data, offsets = texts_of(batch.column("text"))
            texts = [packer.compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            # The last row before an edge is also the guest of the part above it; the largest of all is that of the lowest.
            guests = np.flatnonzero(last)
            rows = np.concatenate([np.arange(len(ids)), guests])
            at = np.concatenate([part, (part[guests] + 1) % many])
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array(rows_guest(len(ids), len(guests)), pa.bool_()), pa.array(ids[rows], mask=ids[rows] == _NULL_ID), pa.array(marks[rows]), pa.array([texts[r] for r in rows], pa.binary())],
                names=["part", "guest", "doc_id", "mark", "packed"],
            )

    rows = _marked(docs).mapInArrow(pack, "part int, guest boolean, doc_id bigint, mark bigint, packed binary")
    return rows.repartitionById(many, F.col("part")).sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), F.desc("mark"))


def rows_guest(own: int, guests: int) -> np.ndarray:
    return np.concatenate([np.zeros(own, dtype=bool), np.ones(guests, dtype=bool)])


def _arrow_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return texts_of(pa.array(texts, pa.string()))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness to each other and to the next document's."""

    def run(batches):
        unpacker = zstandard.ZstdDecompressor()
        held: list[tuple] = []  # rows not yet done, the last of which awaits the row after it
        state = {"sketch": None}

        def emit(rows):
            """All rows but the last, which stays."""
            texts = [r[2] for r in rows]
            edited = []
            for text, after in zip(texts, texts[1:], strict=False):
                n = len(text) // 3
                edited.append(text[: len(text) - n] + after[:n])
            own = [state["sketch"], *sketches(*_arrow_texts(texts[1:]))] if state["sketch"] else sketches(*_arrow_texts(texts))
            changed = sketches(*_arrow_texts(edited))
            state["sketch"] = own[-1]
            n = len(edited)
            keep = [k for k in range(n) if not rows[k][1]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[k][0] for k in keep], pa.int64()),
                    pa.array([len(texts[k]) for k in keep], pa.int64()),
                    pa.array([hashlib.sha256(edited[k].encode()).hexdigest() for k in keep], pa.string()),
                    pa.array([own[k].dumps() for k in keep], pa.string()),
                    pa.array([changed[k].dumps() for k in keep], pa.string()),
                    pa.array([own[k].likeness(changed[k]) for k in keep], pa.float64()),
                    pa.array([own[k].likeness(own[k + 1]) for k in keep], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        part, size = None, 0
        for batch in batches:
            for at, guest, doc, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != part:
                    if len(held) > 1:
                        yield emit(held)
                    held, part, size = [], at, 0
                    state["sketch"] = None
                if guest and held and held[-1][1]:
                    continue  # of rows that repeat the guest's id, the first is next
                held.append((doc, guest, unpacker.decompress(packed).decode()))
                size += len(held[-1][2])
                if size > 1 << 20 and len(held) > 1:
                    yield emit(held)
                    held, size = held[-1:], len(held[-1][2])
        if len(held) > 1:
            yield emit(held)

    return neighbours(docs).select("part", "guest", "doc_id", "packed").mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_fingerprints(spark, sf_dir) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
