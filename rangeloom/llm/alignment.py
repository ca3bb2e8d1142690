"""Cross-tokenizer alignment: which tokens of one vocabulary (A) stand for the same bytes as which of another (B).

A's tokens and B's tokens both cover the bytes of a text (with a space before it). B's ranges make a static
interval index: they are disjoint and ascend, so two sorted arrays, of starts and of ends, are all of it. Each A
token stabs it by two bisections, which give the first and the last B token it overlaps; the gaps between B tokens
that it spans are marked in a difference array. A gap that no A token spans ends a group, and there an A and a B
token end together: a link.

How often a pair of ids is linked is a count over all documents. Documents are worked on in blocks of some
megabytes; a block keeps its different pairs, counted, and each document's links as numbers of these, compressed. The
pairs of all blocks are added up, each B id's highest count is found, and what was found goes back to the
blocks, so that a pair crosses the cluster once a block, not once a link, and the most common pair has as many rows as
there are blocks.

Defined results: a null or empty text, and one whose bytes the tokens of either vocabulary do not give back
(U+2581, bytes that are not UTF-8), has no tokens: zeros and an empty groups_sha256. Rows that repeat, null
doc_ids among them, are documents of their own; an empty table gives no rows. A very long text is encoded in
parts and is a block of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import CHUNK_BYTES, chunks, stored, table, texts_of
from .tokens import ByteTokens, PieceTokens, parts, shared

#: Bytes of text in a block, unless one text is longer.
BLOCK_BYTES = 8 << 20


def overlaps(a_ends: np.ndarray, a_starts: np.ndarray, b_ends: np.ndarray, b_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A range, the first and the last B range it overlaps, by bisection of the sorted starts and ends."""
    return np.searchsorted(b_ends, a_starts, side="right"), np.searchsorted(b_starts, a_ends, side="left") - 1


def group_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The A and the B token that each group ends with; both cover the same bytes from 0 on, and no token is empty."""
    a_starts, b_starts = (np.concatenate([[0], x[:-1]]) if len(x) else x for x in (a_ends, b_ends))
    first, last = overlaps(a_ends, a_starts, b_ends, b_starts)
    spans = np.bincount(first, minlength=len(b_ends) + 1) - np.bincount(last, minlength=len(b_ends) + 1)
    b_last = np.flatnonzero(np.cumsum(spans)[: len(b_ends)] == 0)
    return np.searchsorted(a_ends, b_ends[b_last]), b_last


class Aligner:
    """Two vocabularies and the decimal strings of their ids."""

    def __init__(self, a: ByteTokens, b: PieceTokens):
        self.a, self.b = a, b
        own = [f"{k}{end}".encode() for n, ends in ((len(a.bytes), ",|"), (len(b.bytes), ",;")) for k in range(n) for end in ends]
        self.strings = np.array(own, dtype=object)

    def encoded(self, raws: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of both vocabularies, none for a text that they do not give back."""
        texts = [raw.decode(errors="replace") for raw in raws]
        cut = [parts(t) if t else [] for t in texts]
        found, pieces = iter(self.b.many([p for ps in cut for p in ps])), []
        for ps in cut:
            pieces.append(np.array([x for _ in ps for x in next(found)], dtype=np.uint32))
        ids = [self.a.ids(" " + t, special=False) if t else np.zeros(0, dtype=np.uint32) for t in texts]
        none = np.zeros(0, dtype=np.uint32)
        for k, raw in enumerate(raws):
            whole = b" " + raw
            if raw and not all(b"".join(map(v.bytes.__getitem__, x[k].tolist())) == whole for v, x in ((self.a, ids), (self.b, pieces))):
                ids[k] = pieces[k] = none
        return ids, pieces

    def aligned(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Per text n_a, n_b, n_groups and the groups' hash; and the links of all texts, one after the other, as A id << 32 | B id."""
        ids, pieces = self.encoded(raws)
        n_a, n_b = (np.array([len(x) for x in own]) for own in (ids, pieces))
        a, b = (np.concatenate([np.zeros(0, dtype=np.uint32), *own]).astype(np.int64) for own in (ids, pieces))
        a_ends, b_ends = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        # Both cover the same bytes in every text, so the texts' own ends are ends of groups.
        a_last, b_last = group_ends(a_ends, b_ends) if len(a) else (np.zeros(0, dtype=np.int64),) * 2
        past_a, past_b = np.cumsum(n_a), np.cumsum(n_b)
        per = np.diff(np.searchsorted(b_last, past_b), prepend=0) if len(b) else np.zeros(len(raws), dtype=np.int64)
        # A group's A tokens, then its B tokens.
        size_a, size_b = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
        before_a, before_b = b_last + 1 - size_b, a_last + 1
        code = np.empty(len(a) + len(b), dtype=np.int64)
        at_a, at_b = np.arange(len(a)) + np.repeat(before_a, size_a), np.arange(len(b)) + np.repeat(before_b, size_b)
        code[at_a], code[at_b] = 2 * a, 2 * (b + len(self.a.bytes))
        code[at_a[a_last]] += 1
        code[at_b[b_last]] += 1
        shown, cuts = self.strings[code].tolist(), [0, *(past_a + past_b).tolist()]
        hashes = [hashlib.sha256(b"".join(shown[x:y])[:-1]).hexdigest() if y > x else "" for x, y in zip(cuts, cuts[1:], strict=False)]
        return n_a, n_b, per, hashes, a[a_last] << 32 | b[b_last]


_ALIGNER: list = []


def aligner_of(a, b) -> Aligner:
    """The worker's aligner for two broadcast vocabularies."""
    if not _ALIGNER or _ALIGNER[0] is not a or _ALIGNER[1] is not b:
        _ALIGNER[:] = [a, b, Aligner(a.value, b.value)]
    return _ALIGNER[2]


_FOUND = "block bigint, doc_id {}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary, a array<int>, b array<int>, n array<bigint>"


def packed_links(numbers: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """Each text's links, of the numbers between two cuts: its different numbers, ascending, as steps, and how often each is there; compressed."""
    own = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    wide = int(numbers.max(initial=0)) + 1
    keys, times = np.unique(own * wide + numbers, return_counts=True)
    text, number = keys // wide, keys % wide
    first = np.searchsorted(text, np.arange(len(cuts)))
    steps = np.diff(number, prepend=0)
    begins = first[:-1][np.diff(first) > 0]
    steps[begins] = number[begins]
    steps, times, press = steps.astype("<u4"), times.astype("<u4"), zstandard.ZstdCompressor(level=1).compress
    return [press(steps[x:y].tobytes() + times[x:y].tobytes()) for x, y in zip(first, first[1:], strict=False)]


def unpacked_links(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers and how often each is there."""
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype="<u4").astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def blocks(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row a document, with its groups and its links as numbers of its block's pairs, and one a block, with its different pairs (a, b, n). Write it before use: a block's number holds for one run."""
    a, b = shared(docs.sparkSession, ByteTokens, a_path), shared(docs.sparkSession, PieceTokens, b_path)
    schema = T.StructType.fromDDL(_FOUND.format("string"))
    schema["doc_id"].dataType = docs.schema[doc_id].dataType
    arrow = to_arrow_schema(schema)

    def run(batches):
        aligner, number = aligner_of(a, b), TaskContext.get().partitionId() << 32
        held, size = [], 0

        def made():
            nonlocal held, size, number
            keys, numbers, counts = np.unique(np.concatenate([x[-1] for x in held]), return_inverse=True, return_counts=True)
            n_groups = np.concatenate([x[3] for x in held])
            cuts = np.concatenate([[0], np.cumsum(n_groups)])
            n = len(n_groups)
            own = [pa.array(np.full(n, number)), pa.concat_arrays([x[0] for x in held]), *(pa.array(np.concatenate([x[k] for x in held]), pa.int64()) for k in (1, 2)), pa.array(n_groups, pa.int64()), pa.array([h for x in held for h in x[4]], pa.string()), pa.array(packed_links(numbers, cuts), pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(n, f.type) for f in list(arrow)[len(own) :])], schema=arrow)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            pairs = [one(pa.array((keys >> 32).astype(np.int32))), one(pa.array((keys & 0xFFFFFFFF).astype(np.int32))), one(pa.array(counts.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.nulls(1, f.type) for f in list(arrow)[1 : len(own)]), *pairs], schema=arrow)
            held, size, number = [], 0, number + 1

        for batch in chunks(batches, text, limit=min(block_bytes, CHUNK_BYTES)):
            data, offsets = texts_of(batch.column(text))
            blob, cuts = data.tobytes(), offsets.tolist()
            held.append((batch.column(doc_id), *aligner.aligned([blob[x:y] for x, y in zip(cuts, cuts[1:], strict=False)])))
            size += len(blob)
            if size >= block_bytes:
                yield from made()
        if held:
            yield from made()

    return docs.select(doc_id, text).mapInArrow(run, schema)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Of all blocks' pairs (a, b, n): a, b, count (links of the pair), is_best (no A id has more links with b). A B id has at most as many rows as A has ids."""
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("is_best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def judged(found: DataFrame) -> DataFrame:
    """One row a document of ``blocks`` (written before): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    pairs = found.where("a IS NOT NULL").select("block", F.posexplode(F.arrays_zip("a", "b", "n")).alias("at", "p")).select("block", "at", "p.a", "p.b", "p.n")
    back = pairs.join(pair_counts(pairs), ["a", "b"]).select(F.col("block").alias("home"), "at", "count", "is_best")
    schema = T.StructType([found.schema["doc_id"], *T.StructType.fromDDL("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string").fields])
    arrow = to_arrow_schema(schema)

    def run(t: pa.Table, counted: pa.Table) -> pa.Table:
        at = counted.column("at").to_numpy()
        count, best = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        count[at], best[at] = counted.column("count").to_numpy(), counted.column("is_best").to_numpy(zero_copy_only=False)
        n_best, count_sum = [], []
        for blob in t.column("links").to_pylist():
            numbers, times = unpacked_links(blob)
            n_best.append(int((best[numbers] * times).sum()))
            count_sum.append(int((count[numbers] * times).sum()))
        n = t.column("n_groups")  # in each group the last A and the last B token are linked
        return pa.table([t.column("doc_id"), t.column("n_a"), t.column("n_b"), n, n, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), t.column("groups_sha256")], schema=arrow)

    own = found.where("a IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    return own.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(run, schema)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Each document's groups and links, judged by all documents' counts."""
    return judged(stored(blocks(docs, a_path, b_path)))


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark, sf_dir) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), *default_paths())
