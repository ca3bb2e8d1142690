"""Edit-aware token counts.

A document's pre-tokens stand in leaves of about ``LEAF`` each, under a segment tree whose nodes sum
the characters and the tokens below them. An edit finds its leaves by descending the sums, encodes only
the pieces it touches with a few before and after, goes on to the right until a piece begins where one
began before, and puts the new pieces in; then the sums above those leaves change. Counting reads the
root. Where a piece begins depends on at most two characters to its right and on the piece to its left,
so two pieces before an edit nothing can change, and after it the old pieces hold again from the first
common beginning on.

Defined results: a null text counts as empty; an empty text has no tokens and can be edited; places
past the end mean the end; null inserted text is none; edits apply one after the other; rows that
repeat are counted alike; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, default_path, encoder_of, shared_vocabulary
from .common import chunks, table, texts_of

LEAF = 64
_BEFORE, _AFTER, _AHEAD = 2, 8, 2


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


class Leaf:
    __slots__ = ("text", "starts", "counts", "chars")

    def __init__(self, text: bytes, starts: np.ndarray, counts: np.ndarray):
        self.text, self.starts, self.counts = text, starts, counts
        self.chars = len(text) if text.isascii() else len(text.decode())


class TokenTree:
    """The pre-tokens of one text and the sums over them."""

    def __init__(self, text: bytes, starts: np.ndarray, counts: np.ndarray):
        self._build(text, starts, counts)

    def _build(self, text: bytes, starts: np.ndarray, counts: np.ndarray) -> None:
        cuts = list(range(0, len(starts), LEAF)) or [0]
        places = [int(starts[c]) if c < len(starts) else 0 for c in cuts] + [len(text)]
        self.leaves = [Leaf(text[a:b], starts[c : c + LEAF] - a, counts[c : c + LEAF]) for c, a, b in zip(cuts, places, places[1:], strict=False)]
        tokens = np.add.reduceat(counts, cuts) if len(counts) else [0]
        self.size = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.sums = np.zeros((2 * self.size, 2), dtype=np.int64)
        self.sums[self.size : self.size + len(self.leaves), 0] = [x.chars for x in self.leaves]
        self.sums[self.size : self.size + len(self.leaves), 1] = tokens
        k = self.size
        while k > 1:
            self.sums[k // 2 : k] = self.sums[k : 2 * k : 2] + self.sums[k + 1 : 2 * k : 2]
            k //= 2

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def text(self) -> bytes:
        return b"".join(x.text for x in self.leaves)

    def find(self, char: int) -> int:
        """The leaf that holds a character; of the text's end, the last."""
        k = 1
        while k < self.size:
            k *= 2
            if char >= self.sums[k, 0] and self.sums[k + 1, 0]:
                char -= int(self.sums[k, 0])
                k += 1
        return min(k - self.size, len(self.leaves) - 1)

    def before(self, leaf: int) -> int:
        """Characters before a leaf."""
        k, out = leaf + self.size, 0
        while k > 1:
            if k & 1:
                out += int(self.sums[k - 1, 0])
            k //= 2
        return out

    def put(self, first: int, leaves: list[Leaf]) -> None:
        """New leaves in the place of as many old ones, and the sums above them."""
        self.leaves[first : first + len(leaves)] = leaves
        a, b = first + self.size, first + self.size + len(leaves)
        self.sums[a:b] = [(x.chars, x.counts.sum()) for x in leaves]
        while a > 1:
            a, b = a // 2, (b + 1) // 2
            below = self.sums[2 * a : 2 * b]
            self.sums[a:b] = below[::2] + below[1::2]


class _Window:
    """The pieces around an edit, and the text to encode in their place."""

    def __init__(self, tree: TokenTree, place: int, removed: int, inserted: bytes, reach: int):
        place = min(max(place, 0), tree.chars)
        removed = min(max(removed, 0), tree.chars - place)
        self.tree = tree
        first, last = tree.find(place), tree.find(place + removed)
        last = min(last + reach, len(tree.leaves) - 1)
        while first and sum(len(x.starts) for x in tree.leaves[first : tree.find(place)]) < _BEFORE:
            first -= 1
        self.first, self.last = first, last
        own = tree.leaves[first : last + 1]
        base = np.cumsum([0, *(len(x.text) for x in own)])
        text = b"".join(x.text for x in own)
        self.starts = np.concatenate([x.starts + b for x, b in zip(own, base, strict=False)])
        self.counts = np.concatenate([x.counts for x in own])
        a, b = self._bytes(text, place - tree.before(first), removed)
        at = max(0, int(np.searchsorted(self.starts, a, side="right")) - 1 - _BEFORE)
        self.after = int(np.searchsorted(self.starts, b))  # the first old piece that begins in what follows the edit
        stop = min(len(self.starts), self.after + _AFTER * reach)
        self.at_end = last == len(tree.leaves) - 1 and stop == len(self.starts)
        begin = int(self.starts[at]) if len(self.starts) else 0
        end = int(self.starts[stop]) if stop < len(self.starts) else len(text)
        self.at, self.stop, self.begin = at, stop, begin
        self.shift = len(inserted) - (b - a)
        self.text = text[:a] + inserted + text[b:]
        self.new = self.text[begin : end + self.shift]

    @staticmethod
    def _bytes(text: bytes, place: int, removed: int) -> tuple[int, int]:
        if text.isascii():
            return place, place + removed
        begins = np.append(np.flatnonzero((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80), len(text))
        return int(begins[place]), int(begins[place + removed])

    def settle(self, starts: np.ndarray, counts: np.ndarray) -> bool:
        """Put the new pieces in; False if they do not meet the old ones within the window."""
        old = self.starts[self.after : self.stop if self.at_end else max(self.after, self.stop - _AHEAD)] + self.shift - self.begin
        met = np.searchsorted(starts, old)
        there = np.flatnonzero(np.append(starts, -1)[met] == old)
        if len(there):
            keep, many = self.after + int(there[0]), int(met[there[0]])
        elif self.at_end:
            keep, many = len(self.starts), len(starts)
        else:
            return False
        starts = np.concatenate([self.starts[: self.at], starts[:many] + self.begin, self.starts[keep:] + self.shift])
        counts = np.concatenate([self.counts[: self.at], counts[:many], self.counts[keep:]])
        n = self.last - self.first + 1
        if len(starts) > 4 * LEAF * n:
            self._again(starts, counts)
            return True
        cuts = [len(starts) * k // n for k in range(n + 1)]
        places = [0] + [int(starts[c]) if c < len(starts) else len(self.text) for c in cuts[1:-1]] + [len(self.text)]
        self.tree.put(self.first, [Leaf(self.text[a:b], starts[c:d] - a, counts[c:d]) for a, b, c, d in zip(places, places[1:], cuts, cuts[1:], strict=False)])
        return True

    def _again(self, starts: np.ndarray, counts: np.ndarray) -> None:
        """Too much in too few leaves: build the tree anew from its pieces, without encoding any."""
        leaves = self.tree.leaves[: self.first] + [Leaf(self.text, starts, counts)] + self.tree.leaves[self.last + 1 :]
        base = np.cumsum([0, *(len(x.text) for x in leaves)])
        self.tree._build(b"".join(x.text for x in leaves), np.concatenate([x.starts + b for x, b in zip(leaves, base, strict=False)]), np.concatenate([x.counts for x in leaves]))


def _encoded(encoder: Encoder, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Where the pieces of each text begin, and their token counts; all texts at once."""
    offsets = np.cumsum([0, *map(len, texts)])
    starts, ids = encoder.pieces(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    cuts = np.searchsorted(starts, offsets)
    return [(starts[a:b] - o, counts[a:b]) for a, b, o in zip(cuts, cuts[1:], offsets, strict=False)]


def trees(encoder: Encoder, texts: list[bytes]) -> list[TokenTree]:
    return [TokenTree(t, *x) for t, x in zip(texts, _encoded(encoder, texts), strict=True)]


def edit(encoder: Encoder, edits: list[tuple[TokenTree, int, int, bytes]]) -> list[int]:
    """Apply one edit (place, removed characters, inserted UTF-8) to each of some trees; returns how many bytes each took to encode anew."""
    out, reach = [0] * len(edits), 1
    todo = list(range(len(edits)))
    while todo:
        windows = [_Window(*edits[k], reach) for k in todo]
        rest = []
        for k, window, new in zip(todo, windows, _encoded(encoder, [w.new for w in windows]), strict=True):
            out[k] += len(window.new)
            if not window.settle(*new):
                rest.append(k)
        todo, reach = rest, reach * 4
    return out


def counted(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", edits: str = "edits") -> DataFrame:
    """The columns ``keep`` with n_tokens, edited_tokens, edited_chars, edited_sha256, encoded_bytes.

    ``edits`` is an array of structs (place, removed, inserted), in code points; encoded_bytes tells how
    much text the edits made the encoder read.
    """
    shared = shared_vocabulary(docs.sparkSession, path)
    docs = docs.select(*keep, text, edits)
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        encoder = encoder_of(shared)
        for batch in chunks(batches, text):
            data, offsets = texts_of(batch.column(text))
            own = trees(encoder, [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            before = [t.tokens for t in own]
            lists = [x or [] for x in batch.column(edits).to_pylist()]
            read = np.zeros(len(own), dtype=np.int64)
            for k in range(max(map(len, lists), default=0)):
                rows = [r for r, x in enumerate(lists) if len(x) > k and x[k] is not None]
                if rows:
                    read[rows] += edit(encoder, [(own[r], lists[r][k]["place"] or 0, lists[r][k]["removed"] or 0, (lists[r][k]["inserted"] or "").encode()) for r in rows])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(before, pa.int64()), pa.array([t.tokens for t in own], pa.int64()), pa.array([t.chars for t in own], pa.int64()), pa.array([hashlib.sha256(t.text()).hexdigest() for t in own], pa.string()), pa.array(read)],
                names=[*keep, "n_tokens", "edited_tokens", "edited_chars", "edited_sha256", "encoded_bytes"],
            )

    return docs.mapInArrow(run, f"{types}, n_tokens bigint, edited_tokens bigint, edited_chars bigint, edited_sha256 string, encoded_bytes bigint")


def op8_token_counts(spark, sf_dir) -> DataFrame:
    """Every document's tokens, before and after an insertion in its middle, a deletion and a replacement."""
    docs = table(spark, sf_dir, "documents")
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint")
    one = lambda place, removed, inserted: F.struct(place.cast("bigint").alias("place"), F.lit(removed).cast("bigint").alias("removed"), F.lit(inserted).alias("inserted"))
    edits = F.array(one(F.floor(n / 2), 0, " [edited] "), one(F.floor(n / 4), 7, ""), one(F.floor(n * 3 / 4), 5, "'re 2nd\n"))
    return counted(docs.select("doc_id", "text", edits.alias("edits")), default_path())
