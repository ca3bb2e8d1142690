"""Byte-level BPE without regular expressions.

Pre-tokenisation. Each code point has a class (letter, digit, space, ...). Reading a class is a
function on the twelve states of a small automaton, and the composition of functions is associative,
so the state after every character comes from a scan: functions are multiplied in doubling steps over
windows of 1, 2, 4, ... characters until each product is a constant. (The functions met are a finite
monoid, so a product is one look-up in its table.) The state before a character and its class tell
whether a piece begins there, or, for what only the next character decides, one before. Rows are kept
apart by a separator that leads to the first state.

Merging. A piece's ids come from a cache, or else all new pieces of a chunk merge together, arrays of
equal width, each its leftmost lowest-ranked pair a round. The slices' offsets stay known, so tokens
lead back to the bytes they stand for.

Defined results: a null text counts as empty; an empty text has no tokens; other columns pass through
``encode``, whose added columns get an underscore behind a name that is taken; rows that repeat repeat; an empty table stays empty.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import added, chunks, table, texts_of

#: Pieces that a worker remembers at most.
CACHE_PIECES = 300_000
_WIDEST = 48
_NONE = np.int32(2**31 - 1)

# Classes of code points.
LETTER, S_LIKE, R_LIKE, E_, L_, DIGIT, BLANK, SPACE, MARK, QUOTE, END = range(11)
# States: nothing yet; in letters, digits, marks; after the first blank or other space of a run, after a later one;
# after a quote that begins a piece; after such a quote and r or v; after such a quote and l; after a contraction.
_START, _LET, _DIG, _MRK, _B1, _W1, _B2, _W2, _QUO, _QRV, _QL, _CON = range(12)


def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next state, whether a piece begins at the character, whether one begins at the character before: by (state, class)."""
    letters = (LETTER, S_LIKE, R_LIKE, E_, L_)
    afresh = {c: _LET for c in letters} | {DIGIT: _DIG, BLANK: _B1, SPACE: _W1, MARK: _MRK, QUOTE: _QUO, END: _START}
    to, now, prev = (np.zeros((12, 11), dtype=np.uint8) for _ in range(3))
    for q in range(12):
        for c in range(11):
            to[q, c], now[q, c] = afresh[c], c != END

    def put(states, classes, target, begins=0, before=0):
        for q in states:
            for c in classes:
                to[q, c], now[q, c], prev[q, c] = target if target is not None else to[q, c], begins, before

    put([_LET], letters, _LET)
    put([_DIG], [DIGIT], _DIG)
    put([_MRK, _QUO], [MARK, QUOTE], _MRK)
    for state, before in ((_B1, 0), (_B2, 1)):
        put([state], letters, _LET, 0, before)
        put([state], [DIGIT], _DIG, 0, before)
        put([state], [MARK, QUOTE], _MRK, 0, before)
    put([_W2], [*letters, DIGIT, MARK, QUOTE], None, 1, 1)
    put([_B1, _W1, _B2, _W2], [BLANK], _B2)
    put([_B1, _W1, _B2, _W2], [SPACE], _W2)
    put([_QUO], [S_LIKE], _CON)
    put([_QUO], [R_LIKE], _QRV)
    put([_QUO], [L_], _QL)
    put([_QRV, _QL], letters, _LET, 0, 1)
    put([_QRV, _QL], [DIGIT, BLANK, SPACE, MARK, QUOTE], None, 1, 1)
    put([_QRV, _QL], [END], _START, 0, 1)
    put([_QRV], [E_], _CON)
    put([_QL], [L_], _CON)
    return to, now, prev


def _monoid(to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Products of the classes' functions: the number of each class, the table of products, and the value of each constant (or 255)."""
    known = {tuple(to[:, c]): c for c in range(to.shape[1])}
    found = list(known)
    classes = np.array([known[tuple(to[:, c])] for c in range(to.shape[1])])
    found, known = [], {}
    for c in range(to.shape[1]):
        f = tuple(int(x) for x in to[:, c])
        if f not in known:
            known[f] = len(found)
            found.append(f)
        classes[c] = known[f]
    generators, k = list(found), 0
    while k < len(found):
        for g in generators:
            f = tuple(g[x] for x in found[k])
            if f not in known:
                known[f] = len(found)
                found.append(f)
        k += 1
    n = len(found)
    product = np.zeros((n, n), dtype=np.uint16)
    for a in range(n):
        for b in range(n):
            product[a, b] = known[tuple(found[b][x] for x in found[a])]
    constant = np.array([f[0] if len(set(f)) == 1 else 255 for f in found], dtype=np.uint8)
    return classes.astype(np.uint16), product, constant


_TO, _NOW, _PREV = _automaton()
_CLASS_ELEMENT, _PRODUCT, _CONSTANT = _monoid(_TO)


def code_point_classes() -> np.ndarray:
    """The class of each code point, as the tiktoken library knows letters, digits and white space."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = np.full(0x110000, MARK, dtype=np.uint8)
    single = {bytes([b]): b for b in range(256)}
    for pattern, c in ((r"\p{L}", LETTER), (r"\p{N}", DIGIT), (r"\s", SPACE)):
        library = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        classes[[ord(x) for x in library.decode(library.encode_ordinary(every))]] = c
    for letters, c in (("stmd", S_LIKE), ("rv", R_LIKE), ("e", E_), ("l", L_), (" ", BLANK), ("'", QUOTE)):
        classes[[ord(x) for x in letters]] = c
    return classes


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of base64 tokens and their ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes and where each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        b = np.concatenate([data, np.zeros(3, dtype=np.uint8)])
        p, x = at[wide], lead[wide]
        tail = [(b[p + k] & 0x3F).astype(np.uint32) for k in (1, 2, 3)]
        two, three = (x & 0x1F) << 6 | tail[0], (x & 0x0F) << 12 | tail[0] << 6 | tail[1]
        four = (x & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
        lead[wide] = np.where(x < 0xE0, two, np.where(x < 0xF0, three, np.minimum(four, 0x10FFFF)))
    return lead, at


def piece_starts(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pieces of all rows begin, as byte positions in ``data``."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    points, at = code_points(data)
    firsts = np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])
    n = len(points)
    # A separator before each row that has text, and one after all.
    place = np.arange(n) + np.searchsorted(firsts, np.arange(n), side="right") if len(firsts) > 1 else np.arange(n) + 1
    kinds = np.full(n + len(firsts) + 1, END, dtype=np.uint8)
    kinds[place] = classes[points]
    element = _CLASS_ELEMENT[kinds]
    width, size = 1, len(_PRODUCT)
    flat = _PRODUCT.ravel()
    open_ = np.flatnonzero(_CONSTANT[element] == 255)
    while len(open_):
        # Products of windows: only those that are not yet constant need the window before them.
        open_ = open_[open_ >= width]
        if not len(open_):
            break
        was = element[open_ - width].astype(np.uint32)
        element[open_] = flat[was * size + element[open_]]
        open_ = open_[_CONSTANT[element[open_]] == 255]
        width *= 2
    state = _CONSTANT[element]
    before = np.empty_like(state)
    before[0] = _START
    before[1:] = state[:-1]
    key = before.astype(np.uint16) * 11 + kinds
    begins = _NOW.ravel()[key]
    begins[:-1] |= _PREV.ravel()[key[1:]]
    return at[begins[place].astype(bool)]


class Vocabulary:
    """Ranks, pair look-ups and code-point classes; small and of fixed size, so it goes to the workers whole."""

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray):
        self.classes = classes
        self.ranks = ranks
        top = max(ranks.values()) + 1
        self.tokens = [b""] * top
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(x) for x in self.tokens], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self._hashed(np.array(keys, dtype=np.uint64), np.array(values, dtype=np.int32))

    def _hashed(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.slot_key = np.full((1 << self.bits) + 64, 2**64 - 1, dtype=np.uint64)
        self.slot_value = np.full((1 << self.bits) + 64, _NONE, dtype=np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.slot_key[slot] == 2**64 - 1
            _, one = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.slot_key[slot[put]], self.slot_value[slot[put]] = keys[todo[put]], values[todo[put]]
            rest = np.ones(len(todo), dtype=bool)
            rest[put] = False
            todo, slot = todo[rest], slot[rest] + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's union, or a number above all ranks."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        out = self.slot_value[slot]
        open_ = np.flatnonzero(self.slot_key[slot] != keys)
        while len(open_):
            there = slot[open_]
            empty = self.slot_key[there] == 2**64 - 1
            out[open_[empty]] = _NONE
            open_ = open_[~empty]
            slot[open_] += 1
            out[open_] = self.slot_value[slot[open_]]
            open_ = open_[self.slot_key[slot[open_]] != keys[open_]]
        return out

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        return cls(read_ranks(path), code_point_classes())


def _merge_long(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """Merges of one long piece, by a heap of its pairs."""
    ids = [int(vocabulary.of_byte[b]) for b in piece]
    n, tokens, ranks = len(ids), vocabulary.tokens, vocabulary.ranks
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    rank_of = lambda a, b: ranks.get(tokens[a] + tokens[b])
    heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := rank_of(ids[k], ids[k + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, k, a, b = heapq.heappop(heap)
        j = after[k] if alive[k] else n
        if j >= n or ids[k] != a or ids[j] != b:
            continue
        ids[k], alive[j], after[k] = r, False, after[j]
        if after[k] < n:
            before[after[k]] = k
            if (x := rank_of(r, ids[after[k]])) is not None:
                heapq.heappush(heap, (x, k, r, ids[after[k]]))
        if before[k] >= 0 and (x := rank_of(ids[before[k]], r)) is not None:
            heapq.heappush(heap, (x, before[k], ids[before[k]], r))
    return [x for x, there in zip(ids, alive, strict=True) if there]


def _merge_matrix(vocabulary: Vocabulary, pieces: list[bytes], width: int) -> list[bytes]:
    """Merges of many pieces of at most ``width`` bytes at once; each result's ids as little-endian 32-bit numbers."""
    n = len(pieces)
    raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), dtype=np.uint8).reshape(n, width)
    sizes = np.array([len(x) for x in pieces])
    ids = vocabulary.of_byte[raw]
    ranks = vocabulary.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
    columns = np.arange(width)
    ranks[columns[1:] >= sizes[:, None]] = _NONE
    out_ids, out_sizes = ids.copy(), sizes.copy()
    rows = np.arange(n)
    while len(rows):
        at = ranks.argmin(axis=1)
        best = ranks[np.arange(len(rows)), at]
        on = best < _NONE
        if not on.all():
            done = ~on
            out_ids[rows[done]], out_sizes[rows[done]] = ids[done], sizes[done]
            rows, ids, ranks, sizes, at, best = rows[on], ids[on], ranks[on], sizes[on], at[on], best[on]
            if not len(rows):
                break
        k = np.arange(len(rows))
        shift = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), width - 1)
        ids = np.take_along_axis(ids, shift, axis=1)
        ids[k, at] = best
        ranks = np.take_along_axis(ranks, shift[:, : width - 1].clip(max=width - 2), axis=1)
        sizes = sizes - 1
        ranks[columns[None, 1:] >= sizes[:, None]] = _NONE
        here = np.flatnonzero(at + 1 < sizes)
        if len(here):
            ranks[here, at[here]] = vocabulary.pair_ranks(best[here], ids[here, at[here] + 1])
        here = np.flatnonzero(at > 0)
        if len(here):
            ranks[here, at[here] - 1] = vocabulary.pair_ranks(ids[here, at[here] - 1], best[here])
    flat, ends = out_ids.astype("<u4").tobytes(), out_sizes * 4
    return [flat[k * width * 4 : k * width * 4 + int(e)] for k, e in enumerate(ends)]


class Encoder:
    """A vocabulary with a cache of pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.cache: dict[bytes, bytes] = {}

    def _learn(self, pieces: set[bytes]) -> None:
        if len(self.cache) + len(pieces) > CACHE_PIECES:
            self.cache.clear()
        by_width: dict[int, list[bytes]] = {}
        for x in pieces:
            rank = self.vocabulary.ranks.get(x)
            if rank is not None:
                self.cache[x] = rank.to_bytes(4, "little")
            elif len(x) > _WIDEST:
                self.cache[x] = np.array(_merge_long(self.vocabulary, x), dtype="<u4").tobytes()
            else:
                by_width.setdefault(len(x) if len(x) <= 16 else -(-len(x) // 8) * 8, []).append(x)
        for width, own in by_width.items():
            self.cache.update(zip(own, _merge_matrix(self.vocabulary, own, width), strict=True))

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Where each piece begins, and its ids as little-endian 32-bit numbers."""
        starts = piece_starts(data, offsets, self.vocabulary.classes)
        blob, cuts = data.tobytes(), [*starts.tolist(), len(data)]
        pieces = [blob[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        ids = list(map(self.cache.get, pieces))
        if None in ids:
            new = {p for p, x in zip(pieces, ids, strict=True) if x is None}
            self._learn(new)
            ids = [self.cache[p] if x is None else x for p, x in zip(pieces, ids, strict=True)]
        return starts, ids

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each row, as little-endian 32-bit numbers."""
        starts, ids = self.pieces(data, offsets)
        cuts = np.searchsorted(starts, offsets).tolist()
        return [b"".join(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes that ids stand for, and where each id's begin."""
        v = self.vocabulary
        sizes = v.lengths[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(v.begin[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return v.flat[at].tobytes(), ends - sizes


_ENCODER: list = []


def encoder_of(shared) -> Encoder:
    """The worker's encoder for a broadcast vocabulary; its cache lives as long as the worker uses no other."""
    if not _ENCODER or _ENCODER[0] is not shared:
        _ENCODER[:] = [shared, Encoder(shared.value)]
    return _ENCODER[1]


_SHARED: dict[tuple, object] = {}


def shared_vocabulary(spark, path: str):
    """The vocabulary at ``path``, broadcast (a few MB, whatever the input)."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SHARED:
        _SHARED[key] = spark.sparkContext.broadcast(Vocabulary.load(path))
    return _SHARED[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with the columns ids (array<int>) and id_offsets (array<int>: where each id's bytes begin in the text's UTF-8)."""
    shared = shared_vocabulary(docs.sparkSession, path)
    names = [added(docs, "ids"), added(docs, "id_offsets")]
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1], T.ArrayType(T.IntegerType()))])

    def run(batches):
        encoder = encoder_of(shared)
        for batch in chunks(batches, text):
            rows = encoder.rows(*texts_of(batch.column(text)))
            flat = np.frombuffer(b"".join(rows), dtype="<i4")
            cuts = np.cumsum([0, *(len(x) // 4 for x in rows)])
            sizes = encoder.vocabulary.lengths[flat]
            ends = np.cumsum(sizes) - sizes
            starts = ends - np.repeat(ends[cuts[:-1].clip(max=max(len(ends) - 1, 0))] if len(ends) else np.zeros(len(rows), dtype=np.int64), np.diff(cuts))
            offsets = pa.array(cuts, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.ListArray.from_arrays(offsets, pa.array(starts, pa.int32()))], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` with n_tokens, ids_sha256, decoded_sha256: ids as little-endian unsigned 32-bit numbers, and the bytes they decode to."""
    shared = shared_vocabulary(docs.sparkSession, path)
    docs = docs.select(*dict.fromkeys((*keep, text)))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        encoder = encoder_of(shared)
        for batch in chunks(batches, text):
            rows = encoder.rows(*texts_of(batch.column(text)))
            flat = np.frombuffer(b"".join(rows), dtype="<u4").astype(np.int64)
            back, starts = encoder.decode(flat)
            cuts = np.cumsum([0, *(len(x) // 4 for x in rows)])
            edges = np.append(starts, len(back))[cuts].tolist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(np.diff(cuts), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string()), pa.array([hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(edges, edges[1:], strict=False)], pa.string())],
                names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.mapInArrow(run, schema)


def op5_bpe(spark, sf_dir) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_path())
