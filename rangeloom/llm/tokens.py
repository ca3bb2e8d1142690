"""Token ids by vocabulary files of two libraries: byte-level BPE (a JSON file of the tokenizers library) and pieces (a model of sentencepiece).

The JSON file's merges are in the order of their ids, so its ids are those that tiktoken gives for the same
ranks, some four times as fast; the code points that count as letters, digits and spaces are the same in both
(the tests hold ids against the tokenizers library). ``parts`` cuts a long text before a blank between two
letters: no token of either kind goes on over such a place, so parts are encoded one by one and a long text
needs little more than its ids. A stretch without such a place is encoded whole.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Characters of a text that are encoded at a time, if there is a place to cut.
PART = 1 << 16
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def parts(text: str, limit: int = PART) -> list[str]:
    """The text in stretches of ``limit`` characters or somewhat more, cut at blanks between two ASCII letters; the blanks at the cuts are left out."""
    out, at = [], 0
    while len(text) - at > limit and (cut := _CUT.search(text, at + limit)):
        out.append(text[at : cut.start()])
        at = cut.end()
    out.append(text[at:])
    return out


def _bytes_of_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 ones for themselves, the others, in order, from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """Byte-level BPE by a JSON file; ValueError where the file's ids are not the order of its merges."""

    def __init__(self, blob: str):
        held = json.loads(blob)
        model, before = held["model"], held["pre_tokenizer"]
        plain = before["type"] == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and not held["normalizer"] and not held["post_processor"]
        if model["type"] != "BPE" or not plain or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE")
        special = {t["content"]: t["id"] for t in held["added_tokens"]}
        byte = _bytes_of_characters()
        self.ranks = {bytes(byte[c] for c in token): k for token, k in model["vocab"].items() if token not in special}
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        order = [model["vocab"][m] for m in merges]
        if order != sorted(order) or len(set(order)) != len(order) or len(self.ranks) != 256 + len(order) or min(order, default=256) < 256:
            raise ValueError("the ids are not in the order of the merges")
        self.special = special
        self.bytes = [b""] * (max([*self.ranks.values(), *special.values()]) + 1)
        for token, k in self.ranks.items():
            self.bytes[k] = token
        for token, k in special.items():
            self.bytes[k] = token.encode()
        self.lengths = np.array([len(x) for x in self.bytes], dtype=np.int64)
        self._library = None

    def __getstate__(self):
        return self.__dict__ | {"_library": None}

    @property
    def library(self):
        if self._library is None:
            import tiktoken

            # Fixed value: the pattern of byte-level pre-tokens.
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self._library = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens=self.special)
        return self._library

    def ids(self, text: str, special: bool = True) -> np.ndarray:
        """The ids of a text; the strings of special tokens in it are those tokens, or plain text."""
        own = self.library
        encode = (lambda x: own.encode(x, allowed_special="all")) if special and any(s in text for s in self.special) else own.encode_ordinary
        if len(text) <= PART:
            return np.array(encode(text), dtype=np.uint32)
        first, *others = parts(text)
        return np.concatenate([np.array(encode(x), dtype=np.uint32) for x in (first, *(" " + x for x in others))])


class PieceTokens:
    """Pieces of a sentencepiece model, given as its bytes."""

    def __init__(self, blob: bytes):
        self.blob = blob
        self._library = None
        own = self.library
        n = own.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if own.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, own.id_to_piece(k)) for k in range(n))]
        self.lengths = np.array([len(x) for x in self.bytes], dtype=np.int64)

    def __getstate__(self):
        return self.__dict__ | {"_library": None}

    @property
    def library(self):
        if self._library is None:
            import sentencepiece

            self._library = sentencepiece.SentencePieceProcessor(model_proto=self.blob)
        return self._library

    def many(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


_HELD: dict[tuple, object] = {}


def shared(spark, kind, path: str):
    """A vocabulary at ``path``, broadcast (a few MB, whatever the input)."""
    key = (spark.sparkContext.applicationId, kind.__name__, path)
    if key not in _HELD:
        with open(path, "rb") as f:
            blob = f.read()
        _HELD[key] = spark.sparkContext.broadcast(kind(blob.decode() if kind is ByteTokens else blob))
    return _HELD[key]
