"""Alignment against both libraries and a count over all pairs of tokens; edge cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rangeloom.llm import alignment
from rangeloom.llm.tokens import parts

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def libraries():
    a_path, b_path = alignment.default_paths()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in printable]
    byte = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(others)}
    return a, byte, sentencepiece.SentencePieceProcessor(model_file=b_path)


def brute(texts, libraries):
    """Each text's row, by the definitions: every A token with every B token."""
    a, byte, b = libraries
    rows, links = [], []
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            rows.append(((0, 0, 0, 0), ""))
            links.append([])
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in own]).tolist() for own in (bytes_a, bytes_b))
        cuts = sorted(set(ends_a) & set(ends_b))
        shown, low = [], 0
        for cut in cuts:
            shown.append("|".join(",".join(str(i) for i, e in zip(ids, ends, strict=True) if low < e <= cut) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))))
            low = cut
        own = [(x, y) for x, e in zip(ids_a, ends_a, strict=True) for y, f in zip(ids_b, ends_b, strict=True) if e == f]
        rows.append(((len(ids_a), len(ids_b), len(cuts), len(own)), hashlib.sha256(";".join(shown).encode()).hexdigest()))
        links.append(own)
    count = Counter(p for own in links for p in own)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(*head, sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), h) for (head, h), own in zip(rows, links, strict=True)]


def rows(df):
    return [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()]


def ordered(x):
    return sorted(x, key=lambda r: tuple((v is None, v) for v in r))


@pytest.mark.parametrize("block", [alignment.BLOCK_BYTES, 2000])
def test_edges(spark, libraries, monkeypatch, block):
    rng = random.Random(2)
    alphabet = [" ", "  ", "   ", "\n", "\t", "'s", "a", "ing", "9", "½", "é", "中", "😀", " ", "!", "<|endoftext|>", "<s>", "</s>", "<0x41>", "<unk>", "\x00", "the", "ﬁ"]
    texts = [None, "", " ", "\n", "▁", "a▁b", "<s> and </s>", "same words here", "same words here", "x" * 3000, "word " * 2000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(150)]
    data = [(None if k in (7, 8) else k, t) for k, t in enumerate(texts)]
    want = [(d, *r) for (d, _), r in zip(data, brute(texts, libraries), strict=True)]
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS block", "2 AS at", "'x' AS docs", "'y' AS links", "3 AS n")
    found = alignment.judged(alignment.stored(alignment.blocks(df, *alignment.default_paths(), block_bytes=block)))
    assert ordered(rows(found)) == ordered(want)
    assert len(want) > 100 and any(w[5] < w[4] for w in want)


def test_table(spark, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    short = [(d, t) for d, t in docs if len(t or "") < 4000]
    want = [(d, *r) for (d, _), r in zip(short, brute([t for _, t in short], libraries), strict=True)]
    got = rows(alignment.align(spark.createDataFrame(short, SCHEMA), *alignment.default_paths()))
    assert ordered(got) == ordered(want)
    whole = alignment.op13_alignment(spark, SF).collect()
    assert sorted(r.doc_id for r in whole) == sorted(d for d, _ in docs)
    hashes = {r[0]: r[-1] for r in want}
    assert all(hashes.get(r.doc_id, r.groups_sha256) == r.groups_sha256 for r in whole)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), *alignment.default_paths()).count() == 0


def test_parts_change_nothing(libraries):
    """A long text in parts has the tokens it has whole, in both vocabularies."""
    from rangeloom.llm.tokens import ByteTokens, PieceTokens

    a_path, b_path = alignment.default_paths()
    aligner = alignment.Aligner(ByteTokens(open(a_path).read()), PieceTokens(open(b_path, "rb").read()))
    rng = random.Random(8)
    text = " ".join(rng.choice(["ab", "don't", "x1", "  y", "Q.", "z\n", "été", "中文", "the"]) for _ in range(60_000))
    assert len(parts(text)) > 2
    ids, pieces = aligner.encoded([text.encode()])
    assert ids[0].tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids
    assert pieces[0].tolist() == libraries[2].encode(text)


@pytest.mark.parametrize("seed", range(20))
def test_group_ends(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 40)
    a, b = (sorted({*rng.sample(range(1, n + 1), rng.randrange(n)), n}) for _ in range(2))
    at_a, at_b = alignment.group_ends(np.array(a), np.array(b))
    common = sorted(set(a) & set(b))
    assert [a[k] for k in at_a] == common == [b[k] for k in at_b]
