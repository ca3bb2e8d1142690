"""The operators against brute force, exact round trips, SQL and held-out accuracy."""

import hashlib
import math
import random
import re
import textwrap
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from rangeloom.llm import bpe, catalog, chat, embeddings, fingerprints, language, licenses, mixing, quality, simhash, token_counts
from rangeloom.llm.common import texts_of

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "embeddings", "conversations")


@pytest.fixture(scope="module")
def docs():
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' ORDER BY doc_id DESC").fetchall()
    return [(d, t or "", lang) for d, t, lang in rows]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(bpe.default_path())


@pytest.fixture(scope="module")
def reference(vocabulary):
    import public_tokenizers

    return tiktoken.Encoding("reference", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


ALPHABET = ["'", "'s", "'re", "'ll", "r", "v", "l", "e", "s", "t", "x", "é", "ß", "1", "٣", "½", " ", " ", "  ", "\n", "\t", "!", "?", "''", "中", "😀", "The", " the", "\x1c", "ª", "　", " " * 5]


def random_text(rng, size):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, size)))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    show = lambda df: sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df[columns].itertuples(index=False, name=None))
    assert sorted(got.columns) == columns and show(got) == show(want)


def test_encoding_is_the_library_s(vocabulary, reference):
    rng = random.Random(1)
    texts = [random_text(rng, 40) for _ in range(3000)] + ["a" * 500, "=" * 3000, " " * 700 + "x", "ab" * 60, "'" * 99, ""]
    encoder = bpe.Encoder(vocabulary)
    for text, ids in zip(texts, encoder.rows(*texts_of(pa.array(texts))), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == reference.encode_ordinary(text)
        assert encoder.decode(np.frombuffer(ids, dtype="<u4").astype(int))[0] == text.encode()


def test_every_code_point(vocabulary, reference):
    text = "".join(f"{c} {c}1{c}a{c}." for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x30000)]))
    texts = [text[k : k + 20000] for k in range(0, len(text), 20000)]
    encoder = bpe.Encoder(vocabulary)
    for k in range(0, len(texts), 40):
        for t, ids in zip(texts[k : k + 40], encoder.rows(*texts_of(pa.array(texts[k : k + 40]))), strict=True):
            assert np.array(reference.encode_ordinary(t), dtype="<u4").tobytes() == ids


def test_op5(spark, docs, reference):
    got = {r.doc_id: r for r in catalog.queries()["op5_bpe"](spark, SF).collect()}
    for d, text, _ in docs:
        ids = np.array(reference.encode_ordinary(text), dtype="<u4")
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_offsets(spark, vocabulary):
    df = spark.createDataFrame([(1, "The café, the ñandú."), (2, "")], "doc_id bigint, text string")
    for r in bpe.encode(df, bpe.default_path()).collect():
        raw = r.text.encode()
        ends = [*r.id_offsets[1:], len(raw)] if r.ids else []
        assert [vocabulary.tokens[i] for i in r.ids] == [raw[a:b] for a, b in zip(r.id_offsets, ends, strict=True)]


def test_edited_counts(vocabulary, reference):
    rng = random.Random(2)
    encoder = bpe.Encoder(vocabulary)
    for size in (0, 3, 30, 400, 2000):
        texts = [random_text(rng, size) for _ in range(40)]
        trees = token_counts.trees(encoder, [t.encode() for t in texts])
        for _ in range(8):
            edits = []
            for k, text in enumerate(texts):
                place, removed = rng.randint(0, len(text) + 1), rng.choice([0, 0, 1, 2, 5, 50])
                put = random_text(rng, rng.choice([0, 1, 3, 300]))
                edits.append((trees[k], place, removed, put.encode()))
                texts[k] = text[:place] + put + text[place + removed :]
            token_counts.edit(encoder, edits)
            for text, tree in zip(texts, trees, strict=True):
                assert tree.text() == text.encode() and tree.chars == len(text)
                assert tree.tokens == len(reference.encode_ordinary(text))


def test_op8(spark, docs, reference):
    got = {r.doc_id: r for r in catalog.queries()["op8_token_counts"](spark, SF).collect()}
    for d, text, _ in docs:
        n, edited = len(text), text
        for place, removed, put in ((n // 2, 0, " [edited] "), (n // 4, 7, ""), (n * 3 // 4, 5, "'re 2nd\n")):
            edited = edited[:place] + put + edited[place + removed :]
        r = got[d]
        assert (r.n_tokens, r.edited_tokens, r.edited_chars) == (len(reference.encode_ordinary(text)), len(reference.encode_ordinary(edited)), len(edited))
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert n < 5000 or r.encoded_bytes < n / 4


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))


def shingles(text, n):
    w = words(text)
    return [tuple(w[k : k + n]) for k in range(len(w) - n + 1)] or ([tuple(w)] if w else [])


def test_op1(spark, docs):
    got = {r.doc_id: r for r in catalog.queries()["op1_fingerprints"](spark, SF).collect()}
    assert len(got) == len(docs)
    error, by_text = [], {}
    for k, (d, text, _) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        r = got[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (set(shingles(t, 5)) for t in (text, edited, after))
        error.append(r.near_edited - (len(a & b) / len(a | b) if a | b else 1))
        assert abs(r.near_next - (len(a & c) / len(a | c) if a | c else 1)) < 0.2
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
    assert np.sqrt(np.mean(np.square(error))) < 0.08


def test_sketches_merge_and_contain():
    rng = np.random.default_rng(0)
    w = [f"w{k}" for k in rng.integers(0, 5000, 6000)]
    small, large = " ".join(w[:400]), " ".join(w)
    a, b, both = fingerprints.sketches(*texts_of(pa.array([small, large, small + " " + large])))
    assert a.containment(b) > 0.9 and b.containment(a) < 0.2
    merged = a.merge(b)
    assert merged.bound == min(a.bound, b.bound) and merged.likeness(both) > 0.9
    back = fingerprints.Sketch.loads(b.dumps())
    assert back.bound == b.bound and np.array_equal(back.hashes, b.hashes)


def simhash_of(text):
    own = shingles(text, 3)
    counts = np.zeros(64, dtype=int)
    for s in own:
        h = xxhash.xxh64_intdigest(" ".join(s).encode(), seed=42)
        counts += [(h >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(own))


def test_xxh64_is_the_library_s():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 40_000, dtype=np.uint8)
    starts = rng.integers(0, len(data) - 300, 3000)
    ends = starts + np.concatenate([np.arange(300), rng.integers(0, 300, 2700)])
    got = simhash.xxh64(data, starts, ends)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), seed=42) for a, b in zip(starts, ends, strict=True)]
    assert simhash.xxh64(data, np.array([len(data) - 5]), np.array([len(data)])).tolist() == [xxhash.xxh64_intdigest(data[-5:].tobytes(), seed=42)]


def test_op7(spark, docs):
    got = {r.doc_id: r for r in catalog.queries()["op7_simhash"](spark, SF).collect()}
    fps = {d: simhash_of(t) for d, t, _ in docs}
    assert all(got[d].fingerprint == f"{f:016x}" for d, f in fps.items())
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = sorted(fps)
    for k, a in enumerate(every):
        for b in every[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert all(got[d].component_id == find(d) for d in every)


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 20, (1500, 2), dtype=np.uint64), axis=1) for c in centres]))
    group = np.sort(rng.integers(0, 4, len(fps)))
    a, b = simhash.index_links(fps, group)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= 2}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want)


def test_large_groups_are_dealt_again(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**62, 40)
    fps = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base[:2] for i in range(0, 60, 3) for j in range(0, 60, 7)} | {int(b) for b in base})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")

    def components(large):
        monkeypatch.setattr(simhash, "LARGE", large)
        return {(r.u, r.v) for r in simhash.components(simhash.links(df)).collect()}

    assert components(5) == components(10**6)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.u: r.v for r in simhash.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_mixing_tree_and_permutation(monkeypatch):
    quotas = np.array([1000, 0, 37, 5])
    out = mixing.split_tree(quotas, 6, 1)
    assert (out.sum(axis=1) == quotas).all() and np.ptp(out.sum(axis=0)) <= 1
    assert (out == mixing.split_tree(quotas, 6, 1)).all()
    monkeypatch.setattr(mixing, "TREE_BLOCKS", 100)  # several trees
    out = mixing.split_tree(quotas, 6, 1)
    assert (out.sum(axis=1) == quotas).all() and np.ptp(out.sum(axis=0)) <= 11
    for n in (1, 2, 7, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, mixing.pass_keys(7, 1, 0)).tolist()) == list(range(n))


def test_mixing_draws_whole_words():
    rng = np.random.default_rng(0)
    for _ in range(300):
        size, width = int(rng.integers(1, 400)), int(rng.integers(1, 40))
        blocks, words = -(-size // width), int(rng.integers(0, 2 * size + 1))
        keys = [mixing.pass_keys(1, 2, e) for e in range(2)]
        held = sorted((e * blocks + int(mixing.permuted(np.array([b]), blocks, keys[e])[0]), min(width, size - b * width)) for e in range(2) for b in range(blocks))
        total, n, last = 0, 0, 0
        for place, h in held:
            if total < words:
                n, last = place + 1, min(h, words - total)
                total += last
        assert mixing.draw(words, size, blocks, width, keys) == (n, last)


def test_targets():
    t = mixing.targets_of(np.array([100, 1000, 1000, 10]))
    assert t.sum() == pytest.approx(1.5 * 2110) and t[0] == 200 and (t <= 2 * np.array([100, 1000, 1000, 10])).all()


def taken_of(rows):
    return {r.doc_id: sum(p["past"] - p["first"] for p in r.pieces) for r in rows}


def test_mix_is_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mix = mixing.mix(docs, shards=5, block_words=100)
    rows = mix.collect()
    seen = set()
    for r in rows:
        for p in r.pieces:
            own = {(r.doc_id, p.epoch, k) for k in range(p.first, p.past)}
            assert not own & seen
            seen |= own
    by_shard = mixing.shard_rows(mix).groupBy("shard").count().collect()
    assert {x["shard"] for x in by_shard} == set(range(5))


def test_mix_comes_from_the_drawn_blocks(spark):
    """Another seed draws other blocks and takes other words, the targets hold, and each shard has the tree's quota of each source's blocks."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _, plan = mixing.placed(docs, 5, 100, 7)
    assert (np.diff(plan.ends, axis=1, prepend=0) == mixing.split_tree(plan.drawn, 5, 7)).all()
    rows = mixing.mix(docs, 5, 100, 7).collect()
    slots = {}
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        for p in r.pieces:
            slots.setdefault((source[r.doc_id], p.shard), set()).add(p.slot)
    for s, name in enumerate(plan.names):
        own = None if name == "n" else name[1:]
        assert [len(slots.get((own, j), ())) for j in range(5)] == np.diff(plan.ends[s], prepend=0).tolist()
    other = mixing.mix(docs, 5, 100, 8).collect()
    assert taken_of(rows) != taken_of(other) and sum(taken_of(rows).values()) == sum(taken_of(other).values())
    by_source = {}
    for r in rows:
        by_source.setdefault(source[r.doc_id], [r.target, 0])[1] += taken_of([r])[r.doc_id]
    assert all(abs(t - got) <= 0.5 + 1e-9 for t, got in by_source.values())


def test_mixed_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mixed_documents(docs).collect()
    dealt = docs.repartition(3)
    assert rows == mixing.mixed_documents(dealt.checkpoint()).collect()
    assert sorted(map(str, mixing.mixed_documents(dealt).collect())) == sorted(map(str, rows))
    again = {}
    whole = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        again[r.doc_id] = again.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.text in whole[r.doc_id] and r.n_chars == len(r.text)
    pieces = mixing.mix(docs).collect()
    assert again == {d: n for d, n in taken_of(pieces).items() if n}
    # Runs come by shard and by rank, in the place of their first piece.
    want = []
    for r in pieces:
        before = None
        for p in r.pieces:
            if before != (p.epoch, p.first):
                want.append((p.shard, p["rank"], p.slot, r.doc_id, p["first"]))
            before = (p.epoch, p.past)
    assert [r.doc_id for r in rows] == [w[3] for w in sorted(want)]


def test_mixed_documents_on_a_changing_cluster(spark, tmp_path):
    """Files are read in other splits after the plan was made: the same rows, in the same order."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(4)
    docs.write.parquet(f"{tmp_path}/docs")
    keys = ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes")
    before = [spark.conf.get(k, None) for k in keys]
    try:
        got = []
        for first, later in (("1", "1"), ("1", "16")):
            spark.conf.set(keys[0], first)
            spark.conf.set(keys[1], "128m")
            mixed = mixing.mixed_documents(spark.read.parquet(f"{tmp_path}/docs"))
            spark.conf.set(keys[0], later)
            spark.conf.set(keys[1], "128m" if later == "1" else "20k")
            got.append(mixed.collect())
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got[0] == got[1] and got[0]


def test_shards_hold_the_trees_quotas(spark):
    """The drawn blocks that the documents' pieces name are, in every shard and source, as many as the tree's leaf says."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for shards in (3, 16):
        rows, plan = mixing.placed(docs, shards, block_words=512)
        source = {r.rid: r.source for r in rows.collect()}
        by_doc = {r.doc_id: plan.names.index(source[r.rid]) for r in rows.collect()}
        slots = {}
        for r in mixing.mix(docs, shards, block_words=512).collect():
            for p in r.pieces:
                slots.setdefault((by_doc[r.doc_id], p.shard), set()).add(p.slot)
        quotas = np.diff(plan.ends, axis=1, prepend=0)
        assert quotas.sum() == plan.drawn.sum()
        assert {k: len(v) for k, v in slots.items()} == {(s, h): int(n) for s, row in enumerate(quotas) for h, n in enumerate(row) if n}


def test_licences_of_repeated_words(spark):
    """A megabyte of one word in a line, and of blanks, takes seconds; a notice behind it is found."""
    import time

    texts = ["license " * 125_000, "licensed under" + " " * 1_000_000 + "and", "released and " * 80_000, "available\n" * 100_000, "license " * 60_000 + "\n\nThis project is licensed under the MIT License."]
    began = time.time()
    rows = {r.doc_id: r.family for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert time.time() - began < 120 and rows[4] == "mit" and len(rows) == 5


def test_op9_extreme_lengths(spark):
    """Vectors whose squares vanish or overflow, on both sides of the bound."""
    c = 0.9301
    for size in (1e-200, 1e200, 1e-310, 1.0):
        rows = [(0, [size, 0.0], 1), (1, [size * c, size * math.sqrt(1 - c * c)], 1), (2, [2 * size, size / 10], 1), (3, [0.0, size], 1)]
        got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label bigint")).collect()}
        assert (got[0].n_links, got[2].n_links, got[3].n_links) == (2, 2, 0), size
        assert got[1].component_id == 0 and got[3].kept


def test_cut_words():
    text = " a bb  ccc d "
    assert [mixing.cut_words(text, a, b, 4) for a, b in ((0, 4), (0, 1), (1, 3), (3, 4), (0, 3))] == [text, " a", "bb  ccc", "d ", " a bb  ccc"]


def test_chat_round_trip():
    rng = random.Random(4)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "[\\INST]", "[\\\\/INST]", "[ROLE=x]", "[/ROLE]", " ", "a", "[", "<", "\\", "é", "\n", "[SYS] ", "ROLE=y]"]
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "a]b", ""]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for _ in range(rng.randint(0, 6))]
        assert [x[:2] for x in chat.parse(chat.render_conversation(turns))] == turns
    assert chat.render("user", "plain [text]") == "[INST] plain [text] [/INST]"
    for bad in ("<s>oops", "[INST] no end", "[INST] x</s>", "[/INST] x [/INST]"):
        with pytest.raises(ValueError):
            list(chat.parse(bad))


def test_license_model():
    model = licenses.train()
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            assert model.judge(text)[0] == family and model.judge(text)[2]
    for text in licenses._OTHERS:
        assert model.judge(text)[0] == licenses.UNKNOWN


def test_op4(spark, docs):
    model = licenses.train()
    got = {r.doc_id: r for r in catalog.queries()["op4_licenses"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d, text, _ in docs:
        lines = [x for x in text.split("\n") if re.search(licenses.ANCHORS, x)]
        judged = [model.judge(x) for x in lines]
        assert list(got[d].families) == [j[0] for j in judged]
        if judged:
            best = max((j[2], j[0] != licenses.UNKNOWN, j[1], j[0]) for j in judged)
            assert (got[d].family, bool(got[d].confirmed)) == (best[3], bool(best[0])) and abs(got[d].probability - best[2]) < 1e-9
        else:
            assert got[d].family == "none"


NOTICES = {
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}


def test_op4_wrapped_notices(spark):
    wraps = [(family, head + "\n".join(mark + x for x in textwrap.wrap(text, width)) + tail) for family, text in NOTICES.items() for width in range(50, 81, 6) for mark in ("", "# ") for head, tail in (("", ""), ("Some prose stands here.\n", "\n\nThe prose goes on.\nAnd on."))]
    assert all("\n" in x[1] for x in wraps)
    rows = spark.createDataFrame([(k, x[1]) for k, x in enumerate(wraps)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.scan(rows).collect()}
    for k, (family, text) in enumerate(wraps):
        assert (got[k].family, got[k].confirmed, list(got[k].families)) == (family, True, [family]), text


def test_op4_lines_of_a_paragraph(spark):
    rows = [
        "#include <stdio.h>\n// SPDX-License-Identifier: MIT\nint main() { return public_house(); }",
        "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0",
        "This program is licensed under the terms of the GNU Affero\nGeneral Public License, version 3.",
        "Plain prose of the house,\nand of the park in the year.",
    ]
    got = {r.doc_id: list(r.families) for r in licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()}
    assert got == {0: ["mit"], 1: ["mit", "apache-2.0"], 2: ["agpl-3.0"], 3: []}


#: Whole licence texts and headers as files hold them. The templates were adjusted until these were found, so they are no held-out measure.
WHOLE = {
    "mit": """MIT License

Copyright (c) 2021 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "bsd": """Copyright 2020 Jane Doe

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without
specific prior written permission.""",
    "apache-2.0": """// Copyright 2019 The Authors
//
// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
// See the License for the specific language governing permissions and
// limitations under the License.""",
    "gpl-2.0": """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "gpl-3.0": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.""",
    "lgpl": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "mpl-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
}
#: Phrases of each family, and what grants nothing. They are no templates, but some templates were written because one of these failed.
PHRASES = {
    "agpl-3.0": ["You may use it under the GNU AGPL version 3.", "Published under the Affero GPL"],
    "apache-2.0": ["Code released under the Apache License 2.0", "It comes under the Apache License, version 2.0."],
    "bsd": ["Offered under the 3-clause BSD licence."],
    "cc-by-sa-4.0": ["Content is available under CC BY-SA 4.0"],
    "gpl-2.0": ["You may copy it under the GNU General Public License, version 2."],
    "gpl-3.0": ["Licence : GPLv3", "GPL-3.0-or-later", "Our code is released under the GNU GPL version 3."],
    "isc": ["Distributed under the ISC licence."],
    "lgpl": ["The library is distributed under the LGPL."],
    "mit": ["MIT License", "This code is licensed to you under the MIT licence", "Distributed under the terms of the MIT license.", "Everything here is under the MIT license."],
    "mpl-2.0": ["Distributed under the Mozilla Public License 2.0."],
    "public-domain": ["The photographs are in the public domain."],
    "unknown": ["Not licensed under the MIT License.", "This project is not licensed under the Apache License 2.0.", "It is no longer released under the BSD License.", "The MIT campus is large.", "Copyright (c) 2021 Jane Doe", "See the LICENSE file for details.", "The hunting licence of the general was public.", "This text is not in the public domain."],
}


def test_op4_whole_texts_and_phrases(spark):
    rows = [(f, t) for f, t in WHOLE.items()] + [(f, f"Some prose stands here, and goes on.\n\n{t}\n\nMore of it, below.") for f, t in WHOLE.items()] + [(f, t) for f, ts in PHRASES.items() for t in ts]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id bigint, text string")).collect()}
    for k, (family, text) in enumerate(rows):
        assert ("unknown" if got[k].family == "none" else got[k].family, got[k].confirmed) == (family, family != "unknown"), (family, text, got[k])
        assert set(got[k].families) <= {family, "unknown"}, (family, text, got[k])


#: Written for an earlier model and judged once with it: 24 of 30 right. Sentences for the present one are in ``test_licenses_held.py``.
FRESH = {
    "mit": ["Feel free to reuse this; it is MIT licensed.", "All code samples are provided under the terms of the MIT License.", "License: MIT"],
    "apache-2.0": ["Sources are covered by version 2.0 of the Apache License.", "We publish the project under Apache License, Version 2.0."],
    "bsd": ["The parser is offered under a BSD-style license with two clauses.", "Covered by the 2-clause BSD licence."],
    "gpl-2.0": ["This driver may be distributed under the terms of the GPL version 2.", "GPL-2.0-only"],
    "gpl-3.0": ["You can redistribute it under version 3 of the GNU General Public License.", "Available under GPLv3."],
    "agpl-3.0": ["The server is licensed under AGPL-3.0."],
    "lgpl": ["The bindings are released under the GNU Lesser General Public License."],
    "mpl-2.0": ["Files here are governed by the Mozilla Public License, version 2.0."],
    "isc": ["It is published under the ISC license."],
    "cc-by-4.0": ["Photos are shared under a Creative Commons Attribution 4.0 licence."],
    "cc-by-sa-4.0": ["Text is available under the Creative Commons Attribution-ShareAlike 4.0 License."],
    "cc0-1.0": ["The dataset is dedicated to the public domain under CC0 1.0."],
    "public-domain": ["These maps are in the public domain."],
    "all-rights-reserved": ["(c) 2019 Example Press. All rights reserved."],
    "unknown": ["We have not released this under the GPL.", "The MIT Press published the book.", "Her fishing licence expired in June.", "The city reserved all rights of way.", "Apache is the name of a web server.", "The general public may use the park.", "Never distributed under the BSD license.", "Version 2 of the report was released on Monday.", "Software patents are a subject of debate.", "He lost his source of income."],
}


def test_op4_on_fresh_sentences():
    model = licenses.train()
    right = [f == model.judge(t)[0] for f, ts in FRESH.items() for t in ts]
    assert len(right) == 30 and np.mean(right) >= 0.75


def test_op4_several_in_one_line(spark):
    rows = ["Licensed under MIT or Apache-2.0.", "Licensed under the Apache License, Version 2.0 and the MIT license.", "SPDX-License-Identifier: MIT OR Apache-2.0", "Released under the MIT License."]
    got = {r.doc_id: sorted(r.families) for r in licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()}
    assert got == {0: ["apache-2.0", "mit"], 1: ["apache-2.0", "mit"], 2: ["apache-2.0", "mit"], 3: ["mit"]}


def test_op4_unknown_is_calibrated():
    """What the model is sure of is mostly right, on the phrases it was adjusted by (see ``FRESH`` for others)."""
    model = licenses.train()
    kept = [(f, t) for f, ts in PHRASES.items() for t in ts]
    judged = [(f, *model.judge(t)[:2]) for f, t in kept]
    sure = [f == name for f, name, p in judged if p >= 0.8]
    assert len(sure) >= 0.7 * len(kept) and np.mean(sure) >= 0.9


def test_op4_filter_drops_no_family():
    model = licenses.train()
    strong, weak = licenses.needed(model)
    last, rng = len(model.classes) - 1, random.Random(5)
    gains = [(set(g.split()), np.maximum(w[:last] - w[last], 0)) for g, w in model.weights.items()]
    assert not set(strong) & set(weak) and all(words & {*strong, *weak} for words, g in gains if g.any())
    for _ in range(400):
        there = {*rng.sample(weak, licenses.LEAST_WORDS - 1), *licenses._COMMON}
        assert (model.bias[:last] - model.bias[last] + sum((g for words, g in gains if words <= there), np.zeros(last)) < 0).all()


def test_lattice():
    assert len(embeddings.SHORTEST) == 240 and np.allclose((embeddings.SHORTEST**2).sum(axis=1), 2)
    x = np.random.default_rng(0).standard_normal((500, 8)) * 2
    p = embeddings.nearest_e8(x)
    d = ((x - p) ** 2).sum(axis=1)
    assert (d <= 1 + 1e-9).all()  # the covering radius is 1
    for v in embeddings.SHORTEST:
        assert (d <= ((x - p - v) ** 2).sum(axis=1) + 1e-9).all()


def test_op9_recall(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((150, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = []
    for k, b in enumerate(base):
        rows.append((b * rng.uniform(0.5, 2), k % 3))
        for c in (0.94, 0.96, 0.99):
            r = rng.standard_normal(64)
            r -= (r @ b) * b
            rows.append((c * b + np.sqrt(1 - c * c) * r / np.linalg.norm(r), k % 3))
    x = np.array([r[0] for r in rows], dtype=np.float32)
    label = np.array([r[1] for r in rows])
    df = spark.createDataFrame([(k, v.tolist(), int(n)) for k, (v, n) in enumerate(zip(x, label, strict=True))], "vec_id bigint, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    found = np.array([got[k].n_links for k in range(len(x))])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.95 * near.sum()


def linked(rows, least=0.93):
    """(n_links, component_id, kept) of rows (vec_id, label, vector), by brute force."""
    x = np.array([r[2] for r in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[1] for r in rows])
    near = (x @ x.T >= least) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            new = set(np.flatnonzero(near[todo.pop()]).tolist()) - seen
            seen |= new
            todo += new
        least_id = min(rows[j][0] for j in seen)
        out.append((rows[k][0], int(near[k].sum()), least_id, rows[k][0] == least_id))
    return sorted(out)


@pytest.mark.parametrize(("small", "block"), [(64, 1024), (2, 8), (0, 5)])
def test_op9_all_columns(spark, monkeypatch, small, block):
    """Clouds, copies, chains and repeated ids; with small cells alone, and with cells of both kinds in several blocks."""
    monkeypatch.setattr(embeddings, "SMALL", small)
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", block)
    rng = np.random.default_rng(8)
    rows = []
    for k in range(12):
        centre = rng.standard_normal(32)
        for _ in range(int(rng.integers(1, 14))):
            v = centre + rng.standard_normal(32) * 0.06
            rows += [(len(rows), k % 3, v)] * int(rng.integers(1, 3))
        step = rng.standard_normal(32)
        step -= (step @ centre) / (centre @ centre) * centre
        step *= 0.27 * np.linalg.norm(centre) / np.linalg.norm(step)  # no cosine is near the bound
        rows += [(1000 * (k + 1) - j, k % 3, centre + j * step) for j in range(6)]
    rows += [(5, 0, rng.standard_normal(32)), (5, 2, rows[0][2]), (5, 1, rows[40][2])]
    df = spark.createDataFrame([(int(v), [float(a) for a in x], int(n)) for v, n, x in rows], "vec_id bigint, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect())
    want = linked(rows)
    assert sum(w[1] for w in want) > 500 and got == want


@pytest.mark.parametrize(("low", "high", "least"), [(0.93, 0.935, 0.96), (0.94, 0.941, 0.985)])
def test_op9_cells_at_the_least_cosine(low, high, least):
    rng = np.random.default_rng(6)
    a, r = rng.standard_normal((2, 4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r -= (r * a).sum(axis=1, keepdims=True) * a
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    c = rng.uniform(low, high, (4000, 1))
    x, y = embeddings.cells(a), embeddings.cells(c * a + np.sqrt(1 - c * c) * r)
    met = ((x[:, :, :1] == y) | (y[:, :, :1] == x)).any(axis=(1, 2))
    print("met", low, high, met.mean())
    assert met.mean() >= least


def accuracy(rows, truth, of):
    own = [(of(r), truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    return np.mean([a == b for a, b in own])


def test_op3_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    rows = catalog.queries()["op3_quality"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows)
    assert accuracy(rows, truth, lambda r: r.predicted) > 0.9


def test_op10_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    rows = catalog.queries()["op10_language"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert accuracy(rows, truth, lambda r: r.lang_pred) > 0.97


def test_op3_score_is_the_calibrated_difference(spark):
    """The scores again, by zstandard and the logistic function on the difference alone; and of an empty text."""
    import zstandard

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    packers = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, ""), (-2, None)], "doc_id bigint, text string"))
    got = {r.doc_id: r for r in quality.scored(rows, model).collect()}
    slope, bias = model.weights
    for r in rows.collect():
        raw = (r.text or "").encode()
        good, bad = (sum(len(p.compress(raw[k : k + 512])) for k in range(0, len(raw), 512)) for p in packers)
        score = 1 / (1 + math.exp(-(slope * 20 * (bad - good) / (len(raw) + 16) + bias)))
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-9) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.7)
    assert slope > 0 and got[-1].score == got[-2].score == pytest.approx(1 / (1 + math.exp(-bias))) and got[-1].predicted == 0


def slow_language(model, text):
    """The language and score by one dictionary of trigrams and loops over the machines of the nodes on the way."""
    raw = "".join(c.lower() if c.isascii() else c for c in text).encode()
    raw = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in raw)
    counts = {}
    for k in range(len(raw) - 2):
        code = raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]
        if code != 0x202020:
            h = (code * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - language.BITS)
            counts[h] = counts.get(h, 0) + 1
    total, node, score = max(sum(counts.values()), 1), model.root, 1.0
    while isinstance(node, language.Node):
        many = len(node.children)
        votes, duels = [0.0] * many, []
        for k, (a, b) in enumerate((a, b) for a in range(many) for b in range(a + 1, many)):
            margin = sum(float(node.weights[k][h]) * c / total for h, c in counts.items()) + node.bias[k]
            p = 1 / (1 + math.exp(-margin * node.scale[k]))
            votes[a] += (p >= 0.5) + p * 1e-3
            votes[b] += (p < 0.5) + (1 - p) * 1e-3
            duels.append((a, b, p))
        best = votes.index(max(votes))
        score *= min(p if best == a else 1 - p for a, b, p in duels if best in (a, b))
        node = node.children[best]
    return model.languages[node], score


def test_op10_by_loops(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 7 = 0")
    model = language.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    for r in language.identified(docs, model).collect():
        name, score = slow_language(model, r.text or "")
        if any(c.isalpha() for c in r.text or ""):
            assert r.lang_pred == name and r.lang_score == pytest.approx(score, abs=1e-3)


def test_many_languages():
    """Three hundred made-up languages, of known and unknown families: no refusal, few machines, and the right answer."""
    rng = np.random.default_rng(3)
    codes = [c for own in language.FAMILIES.values() for c in own.split()] + [f"x{k}" for k in range(250)]
    words = {c: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 8))) for _ in range(30)] for c in codes}
    text = lambda c: " ".join(rng.choice(words[c], 60))
    names = [c for c in codes for _ in range(12)]
    model = language.fit_shares(language.shares(*texts_of(pa.array([text(c) for c in names]))).astype(np.float32), names)

    def machines(node):
        return len(node.weights) + sum(machines(c) for c in node.children if isinstance(c, language.Node))

    assert len(model.languages) == len(codes) and machines(model.root) < 10 * len(codes)
    held = [c for c in codes for _ in range(2)]
    best, _ = language.predict(model, *texts_of(pa.array([text(c) for c in held])))
    assert np.mean([model.languages[k] == c for k, c in zip(best, held, strict=True)]) > 0.97


def test_pipeline(spark, reference):
    """Stage by stage on whole tables: what is dropped is what the stage's operator says, and the last stage's rows are the library's."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
    assert sizes[1] >= 0.98 * sizes[0] and sizes[2] < sizes[1] and sizes[3] <= sizes[2]
    want = sorted((r.doc_id, len(ids := reference.encode_ordinary(r.text)), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()) for r in docs.collect())
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want
