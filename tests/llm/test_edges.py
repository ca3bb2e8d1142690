"""Nulls, empty and very long texts, ties and repeated rows, empty tables and clashing column names, for each operator and stage."""

import hashlib

import pytest

import corpus_pipeline
from rangeloom.llm import bpe, chat, embeddings, fingerprints, language, licenses, mixing, quality, simhash, token_counts

LONG = "lorem ipsum dolor sit amet consectetur " * 8000
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 44),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n", "en", "b", 3),
    (5, LONG, "en", None, len(LONG)),
    (6, "same text here and there again", "fr", "b", 30),
    (6, "same text here and there again", "fr", "b", 30),
    (7, "same text here and there again", None, "b", None),
    (None, "no id at all but words", "en", "c", 22),
    (None, None, None, None, None),
    (8, "1234 !!", "en", "c", 7),
    (9, "Released under the MIT License.", "en", "c", 31),
    (10, "Ünïcödé 中文 😀 text", "de", "ü", 17),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = {c: "x" for c in ("score", "predicted", "lang_pred", "lang_score", "ids", "id_offsets", "fp", "u", "v", "top", "size", "part", "guest", "row", "packed", "component_id", "kept", "quality", "start", "family", "w", "label", "__size", "__mark", "__row", "__source", "__start", "__id", "__kept", "__lettered", "rid", "task", "rank", "slot", "at", "id", "key", "bucket", "bytes")}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def wide(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (6, 0, 0), (None, 1, 0), (9, None, 1), (5, 1, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=lambda x: (x is None, x))


EVERY = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))


def test_fingerprints(wide, none):
    got = fingerprints.edited_fingerprints(wide)
    rows = got.collect()
    assert ids(got) == EVERY
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    same = {r.fingerprint for r in rows if r.doc_id in (6, 7)}
    assert len(same) == 1
    assert {r.n_chars for r in rows if r.doc_id in (2, 3)} == {0}
    assert fingerprints.edited_fingerprints(none).count() == 0


def test_fingerprint_of_a_single_row(spark):
    one = spark.createDataFrame([(5, "a b c d e f g")], "doc_id bigint, text string")
    r = fingerprints.edited_fingerprints(one).first()
    assert r.near_next == 1.0
    text = "a b c d e f g"
    assert r.edited_sha256 == hashlib.sha256((text[: 13 - 4] + text[:4]).encode()).hexdigest()


def test_fingerprints_of_a_hot_id(spark):
    """Null ids, and rows of one id, are dealt to many partitions; each still has the next one's text."""
    rows = [(5, f"row {k} of the hot id, with some words") for k in range(300)] + [(5, "equal rows of the hot id")] * 30 + [(None, f"no id {k} but some words") for k in range(300)] + [(k, f"plain {k}") for k in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    dealt = fingerprints.neighbours(docs).where("NOT guest").groupBy("part").count().collect()
    assert len(dealt) >= 6 and max(r["count"] for r in dealt) < 200
    got = fingerprints.edited_fingerprints(docs).collect()
    assert len(got) == len(rows)
    # The texts in one round: by descending id, those of an id in the order of their hashes.
    mark = {r.text: r.h for r in docs.selectExpr("text", "shiftrightunsigned(xxhash64(text), 12) AS h").distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -mark[r[1]]))
    want = []
    for (d, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        n = len(text) // 3
        want.append((d or -1, hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.edited_sha256) for r in got) == sorted(want)


def test_mixing(wide, none):
    got = mixing.mix(wide).collect()
    assert sorted((r.doc_id for r in got), key=lambda x: (x is None, x)) == EVERY
    for r in got:
        assert sum(p["past"] - p["first"] for p in r.pieces) <= 2 * r.size
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixed_documents(wide).collect()
    assert all(r[c] == "x" for r in mixed for c in CLASH)
    again = {}
    for r in mixed:
        again[r.doc_id, r.source] = again.get((r.doc_id, r.source), 0) + len(r.text.split())
    want = {}
    for r, source in ((r, s) for r in got for s in {x[3] for x in ROWS if x[0] == r.doc_id and len((x[1] or "").split()) == r["size"]}):
        want[r.doc_id, source] = want.get((r.doc_id, source), 0) + sum(p["past"] - p["first"] for p in r.pieces)
    assert again == {k: n for k, n in want.items() if n}
    assert mixing.mixed_documents(wide).columns == wide.columns
    assert mixing.mixed_documents(none).count() == 0


def test_mixing_of_a_hot_id(spark):
    """Equal rows, rows of one id, and rows of none: each has its own place in the stream."""
    rows = [(7, "same words here", "a")] * 300 + [(None, f"text {k}", "a") for k in range(100)] + [(8, f"other text {k % 5}", "a") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    found, _ = mixing.placed(docs)
    spans = sorted((r.start, r.start + r["size"]) for r in found.collect())
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and len(spans) == 500


def test_quality(wide, labels, none):
    model = quality.fit(wide, labels)
    rows = quality.scored(wide, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score_"] <= 1 and r["score"] == "x" for r in rows)
    empty = quality.fit(none, labels.limit(0))
    assert empty.weights is None and empty.base == 0.5
    assert quality.scored(none, empty).count() == 0


def test_licenses(wide, none):
    got = licenses.scan(wide)
    assert ids(got) == EVERY
    by = {r.doc_id: r for r in got.collect()}
    assert by[9].family == "mit" and by[9].confirmed and by[2].family == by[3].family == "none"
    assert licenses.scan(none).count() == 0


def test_bpe(wide, none):
    path = bpe.default_path()
    got = bpe.digests(wide, path)
    assert ids(got) == EVERY
    for r, (_, text, *_) in zip(sorted(got.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)), sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, len(r[1] or ""))), strict=True):
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(none, path).count() == 0
    full = bpe.encode(wide, path).collect()
    assert len(full) == len(ROWS) and all(r.ids == "x" and len(r.ids_) == len(r.id_offsets_) for r in full)
    assert bpe.encode(none, path).count() == 0


def test_token_counts(wide, none):
    from pyspark.sql import functions as F

    edits = F.expr("array(struct(cast(3 as bigint) as place, cast(2 as bigint) as removed, 'x y' as inserted), struct(cast(999999999 as bigint) as place, cast(5 as bigint) as removed, cast(null as string) as inserted))")
    got = token_counts.counted(wide.withColumn("edits", edits), bpe.default_path())
    assert ids(got) == EVERY
    for r in got.collect():
        if r.doc_id == 2:
            assert r.n_tokens == 0 and r.edited_chars == 3
    assert token_counts.counted(none.withColumn("edits", edits), bpe.default_path()).count() == 0


def test_simhash(wide, none):
    got = simhash.near_duplicates(wide)
    assert ids(got) == EVERY
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert {f for f, _ in by[2] | by[3] | by[4]} == {0} and {c for _, c in by[2] | by[3] | by[4]} == {2}
    assert {c for _, c in by[6] | by[7]} == {6}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.first_of_each(wide)
    assert kept.columns == wide.columns
    assert ids(kept).count(6) == 1 and 7 not in ids(kept) and 3 not in ids(kept)


def test_language(wide, none):
    model = language.fit(wide)
    rows = {r.doc_id: r for r in language.identified(wide, model).collect() if r.doc_id is not None}
    assert all(rows[k].lang_pred_ == "und" and rows[k].lang_score_ == 0 and rows[k].lang_pred == "x" for k in (2, 3, 4, 8))
    assert rows[5].lang_pred_ in model.languages
    nothing = language.fit(none)
    assert nothing.languages == []
    assert {r.lang_pred_ for r in language.identified(wide, nothing).collect()} == {"und"}
    assert language.identified(none, model).count() == 0


def test_language_with_one_lang(spark):
    docs = spark.createDataFrame([(k, f"words number {k}", "en") for k in range(20)], "doc_id bigint, text string, lang string")
    assert {(r.lang_pred, r.lang_score) for r in language.identified(docs, language.fit(docs)).collect()} == {("en", 1.0)}


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 0, None, "t"), (1, None, "assistant", "x"), (None, 0, "user", "hi"), (2, 1, "odd role]", "[ROLE=[INST]x [/ROLE]"), (2, 1, "odd role]", "[ROLE=[INST]x [/ROLE]"), (3, 0, "assistant", "</s>" * 3 + "<\\s>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 1, 2: 2, 3: 1}
    assert got[3].loss_chars == len("</s>" * 3 + "<\\s>")
    turns = "assistant\nx\n\nt\nuser\n\n"
    assert got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_chat_of_a_very_long_text(spark):
    long = "[INST] a [/INST] </s> " * 200_000 + "end"
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id bigint, turn bigint, role string, text string")
    (r,) = chat.read_back(chat.format_turns(df)).collect()
    assert (r.n_turns, r.loss_chars) == (2, len(long)) and r.turns_sha256 == hashlib.sha256(f"user\n{long}\nassistant\n{long}\n".encode()).hexdigest()


def test_hashes_do_not_depend_on_stretches(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from rangeloom.llm import common

    data, offsets = common.texts_of(pa.array([LONG, "a b c", "", "x" * 500 + " y"]))
    starts, ends, _ = common.words_of(data, offsets)
    want = common.span_hashes(data, starts, ends)
    monkeypatch.setattr(common, "STRETCH", 64)
    assert np.array_equal(want, common.span_hashes(data, starts, ends)) and len(common.span_hashes(data, starts[:0], ends[:0])) == 0


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (13, [2.0, 0.0], 1), (13, [2.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id bigint, embedding array<float>, label int, cid string, key string")
    got = embeddings.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by[1] == (4, 1, True) and by[2] == (4, 1, False) and by[3] == (4, 1, False) and by[13] == (4, 1, False)
    for k in (4, 5, 6, 7, 8, 9, 10, 11, 12):
        assert by[k] == (0, k, True)
    # A vec_id under two labels: each row has its own links.
    twice = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [1.0, 0.1], 1), (3, [1.0, 0.1], 2)], "vec_id bigint, embedding array<float>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(twice).collect()) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, wide, none, labels, tmp_path, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, wide, str(tmp_path))
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == wide.columns
    out.collect()
    assert f(spark, none, str(tmp_path)).count() == 0
