"""Quality by compression: zstandard dictionaries of good and of bad text.

Half of a bounded sample of labelled documents trains two dictionaries, from their whole texts. A text, cut
into blocks (so that a dictionary counts all along it), is compressed with either; (bad size - good size)
over the text's length, the bytes a byte of it that the good dictionary saves, is its difference. A logistic
fit on the other half of the sample turns the difference alone into the probability of label 1.

Defined results: a null text counts as empty; an empty text has difference 0, which neither dictionary
favours, and the score of the fit there; rows of null label, or whose doc_id has no label, are scored but
not learnt from; a doc_id labelled twice counts with its smaller label; if a label has no rows, all scores
are (ones + 1) / (rows + 2); an empty table stays empty. Other columns pass through ``scored``; where
one has the name of an added column, the added one gets an underscore behind its name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import added, below_share, chunks, table, texts_of

#: Labelled documents of each class to learn from at most; their texts are cut into pieces for the training of dictionaries.
SAMPLE = 4000
PIECE_BYTES = 2048
DICTIONARY_BYTES = 112 << 10
BLOCK_BYTES = 512
#: Added to a text's length, so that the few bytes of a very short one weigh little.
LEAST_BYTES = 16
LEVEL = 3
ACCEPT = 0.7


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray | None
    base: float


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.packers = []
        if model.good:
            for raw in (model.good, model.bad):
                own = zstandard.ZstdCompressionDict(raw)
                own.precompute_compress(level=LEVEL)
                self.packers.append(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_dict_id=False))

    def difference(self, text: bytes) -> float:
        """The normalised difference of the compressed sizes."""
        blocks = [text[k : k + BLOCK_BYTES] for k in range(0, len(text), BLOCK_BYTES)]
        good, bad = (sum(len(p.compress(b)) for b in blocks) for p in self.packers)
        return (bad - good) / (len(text) + LEAST_BYTES)

    def score(self, differences: np.ndarray) -> np.ndarray:
        if self.model.weights is None:
            return np.full(len(differences), self.model.base)
        return 1 / (1 + np.exp(-np.clip(_design(differences) @ self.model.weights, -35, 35)))


def _design(differences: np.ndarray) -> np.ndarray:
    return np.stack([differences * 20, np.ones(len(differences))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return w


def remainder(modulus: int):
    """crc32 of the doc_id as text, modulo ``modulus``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Dictionaries and calibration from labelled documents whose remainder by 4 is not 2, at most ``SAMPLE`` of each label."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("__quality")).where(remainder(4) != 2)
    mark = F.xxhash64("doc_id", F.lit(11))
    counts = {r[0]: r[1] for r in known.groupBy("__quality").count().collect()}
    # About three times as many by hash, so that choosing the smallest moves few rows, however many tasks there are.
    near = lambda q: below_share(F.col("__mark"), 3 * SAMPLE / max(counts.get(q, 0), 1))
    of = lambda q: known.where(F.col("__quality") == q).select("doc_id", "__quality", mark.alias("__mark")).where(near(q)).orderBy("__mark", "doc_id").limit(SAMPLE)
    sample = of(0).unionByName(of(1))
    # At most 2 * SAMPLE rows of three numbers, whatever the input.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    trains = F.pmod(F.shiftright("__mark", 7), F.lit(2)) == 0

    def cut(batches):
        for batch in chunks(batches, "text"):
            data, offsets = texts_of(batch.column("text"))
            out = {"doc_id": [], "quality": [], "piece": []}
            for doc, quality, a, b in zip(batch.column("doc_id").to_pylist(), batch.column("__quality").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for at in range(a, b, PIECE_BYTES):
                    out["doc_id"].append(doc)
                    out["quality"].append(quality)
                    out["piece"].append(data[at : min(at + PIECE_BYTES, b)].tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("piece", pa.binary())]))

    pieces = sorted(map(tuple, rows.where(trains).select("doc_id", F.col("__quality").cast("int").alias("__quality"), "text").mapInArrow(cut, "doc_id bigint, quality int, piece binary").collect()))
    base = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    dictionaries = {}
    for q in (0, 1):
        own = [bytes(p) for _, quality, p in pieces if quality == q and p]
        if not own:
            return Model(b"", b"", None, base)
        dictionaries[q] = _dictionary(own)
    model = Model(dictionaries[1], dictionaries[0], None, base)

    def measure(batches):
        scorer = Scorer(model)
        for batch in chunks(batches, "text"):
            data, offsets = texts_of(batch.column("text"))
            found = np.array([scorer.difference(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__quality"), pa.array(found)], names=["doc_id", "quality", "difference"])

    points = sorted(map(tuple, rows.where(~trains).select("doc_id", F.col("__quality").cast("int").alias("__quality"), "text").mapInArrow(measure, "doc_id bigint, quality int, difference double").collect()))
    y = np.array([p[1] for p in points], dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(b"", b"", None, base)
    # The sample may hold more of one label than the table does; the fit is of the table's shares.
    share = {q: counts[q] / max((y == q).sum(), 1) for q in (0, 1)}
    w = _logistic(_design(np.array([p[2] for p in points])), y)
    w[-1] += np.log(share[1] / share[0])
    model.weights = w
    return model


def _dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary; of too little text for that, which is short of a dictionary's size, the text itself."""
    order = np.random.default_rng(5).permutation(len(pieces))
    pieces = [pieces[k] for k in order]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces).ljust(8, b" ")


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with the columns score (of its whole text) and predicted."""
    names = [added(docs, "score"), added(docs, "predicted")]
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches):
        scorer = Scorer(model)
        for batch in chunks(batches, text):
            data, offsets = texts_of(batch.column(text))
            if model.weights is None:
                score = np.full(batch.num_rows, model.base)
            else:
                score = scorer.score(np.array([scorer.difference(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= ACCEPT).astype(np.int32))], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def op3_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")
