"""Language identification in steps: the family, then the language within it.

A text's features are the shares of its hashed byte trigrams (letters lower-cased, everything else that
is ASCII a blank). Linear support vector machines (squared hinge) tell the families apart pair by pair, and
then, only for texts of a family, its languages pair by pair; votes decide, margins break ties. Where more
than ``WIDTH`` families or languages of a family meet, they are first told apart in up to ``WIDTH`` groups
of like ones, so that the number of machines grows with that of languages, not with its square. Trigrams are
counted once a text, and each step is one product with its machines' weights.

Learnt from a bounded sample: of the ``MOST_LANGUAGES`` languages with the most documents (ties by name)
up to ``SAMPLE`` documents each, ``SAMPLE_ALL`` in all (but 20 of each); whole texts and a short excerpt of each.

Defined results: a null text, or one without any letter, is ``und`` with score 0; so is every text if
nothing could be learnt. With one language learnt, every other text is it, with score 1. Documents of
null lang are classified but not learnt from; rows that repeat are classified alike; an empty table
stays empty. Other columns pass through ``identified``; where one has the name of an added column, the
added one gets an underscore behind its name.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import added, chunks, lowered, table, texts_of
from .quality import remainder

#: Families of languages, by ISO 639-1 code. A language that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is",
    "romance": "fr es it pt ro ca gl",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk uz",
    "indo-aryan": "hi mr ne bn gu pa ur",
    "dravidian": "ta te kn ml",
    "semitic": "ar he",
    "sinitic": "zh",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
BITS = 12
#: Documents of a language to learn from at most, and of all languages.
SAMPLE, SAMPLE_ALL = 400, 4000
MOST_LANGUAGES = 1000
WIDTH = 16
#: Texts whose shares a task holds at a time.
ROWS = 256
EXCERPT_BYTES = 80
ACCEPT = 0.3

_LETTERS = np.full(256, 0x20, dtype=np.uint8)
_LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte trigrams that lie within each row, and how many stand before each row. Rows shorter than three bytes have none."""
    letters = _LETTERS[lowered(data)].astype(np.uint32)
    code = letters[:-2] << 16 | letters[1:-1] << 8 | letters[2:] if len(letters) > 2 else np.zeros(0, dtype=np.uint32)
    hashed = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    inside = np.ones(len(hashed), dtype=bool)
    edge = offsets[1:]
    for back in (1, 2):
        at = edge - back
        inside[at[(at >= 0) & (at < len(inside))]] = False
    inside &= code != 0x202020
    return hashed[inside], np.concatenate([[0], np.cumsum(inside)])[np.minimum(offsets, len(inside))]


def shares(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The share of each trigram hash in each row."""
    hashed, first = trigrams(data, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    counts = np.bincount(rows * (1 << BITS) + hashed, minlength=(len(offsets) - 1) << BITS).reshape(-1, 1 << BITS)
    return counts / np.maximum(np.diff(first), 1)[:, None]


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 30.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """A linear SVM (squared hinge, the bias penalised like a weight) by Newton steps with conjugate gradients; y is +1 or -1."""
    weight = np.where(y > 0, 1 / max((y > 0).sum(), 1), 1 / max((y < 0).sum(), 1)) * c / 2
    ahead = lambda w: x @ w[:-1].astype(x.dtype) + w[-1]
    back = lambda g: np.append(x.T @ g.astype(x.dtype), g.sum())
    w = np.zeros(x.shape[1] + 1)
    value = lambda w: 0.5 * w @ w + (weight * np.maximum(0, 1 - y * ahead(w)) ** 2).sum()
    for _ in range(rounds):
        slack = 1 - y * ahead(w)
        on = weight * (slack > 0)
        gradient = w - 2 * back(on * y * slack)
        if np.linalg.norm(gradient) < 1e-5 * (1 + np.linalg.norm(w)):
            break
        step, r = np.zeros_like(w), -gradient
        p, rr = r.copy(), r @ r
        for _ in range(40):
            hp = p + 2 * back(on * ahead(p))
            a = rr / (p @ hp)
            step += a * p
            r -= a * hp
            new = r @ r
            if new < 1e-8 * (gradient @ gradient):
                break
            p, rr = r + new / rr * p, new
        size, now = 1.0, value(w)
        while size > 1e-4 and value(w + size * step) > now:
            size /= 2
        w = w + size * step
    return w[:-1], float(w[-1])


@dataclass
class Node:
    """Children (numbers of languages, or nodes) and, for each pair of them, the weights by trigram hash, the bias, and the scale of a margin."""

    children: list
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    scale: np.ndarray | None = None

    def languages(self) -> list[int]:
        return [k for c in self.children for k in (c.languages() if isinstance(c, Node) else [c])]


@dataclass
class Model:
    languages: list[str]
    root: Node | None = None


def _scale(margin: np.ndarray, y: np.ndarray) -> float:
    """The factor that makes sigmoid(factor * margin) the likeliest."""
    return min((k for k in (0.5, 1, 1.5, 2, 3, 4, 6, 8, 12)), key=lambda k: np.logaddexp(0, -k * y * margin).mean())


def _grouped(children: list, centres: np.ndarray) -> list:
    """The children or, of more than ``WIDTH``, as many nodes of like ones: neighbours along the direction in which their centres (a row a language) differ most."""
    if len(children) <= WIDTH:
        return children
    own = np.array([centres[c.languages() if isinstance(c, Node) else [c]].mean(axis=0) for c in children])
    own = own - own.mean(axis=0)
    place = own @ np.linalg.svd(own, full_matrices=False)[2][0]
    groups = np.array_split(np.argsort(place, kind="stable"), WIDTH)
    return [Node(_grouped([children[k] for k in g], centres)) if len(g) > 1 else children[g[0]] for g in groups]


def fit_shares(x: np.ndarray, names: list[str]) -> Model:
    """The model from shares of trigrams (a row each) and their languages. Changes ``x``."""
    languages = sorted(set(names))
    number = {name: k for k, name in enumerate(languages)}
    of = np.array([number[n] for n in names])
    groups: dict[str, list[int]] = {}
    for k, name in enumerate(languages):
        groups.setdefault(_FAMILY.get(name.lower().split("-")[0], f"only {name}"), []).append(k)
    if len(languages) < 2:
        return Model(languages)
    # In place: the shares are the only large array here.
    mean = x.mean(axis=0)
    spread = (np.sqrt(np.maximum(mean - np.array([np.sqrt(x[:, k]).mean() for k in range(x.shape[1])]) ** 2, 0)) * np.sqrt(mean) + 1e-4).astype(x.dtype)
    x /= spread
    size = float(np.sqrt(np.einsum("ij,ij->", x, x) / len(x)))
    x /= x.dtype.type(size)
    centres = np.array([x[of == k].mean(axis=0) for k in range(len(languages))])
    families = [own[0] if len(own) == 1 else Node(_grouped(own, centres)) for own in groups.values()]
    root = families[0] if len(families) == 1 else Node(_grouped(families, centres))

    def train(node: Node) -> None:
        members = [np.isin(of, c.languages() if isinstance(c, Node) else [c]) for c in node.children]
        planes = []
        for a, b in itertools.combinations(members, 2):
            planes.append(_plane(x if (a | b).all() else x[a | b], np.where(a[a | b], 1.0, -1.0)))
        node.weights = np.array([p[0] / spread / size for p in planes], dtype=np.float32)
        node.bias, node.scale = np.array([p[1] for p in planes]), np.array([p[2] for p in planes])
        for c in node.children:
            if isinstance(c, Node):
                train(c)

    train(root)
    return Model(languages, root)


def _plane(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float]:
    w, b = train_svm(x, y)
    return w, b, _scale(x @ w.astype(x.dtype) + b, y)


def predict(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's language and its score."""
    n = len(offsets) - 1
    out, score = np.zeros(n, dtype=np.int64), np.ones(n)
    if model.root is None:
        return out, score

    def descend(node, rows: np.ndarray, x: np.ndarray) -> None:
        """Rows (of numbers ``rows``, shares ``x``) to the child that wins, and on from there."""
        if not isinstance(node, Node):
            out[rows] = node
            return
        sure = 1 / (1 + np.exp(-np.clip((x @ node.weights.T + node.bias) * node.scale, -35, 35)))
        best, trust = _vote(sure, list(itertools.combinations(range(len(node.children)), 2)), len(node.children))
        score[rows] *= trust
        for k in np.unique(best):
            descend(node.children[k], rows[best == k], x[best == k])

    for first in range(0, n, ROWS):
        own = offsets[first : first + ROWS + 1]
        descend(model.root, np.arange(first, first + len(own) - 1), shares(data[own[0] : own[-1]], own - own[0]).astype(np.float32))
    return out, score


def _vote(sure: np.ndarray, pairs: list[tuple[int, int]], many: int) -> tuple[np.ndarray, np.ndarray]:
    """The winner of one-versus-one votes in each row, and the least certainty of its duels."""
    votes = np.zeros((len(sure), many))
    for k, (a, b) in enumerate(pairs):
        votes[:, a] += (sure[:, k] >= 0.5) + sure[:, k] * 1e-3
        votes[:, b] += (sure[:, k] < 0.5) + (1 - sure[:, k]) * 1e-3
    best = votes.argmax(axis=1)
    least = np.ones(len(sure))
    for k, (a, b) in enumerate(pairs):
        least = np.where(best == a, np.minimum(least, sure[:, k]), np.where(best == b, np.minimum(least, 1 - sure[:, k]), least))
    return best, least


def fit(docs: DataFrame) -> Model:
    """A model from documents whose remainder by 5 is not 0: for each lang the ``SAMPLE`` of smallest hash, fewer if there are many langs."""
    known = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").where(remainder(5) != 0)
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return Model([])
    many = max(20, min(SAMPLE, SAMPLE_ALL // len(counts)))
    mark = F.xxhash64("doc_id", F.lit(12))
    # Of each language about three times as many by hash, so that ranking them moves few rows, however many tasks there are.
    bounds = docs.sparkSession.createDataFrame([(name, 3 * many / n) for name, n in sorted(counts.items())], "lang string, near double")
    near = F.col("mark") / F.lit(2.0**64) + 0.5 < F.col("near")
    nearest = Window.partitionBy("lang").orderBy("mark", "doc_id")
    # As many rows of bounds as languages.
    sample = known.select("doc_id", "lang", mark.alias("mark")).join(F.broadcast(bounds), "lang").where(near).withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= many)
    # At most SAMPLE_ALL ids (or 20 of each lang), whatever the input.
    rows = known.select("doc_id", "text", "lang").join(F.broadcast(sample.select("doc_id", "lang").distinct()), ["doc_id", "lang"])

    def run(batches):
        for batch in chunks(batches, "text"):
            for k in range(0, batch.num_rows, 500):
                own = batch.slice(k, 500)
                data, offsets = texts_of(own.column("text"))
                marks = own.column("doc_id").to_numpy()
                spare = np.maximum(np.diff(offsets) - EXCERPT_BYTES, 0)
                starts = offsets[:-1] + (marks.astype(np.uint64) * np.uint64(2654435761) % (spare.astype(np.uint64) + np.uint64(1))).astype(np.int64)
                ends = np.minimum(starts + EXCERPT_BYTES, offsets[1:])
                parts = [data[a:b] for a, b in zip(starts, ends, strict=True)]
                whole = shares(data, offsets).astype(np.float32)
                part = shares(np.concatenate(parts), np.concatenate([[0], np.cumsum(ends - starts)])).astype(np.float32)
                for x in (whole, part):
                    there = [np.flatnonzero(r) for r in x]
                    yield pa.RecordBatch.from_arrays(
                        [own.column("doc_id"), own.column("lang"), pa.array([t.astype("<u2").tobytes() for t in there], pa.binary()), pa.array([r[t].tobytes() for r, t in zip(x, there, strict=True)], pa.binary())],
                        names=["doc_id", "lang", "hashes", "shares"],
                    )

    found = sorted(map(tuple, rows.mapInArrow(run, "doc_id bigint, lang string, hashes binary, shares binary").collect()))
    x = np.zeros((len(found), 1 << BITS), dtype=np.float32)
    for r, (_, _, hashes, own) in enumerate(found):
        x[r, np.frombuffer(hashes, dtype="<u2")] = np.frombuffer(own, dtype=np.float32)
    return fit_shares(x, [r[1] for r in found])


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with the columns lang_pred and lang_score."""
    lettered = docs.select("*", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(added(docs, "lettered")))
    found = [added(docs, "lang_pred"), added(docs, "lang_score")]
    schema = T.StructType([*docs.schema.fields, T.StructField(found[0], T.StringType()), T.StructField(found[1], T.DoubleType())])
    names = np.array([*model.languages, "und"], dtype=object)

    def run(batches):
        for batch in chunks(batches, text):
            best, score = predict(model, *texts_of(batch.column(text)))
            unknown = ~np.array(batch.columns[-1].to_pylist(), dtype=bool)
            if not model.languages:
                unknown[:] = True
            best[unknown], score[unknown] = len(names) - 1, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(score)], names=[*batch.schema.names[:-1], *found])

    return lettered.mapInArrow(run, schema)


def op10_language(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    return identified(docs.select("doc_id", "text"), model).select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
