"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source, in the order of a hash of their ids and texts, make one stream of words, which
is cut into blocks of ``block_words`` words (the last may be shorter). A pass over the source is a keyed
permutation of its block numbers; the second pass (for targets above the source's size) has another key and
follows the first. The first so many blocks of these passes that reach the target, rounded to a whole word,
are drawn, the last of them cut where the target ends. So the drawn blocks of a pass are disjoint, a
source's words add up to its target, and no word is taken more than twice.

A tree splits the block quotas of all sources among the output shards: each node deals the blocks of its
shards to its two halves by one multivariate-hypergeometric draw, so each leaf has exact quotas and the
leaves' quotas add up to the sources'. The places that the permutation gives to the drawn blocks are dealt
to the shards by these quotas; within a shard blocks come in the order of another keyed hash.

``mix`` tells for each document which of its words are drawn, and for which shard. ``mixed_documents``
returns the documents in the order of shards and of each shard: a run of neighbouring drawn words of one
pass is one row, in the shard where its first block is, so that documents stay whole where they can.

Defined results: a null text counts as empty; a document of no words takes nothing; documents of null
source make a source of their own, last in order; rows that repeat an id and a text stand side by side in
the stream, in any order; an empty table gives an empty mix. Other columns are ignored or, by
``mixed_documents``, carried along, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import added, checkpointed, mixed, stored, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_WORDS = 4096
#: Words of a shard, where the caller names no number of shards; and the numbers that a plan may hold (sources times shards).
SHARD_WORDS, PLAN_NUMBERS = 1 << 26, 1 << 22
LEAST_SHARDS = 16
#: Words of a shard's order that a task puts out.
TASK_WORDS = 1 << 22
BUCKET_BITS = 12
#: The plan of the sources goes to every task, so there may be so many.
MOST_SOURCES = 100_000
#: Blocks that one draw of the tree may be of, by numpy's limit; more are dealt by several trees.
TREE_BLOCKS = 1 << 29
#: The rounds of the permutation: a multiplier, a prime and the bits dropped.
_TIMES, _PRIME, _DROPPED = 668_265_263, (1 << 61) - 1, 20
_WORD = r"[^\x20\x09-\x0D]+"
_PIECE = "array<struct<shard:int,slot:bigint,rank:bigint,epoch:int,first:bigint,past:bigint>>"


@dataclass
class Plan:
    """For each source, in order: words in it, target, words to take, blocks of a pass, blocks drawn, words of the last one drawn, where each shard's places end, and the keys of its passes."""

    names: list
    sizes: np.ndarray
    targets: np.ndarray
    quotas: np.ndarray
    blocks: np.ndarray
    drawn: np.ndarray
    last: np.ndarray
    ends: np.ndarray
    keys: list
    block_words: int

    @property
    def shards(self) -> int:
        return self.ends.shape[1]


def targets_of(sizes: np.ndarray, weights=WEIGHTS, share: float = SHARE, repeats: int = MOST_REPEATS) -> np.ndarray:
    """Words to take of each source: by weight, none above ``repeats`` times its size; the excess goes to the others by weight until none is above."""
    n = len(sizes)
    w = np.resize(np.array(weights, dtype=np.float64), n)
    caps = repeats * sizes.astype(np.float64)
    total = share * float(sizes.sum())
    order = np.argsort(caps / w, kind="stable")
    level = caps[order] / w[order]
    capped = np.cumsum(caps[order])
    rest = np.cumsum(w[order][::-1])[::-1]
    full = capped + level * (rest - w[order]) <= total
    taken, left = caps[order][full].sum(), w[order][~full].sum()
    out = caps.copy()
    if left:
        out[order[~full]] = w[order[~full]] * ((total - taken) / left)
    return out


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Each source's blocks in each shard: (sources, shards), rows adding up to ``quotas``, columns equal to within one (a tree)."""
    out = np.zeros((len(quotas), shards), dtype=np.int64)
    trees = max(1, -(-int(quotas.sum()) // TREE_BLOCKS)) if len(quotas) else 0
    for tree in range(trees):
        rng = np.random.default_rng((seed, tree))

        def split(have: np.ndarray, first: int, past: int, rng=rng) -> None:
            if past - first == 1:
                out[:, first] += have
                return
            middle = (first + past) // 2
            draws = int(have.sum()) * (middle - first) // (past - first)
            left = rng.multivariate_hypergeometric(have, draws, method="marginals")
            split(have - left, middle, past)
            split(left, first, middle)

        share = quotas.astype(np.int64)
        split(share * (tree + 1) // trees - share * tree // trees if trees > 1 else share, 0, shards)
    return out


def pass_keys(seed: int, source: int, epoch: int) -> list[int]:
    """The four numbers that key the permutation of a source's blocks in a pass."""
    return [int(hashlib.md5(f"{seed}/{source}/{epoch}/{r}".encode()).hexdigest()[:8], 16) for r in range(4)]


def permuted(x: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1: four Feistel rounds, walked until the value is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    out = np.array(x, dtype=np.int64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (((right + k) * _TIMES % _PRIME >> _DROPPED) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out


def draw(words: int, size: int, blocks: int, block_words: int, keys: list[list[int]]) -> tuple[int, int]:
    """How many blocks of a source's passes hold ``words`` words, and how many words of the last of them."""
    if not words:
        return 0, 0
    lacks = blocks * block_words - size
    short = sorted(e * blocks + int(permuted(np.array([blocks - 1]), blocks, k)[0]) for e, k in enumerate(keys))
    for passed in range(len(short) + 1):
        n = -(-(words + passed * lacks) // block_words)
        # The short blocks among the first n.
        if sum(p < n for p in short) <= passed:
            held = n * block_words - sum(p < n for p in short) * lacks
            of = block_words - (lacks if n - 1 in short else 0)
            return n, words - (held - of)
    raise AssertionError("a target is above its source's passes")


def sized(docs: DataFrame, number: str | None = None) -> DataFrame:
    """rid (the column ``number``, if there is one), doc_id, size in words, the source as a key that is never null, and the place in the order of a hash; one row per row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary")))
    rows = docs.select(
        (F.monotonically_increasing_id() if number is None else F.col(number)).alias("rid"),
        "doc_id",
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.regexp_count(text, F.lit(_WORD)).cast("bigint").alias("size"),
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("="), F.col("source"))).alias("source"),
        F.conv(F.substring(F.md5(own.cast("binary")), 1, 15), 16, 10).cast("bigint").alias("key"),
    )
    return rows.withColumn("bucket", F.shiftright("key", 60 - BUCKET_BITS).cast("int")).withColumn("part", F.shiftright("rid", 33))


def plan_of(bucket_sizes: DataFrame, shards: int | None, block_words: int, seed: int) -> Plan:
    """The plan from the (source, bucket) sizes; only one row for each source comes to the driver."""
    rows = bucket_sizes.groupBy("source").agg(F.sum("words").alias("words")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them first")
    rows = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] == "n", r[0].encode()))
    sizes = np.array([r[1] for r in rows], dtype=np.int64)
    targets = targets_of(sizes) if len(rows) else np.zeros(0)
    quotas = np.floor(targets + 0.5).astype(np.int64)
    if shards is None:
        shards = max(LEAST_SHARDS, min(-(-int(quotas.sum()) // SHARD_WORDS), PLAN_NUMBERS // max(len(rows), 1)))
    blocks = -(-sizes // block_words)
    keys = [[pass_keys(seed, s, e) for e in range(MOST_REPEATS)] for s in range(len(rows))]
    drawn = np.array([draw(int(q), int(n), int(b), block_words, k) for q, n, b, k in zip(quotas, sizes, blocks, keys, strict=True)], dtype=np.int64).reshape(-1, 2)
    ends = np.cumsum(split_tree(drawn[:, 0], shards, seed), axis=1)
    return Plan([r[0] for r in rows], sizes, targets, quotas, blocks, drawn[:, 0], drawn[:, 1], ends, keys, block_words)


def placed(docs: DataFrame, shards: int | None = None, block_words: int = BLOCK_WORDS, seed: int = 7, number: str | None = None) -> tuple[DataFrame, Plan]:
    """rid, doc_id, source, size and start (the words before it in its source's stream) of each row, and the plan.

    A source's stream is ordered in 2 ** BUCKET_BITS buckets of the hash, so that no task ever holds a
    whole source. Equal rows, however many, are counted first, by the partition they were read in; each
    row then finds its place from its number among the equal ones of its partition.
    """
    rows = checkpointed(sized(docs, number))  # the texts are read once
    same = ["source", "bucket", "key", "id", "size", "part"]
    groups = checkpointed(rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n")))
    by_bucket = groups.groupBy("source", "bucket").agg(F.sum(F.col("n") * F.col("size")).alias("words"))
    plan = plan_of(by_bucket, shards, block_words, seed)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = by_bucket.select("source", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "id", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    begun = groups.join(base, ["source", "bucket"]).select(*same, (F.col("base") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(within), F.lit(0))).alias("begin"))
    number = F.row_number().over(Window.partitionBy(*same).orderBy("rid")) - 1
    return rows.join(begun, same).select("rid", "doc_id", "source", "size", (F.col("begin") + number * F.col("size")).alias("start")), plan


def _pieces(source: np.ndarray, start: np.ndarray, size: np.ndarray, plan: Plan):
    """For rows of given source number, start and size: row, shard, slot, rank, epoch, first and past word of each piece, by row, epoch and word."""
    rows = np.flatnonzero(size > 0)
    b0, b1 = start[rows] // plan.block_words, (start[rows] + size[rows] - 1) // plan.block_words
    n = b1 - b0 + 1
    row = np.repeat(rows, n)
    block = np.repeat(b0, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    found = []
    for s in np.unique(source[rows]):
        own = np.flatnonzero(source[row] == s)
        different, at = np.unique(block[own], return_inverse=True)
        for epoch in range(MOST_REPEATS):
            slot = (epoch * plan.blocks[s] + permuted(different, int(plan.blocks[s]), plan.keys[s][epoch]))[at]
            on = slot < plan.drawn[s]
            r, b, t = row[own[on]], block[own[on]], slot[on]
            begin = b * plan.block_words
            end = np.minimum(begin + np.where(t == plan.drawn[s] - 1, plan.last[s], plan.block_words), plan.sizes[s])
            first, past = np.maximum(begin - start[r], 0), np.minimum(end - start[r], size[r])
            some = past > first
            shard = np.searchsorted(plan.ends[s], t[some], side="right")
            found.append((r[some], shard, t[some], np.full(some.sum(), epoch), first[some], past[some]))
    if not found:
        return [np.zeros(0, dtype=np.int64)] * 7
    row, shard, slot, epoch, first, past = (np.concatenate(x) for x in zip(*found, strict=True))
    with np.errstate(over="ignore"):
        rank = (mixed(mixed(slot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + source[row].astype(np.uint64))) >> np.uint64(1)).astype(np.int64)
    order = np.lexsort((first, epoch, row))
    return [x[order] for x in (row, shard, slot, rank, epoch, first, past)]


def mix(docs: DataFrame, shards: int | None = None, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, pieces.

    ``pieces`` tells each run of its words that the mix takes: the shard, the block's place among the
    drawn ones of its source, its rank in the shard's order, the epoch, and the first and past-the-last word.
    """
    rows, plan = placed(docs, shards, block_words, seed)
    numbers = {name: k for k, name in enumerate(plan.names)}
    fields = pa.struct([("shard", pa.int32()), ("slot", pa.int64()), ("rank", pa.int64()), ("epoch", pa.int32()), ("first", pa.int64()), ("past", pa.int64())])

    def run(batches):
        for batch in batches:
            source = np.array([numbers[x] for x in batch.column("source").to_pylist()], dtype=np.int64)
            size = batch.column("size").to_numpy()
            row, shard, slot, rank, epoch, first, past = _pieces(source, batch.column("start").to_numpy(), size, plan)
            values = pa.StructArray.from_arrays([pa.array(shard, pa.int32()), pa.array(slot), pa.array(rank), pa.array(epoch, pa.int32()), pa.array(first), pa.array(past)], fields=list(fields))
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("size"), pa.array(plan.sizes[source]), pa.array(plan.targets[source]), pa.ListArray.from_arrays(offsets, values)],
                names=["doc_id", "size", "source_size", "target", "pieces"],
            )

    return rows.select("doc_id", "source", "size", "start").mapInArrow(run, f"doc_id bigint, size bigint, source_size bigint, target double, pieces {_PIECE}")


def shard_rows(mix_rows: DataFrame) -> DataFrame:
    """The pieces of a mix, one row each, dealt to their shards and in each shard's order."""
    pieces = mix_rows.select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.*")
    return pieces.repartition("shard").sortWithinPartitions("shard", "rank", "slot", "doc_id", "epoch", "first")


def cut_words(text: str, first: int, past: int, size: int) -> str:
    """The text from its word ``first`` (from 0) to before its word ``past``; of its ``size`` words, with what stands before the first and after the last."""
    import re

    begin, end = 0, len(text)
    for k, m in enumerate(re.finditer(_WORD, text)):
        if k == first and first:
            begin = m.start()
        if k == past - 1:
            end = m.end() if past < size else end
            break
    return text[begin:end]


def mixed_documents(docs: DataFrame, shards: int | None = None, seed: int = 7) -> DataFrame:
    """The documents that the mix takes, with the columns of ``docs``, by shard and in each shard's order: one row for each run of neighbouring words taken in one pass, cut to it.

    The rows are numbered once, in a table written for it, so that it does not matter in which splits or order they are
    read later. Numbers alone are placed; the texts then meet their places on the row's number, and cross one more
    shuffle to their shards. A shard is put out by as many tasks as its words ask for, each a range of its order.
    """
    number = added(docs, "rid")
    held = stored(docs.withColumn(number, F.monotonically_increasing_id()))
    rows, plan = placed(held.select(number, "doc_id", "text", "source"), shards, seed=seed, number=number)
    numbers = {name: k for k, name in enumerate(plan.names)}
    tasks = 1 << max(0, (-(-int(plan.quotas.sum()) // (plan.shards * TASK_WORDS)) - 1).bit_length())
    schema = T.StructType([T.StructField("row", docs.schema), *(T.StructField(c, T.LongType()) for c in ("task", "rank", "slot", "at"))])

    def run(batches):
        for batch in batches:
            source = np.array([numbers[x] for x in batch.column("source").to_pylist()], dtype=np.int64)
            size = batch.column("size").to_numpy()
            row, shard, slot, rank, epoch, first, past = _pieces(source, batch.column("start").to_numpy(), size, plan)
            if not len(row):
                continue
            # Neighbouring pieces of a row and an epoch are one run.
            new = np.ones(len(row), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (epoch[1:] != epoch[:-1]) | (first[1:] != past[:-1])
            head = np.flatnonzero(new)
            row, past = row[head], past[np.append(head[1:], len(new)) - 1]
            shard, slot, rank, first = shard[head], slot[head], rank[head], first[head]
            task = shard * tasks + (rank >> (63 - (tasks.bit_length() - 1)))
            # A few rows at a time, since a row may be there twice.
            for a in range(0, len(row), 1000):
                own = slice(a, a + 1000)
                taken = batch.column("row").take(pa.array(row[own]))
                parts = dict(zip([f.name for f in taken.type], taken.flatten(), strict=True))
                partial = np.flatnonzero((first[own] > 0) | (past[own] < size[row[own]]))
                if len(partial):
                    texts = parts["text"].take(pa.array(partial)).to_pylist()
                    cut = [cut_words(t, int(first[own][k]), int(past[own][k]), int(size[row[own]][k])) for t, k in zip(texts, partial, strict=True)]
                    mask = np.zeros(len(taken), dtype=bool)
                    mask[partial] = True
                    parts["text"] = pc.replace_with_mask(parts["text"], pa.array(mask), pa.array(cut, parts["text"].type))
                    if "n_chars" in parts and pa.types.is_integer(parts["n_chars"].type):
                        parts["n_chars"] = pc.replace_with_mask(parts["n_chars"], pa.array(mask), pa.array([len(t) for t in cut], parts["n_chars"].type))
                    taken = pa.StructArray.from_arrays(list(parts.values()), fields=list(taken.type))
                yield pa.RecordBatch.from_arrays([taken, *(pa.array(x[own]) for x in (task, rank, slot, first))], names=["row", "task", "rank", "slot", "at"])

    wide = held.select(F.col(number).alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    met = wide.join(rows.where("size > 0").select("rid", "source", "size", "start"), "rid").select("row", "source", "size", "start")
    found = met.mapInArrow(run, schema).repartitionById(max(1, plan.shards * tasks), F.col("task").cast("int"))
    return found.sortWithinPartitions("task", "rank", "slot", "row.doc_id", "at").select("row.*")


def op2_mixing(spark, sf_dir) -> DataFrame:
    mixes = mix(table(spark, sf_dir, "documents"))
    taken = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda a, p: a + p["past"] - p["first"])
    return mixes.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


#: By arithmetic of its own for what is drawn: words are summed over the blocks in the order of their places.
OP2_SQL = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::DOUBLE AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM sized GROUP BY source),
weighted AS (
  SELECT *, (CASE n % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w, 2.0::DOUBLE * words AS cap, 1.5::DOUBLE * sum(words) OVER () AS total FROM sources),
levels AS (
  SELECT *, sum(cap) OVER (ORDER BY cap / w, n ROWS UNBOUNDED PRECEDING) + cap / w * coalesce(sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) <= total AS is_full FROM weighted),
rest AS (
  SELECT (max(total) - coalesce(sum(cap) FILTER (WHERE is_full), 0)) / sum(w) FILTER (WHERE NOT is_full) AS level FROM levels),
targets AS (
  SELECT *, floor(target + 0.5)::BIGINT AS quota, (source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS blocks
  FROM (SELECT source, n, words::BIGINT AS source_size, CASE WHEN is_full THEN cap ELSE w * level END AS target FROM levels, rest)),
passes AS (
  SELECT n, blocks, e, greatest(1, (length(bin(greatest(blocks - 1, 1))) + 1) // 2)::BIGINT AS half,
         {", ".join(f"CAST('0x' || substr(md5('7/' || n || '/' || e || '/{r}'), 1, 8) AS BIGINT) AS k{r}" for r in range(4))}
  FROM targets, range({MOST_REPEATS}) p(e)),
walk AS (
  SELECT n, e, b, b AS x, 0 AS steps FROM passes, LATERAL (SELECT unnest(range(blocks)) AS b)
  UNION ALL
  SELECT n, e, b, (r3 << half) | r4, steps + 1 FROM (
    SELECT *, xor(r2, (((r3 + k3) * {_TIMES} % {_PRIME}) >> {_DROPPED}) & mask) AS r4 FROM (
      SELECT *, xor(r1, (((r2 + k2) * {_TIMES} % {_PRIME}) >> {_DROPPED}) & mask) AS r3 FROM (
        SELECT *, xor(r0, (((r1 + k1) * {_TIMES} % {_PRIME}) >> {_DROPPED}) & mask) AS r2 FROM (
          SELECT *, xor(x >> half, (((r0 + k0) * {_TIMES} % {_PRIME}) >> {_DROPPED}) & mask) AS r1 FROM (
            SELECT w.*, p.* EXCLUDE (n, e), (1::BIGINT << half) - 1 AS mask, x & ((1::BIGINT << half) - 1) AS r0
            FROM walk w JOIN passes p USING (n, e) WHERE steps = 0 OR x >= blocks)))))),
blocks AS (
  SELECT w.n, e, b, e * t.blocks + x AS slot, least({BLOCK_WORDS}, source_size - b * {BLOCK_WORDS}) AS held, quota
  FROM walk w JOIN targets t USING (n) WHERE steps > 0 AND x < t.blocks),
drawn AS (
  SELECT n, b, greatest(0, least(held, quota - coalesce(sum(held) OVER (PARTITION BY n ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS words FROM blocks),
placed AS (
  SELECT s.doc_id, s.size, t.n, t.source_size, t.target, row_number() OVER () AS r,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT r, sum(greatest(0, least(start + size, b * {BLOCK_WORDS} + words) - greatest(start, b * {BLOCK_WORDS}))) AS words
  FROM placed p JOIN drawn d ON p.n = d.n AND d.b BETWEEN p.start // {BLOCK_WORDS} AND (p.start + p.size - 1) // {BLOCK_WORDS} WHERE p.size > 0 GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken.words, 0)::BIGINT AS taken FROM placed LEFT JOIN taken USING (r)
"""
