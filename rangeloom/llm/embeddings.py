"""Embedding near-duplicates by lattice hashing.

In each of ``TABLES`` tables a unit vector is projected at random to 16 dimensions, scaled, and both
halves are decoded to the nearest point of the E8 lattice; the two points are the vector's cell. It is
filed under its own cell, and looks into that and the ``PROBES`` neighbouring cells it lies nearest to
(one half moved by one of E8's 240 shortest vectors). Vectors that meet are compared by exact cosine.
Of pairs of cosine 0.931, 98 of 100 meet (16 to 768 dimensions); of cosine 0.95 and more, over 99.

Only different vectors are hashed: copies (same label, same components) are one class, told apart by a
128-bit hash, and count by their number after, so a vector that fills a third of the table is one row in
the search. Of a cell where at most ``SMALL`` classes meet, the pairs go on as pairs of numbers, each once,
and fetch their vectors. Of a larger cell each class goes on once for every block of ``BLOCK_ROWS`` that it
is compared with; there a pair counts only in the first of the larger cells where it meets, and the cell
gives each class's number of links and as many links as connect it, never its pairs. A pair that meets in
cells of both kinds counts in the larger one.

Defined results: rows with null vec_id, null label, or a vector that is null, empty, zero, or holds a
null or non-finite component link with nothing and are their own component; vectors of very small or large
numbers are compared like any others (by their largest component first); vectors of different
lengths do not link; each row counts as a vector of its own, so rows that repeat a vec_id with one vector
and label are copies, and with others may lie in different components; an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, mixed, table
from .simhash import _connected, components

COSINE = 0.93
TABLES = 10
PROBES = 6
SCALE = 0.65  # lattice units that two vectors at the least cosine lie apart, before projection
#: Classes that meet in a cell whose pairs go on as pairs; classes of a larger cell that a task compares with as many.
SMALL, BLOCK_ROWS = 64, 1024
#: Links that a task works on at a time.
_STRIP = 50_000
_BLOCKS = 2
_SEED = 20


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, by its definition: whole or half coordinates with an even sum, squared length 2."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if sum(s) % 4 == 0]
    return np.array(out)


SHORTEST = _shortest()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points of whole coordinates with an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    if len(odd):
        gap = x[odd] - near[odd]
        worst = np.abs(gap).argmax(axis=1)
        near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of the E8 lattice to the rows of x."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


def _projections(dimensions: int, tables: int) -> np.ndarray:
    return np.random.default_rng((_SEED, dimensions)).standard_normal((tables, _BLOCKS * 8, dimensions))


_FACTORS = mixed(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _cell_hash(points: np.ndarray) -> np.ndarray:
    """64-bit sums of lattice points' doubled coordinates, which are whole, each times a factor of its own; the sum of a moved point is that of the point and of the move."""
    with np.errstate(over="ignore"):
        return (np.rint(points * 2).astype(np.int64).view(np.uint64) * _FACTORS).sum(axis=1, dtype=np.uint64)


_MOVES = _cell_hash(SHORTEST)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, cosine: float = COSINE) -> np.ndarray:
    """Hashes of each unit vector's cells: (rows, tables, 1 + probes), its own first."""
    n, dimensions = unit.shape
    spread = scale / np.sqrt(2 - 2 * cosine)
    out = np.empty((n, tables, 1 + probes), dtype=np.uint64)
    for t, matrix in enumerate(_projections(dimensions, tables)):
        y = unit @ matrix.T * (spread / np.sqrt(8))
        points = [nearest_e8(y[:, 8 * b : 8 * b + 8]) for b in range(_BLOCKS)]
        hashes = [_cell_hash(p) for p in points]
        join = lambda a, b, t=t: mixed(a * np.uint64(31) + mixed(b + np.uint64(t)))
        with np.errstate(over="ignore"):
            out[:, t, 0] = join(*hashes)
            # How much farther each neighbouring cell's point is: |v|^2 / 2 - v . (y - p), for either half.
            farther = np.concatenate([1 - (y[:, 8 * b : 8 * b + 8] - points[b]) @ SHORTEST.T for b in range(_BLOCKS)], axis=1)
            nearest = np.argpartition(farther, probes, axis=1)[:, :probes]
            move = _MOVES[nearest % len(SHORTEST)]
            first = nearest < len(SHORTEST)
            out[:, t, 1:] = join(hashes[0][:, None] + np.where(first, move, np.uint64(0)), hashes[1][:, None] + np.where(first, np.uint64(0), move))
    return out


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, flat, and where each row's begin."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False).astype(np.float64)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _rows(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray, d: int) -> np.ndarray:
    return flat[(offsets[rows][:, None] + np.arange(d)).ravel()].reshape(-1, d)


def keyed(classes: DataFrame) -> DataFrame:
    """``classes`` (with label and embedding) and keys: for each table the key of its own cell, then those of the cells that it looks into."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                own = batch.slice(k, 2000)
                flat, offsets = _matrix(own.column("embedding"))
                sizes, label = np.diff(offsets), own.column("label").to_numpy().view(np.uint64)
                keys = np.empty((own.num_rows, TABLES * (1 + PROBES)), dtype=np.int64)
                for d in np.unique(sizes):
                    rows = np.flatnonzero(sizes == d)
                    x = _rows(flat, offsets, rows, d)
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    found = cells(x / np.linalg.norm(x, axis=1, keepdims=True))
                    with np.errstate(over="ignore"):
                        keys[rows] = mixed(found + mixed(label[rows] * np.uint64(64) + np.uint64(d))[:, None, None]).view(np.int64).reshape(len(rows), -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*own.columns, lists], names=[*own.schema.names, "keys"])

    return classes.mapInArrow(run, T.StructType([*classes.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))]))


def live_cells(classes: DataFrame) -> DataFrame:
    """key, cid, home, n: who meets in each cell that is some class's own and where ``n`` > 1 classes meet.

    Most cells that are looked into are nobody's own; those go first, by a semi-join that keeps one copy of
    each key and sorts nothing.
    """
    members = classes.select("cid", F.posexplode("keys").alias("at", "key")).select("cid", "key", (F.col("at") % (1 + PROBES) == 0).alias("home"))
    own = members.where("home")
    look = members.where("NOT home").join(own.select("key").hint("shuffle_hash"), "key", "left_semi")
    there = checkpointed(own.unionByName(look))
    many = there.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return there.join(many, "key")


def _meet(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For rows of keys of two sides (0: none), the first key under which they meet: by table, then the smaller; 0 if under none."""
    first = np.zeros(len(x), dtype=np.int64)
    todo = np.arange(len(x))
    none = np.iinfo(np.int64).max
    for t in range(0, x.shape[1], 1 + PROBES):
        a, b = x[todo, t : t + 1 + PROBES], y[todo, t : t + 1 + PROBES]
        own = np.where((a[:, 0] != 0) & (b == a[:, :1]).any(axis=1), a[:, 0], none)
        other = np.where((b[:, 0] != 0) & (a == b[:, :1]).any(axis=1), b[:, 0], none)
        least = np.minimum(own, other)
        met = least != none
        first[todo[met]] = least[met]
        todo = todo[~met]
        if not len(todo):
            break
    return first


def _keys(column: pa.Array) -> np.ndarray:
    """The lists of keys as rows; zeros for null."""
    out = np.zeros((len(column), TABLES * (1 + PROBES)), dtype=np.int64)
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if len(there):
        out[there] = column.drop_null().flatten().to_numpy().reshape(len(there), -1)
    return out


#: More than cosines may differ by the order in which they are summed.
_NEARLY = 1e-9


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length one. By the largest component first, whose squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def pair_links(live: DataFrame, wide: DataFrame, least: float) -> DataFrame:
    """a, b, na, nb: the links that are found in small cells and in no larger one, and the copies of either class."""
    small = live.where(F.col("n") <= SMALL)
    home = small.where("home").select("key", F.col("cid").alias("x"))
    met = home.join(small.select("key", F.col("cid").alias("y"), "home"), "key").where("x <> y AND (NOT home OR x < y)")
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4000):
                own = batch.slice(k, 4000)
                (x, ox), (y, oy) = _matrix(own.column("va")), _matrix(own.column("vb"))
                sx, keep = np.diff(ox), np.zeros(own.num_rows, dtype=bool)
                same = sx == np.diff(oy)
                for d in np.unique(sx[same]):
                    rows = np.flatnonzero(same & (sx == d))
                    keep[rows] = np.einsum("ij,ij->i", _units(_rows(x, ox, rows, d)), _units(_rows(y, oy, rows, d))) >= least
                rows = np.flatnonzero(keep)
                if own.column("ka").null_count < own.num_rows:
                    keep[rows] = _meet(_keys(own.column("ka").take(pa.array(rows))), _keys(own.column("kb").take(pa.array(rows)))) == 0
                yield own.select(["a", "b", "na", "nb"]).filter(pa.array(keep))

    of = lambda c: wide.select(F.col("cid").alias(c), F.col("embedding").alias(f"v{c}"), F.col("copies").alias(f"n{c}"), F.col("large").alias(f"k{c}"))
    full = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "va", "vb", "ka", "kb")
    return full.mapInArrow(run, "a bigint, b bigint, na bigint, nb bigint")


def block_links(live: DataFrame, wide: DataFrame, least: float) -> DataFrame:
    """cid, others, top: of each pair of blocks of a large cell, each class's linked copies (of pairs that meet there first) and the smallest class that its links connect it with there."""
    large = live.where(F.col("n") > SMALL).withColumn("parts", F.ceil(F.col("n") / BLOCK_ROWS))
    dealt = large.withColumn("part", F.pmod(F.xxhash64("cid"), "parts")).withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    groups = dealt.select("key", "cid", "home", "part", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("cid").combine_chunks()
        key, i, j = (t.column(c)[0].as_py() for c in ("key", "i", "j"))
        part, cid, copies, home = (t.column(c).to_numpy() for c in ("part", "cid", "copies", "home"))
        keys = _keys(t.column("large").chunk(0))
        flat, offsets = _matrix(t.column("embedding").chunk(0))
        sizes = np.diff(offsets)
        others, found = np.zeros(len(cid), dtype=np.int64), []
        a, b = np.flatnonzero(part == i), np.flatnonzero(part == j)
        for d in np.unique(sizes):
            p, q = a[sizes[a] == d], b[sizes[b] == d]
            x, y = (_units(_rows(flat, offsets, z, d)) for z in (p, q))
            step = max(1, _STRIP // max(len(q), 1))
            for k in range(0, len(p), step):
                cosine = x[k : k + step] @ y.T
                near = cosine >= least - _NEARLY
                near &= home[p[k : k + step]][:, None] | home[q][None]
                if i == j:
                    near &= p[k : k + step][:, None] < q[None]
                r, c = np.nonzero(near)
                # A product of matrices rounds in another way; what is at the bound is decided as in ``pair_links``.
                sure = cosine[r, c] >= least + _NEARLY
                sure[~sure] = np.einsum("ij,ij->i", x[k + r[~sure]], y[c[~sure]]) >= least
                r, c = p[k + r[sure]], q[c[sure]]
                first = _meet(keys[r], keys[c]) == key
                r, c = r[first], c[first]
                others += np.bincount(r, copies[c], len(cid)).astype(np.int64) + np.bincount(c, copies[r], len(cid)).astype(np.int64)
                found.append((r, c))
        top = _connected(len(cid), *(np.concatenate(z) for z in zip(*found, strict=True))) if found else np.arange(len(cid))
        rows = np.flatnonzero(others)
        return pa.table({"cid": pa.array(cid[rows]), "others": pa.array(others[rows]), "top": pa.array(cid[top[rows]])})

    full = groups.join(wide, "cid").select("key", "i", "j", "part", "cid", "home", "copies", "embedding", "large")
    return full.groupBy("key", "i", "j").applyInArrow(run, "cid bigint, others bigint, top bigint")


def near_duplicates(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    x = F.col("embedding")
    sound = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()
        & ~F.coalesce(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))
        & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))
    )
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(sound, F.lit(False)).alias("sound"))
    of = rows.where("sound").select("vec_id", "label", "embedding", F.xxhash64(F.lit(1), "label", "embedding").alias("h"), F.xxhash64(F.lit(2), "embedding", "label").alias("g"))
    classes = of.groupBy("h", "g").agg(F.xxhash64(F.first("label")).alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    classes = checkpointed(keyed(classes.select(F.monotonically_increasing_id().alias("cid"), "*")))
    live = checkpointed(live_cells(classes))
    # Which of a class's keys, in their places, are of large cells.
    held = live.where(F.col("n") > SMALL).groupBy("cid").agg(F.collect_set("key").alias("held"))  # at most as many as a class has keys
    large = F.when(F.col("held").isNotNull(), F.transform("keys", lambda k: F.when(F.array_contains("held", k), k).otherwise(F.lit(0).cast("bigint"))))
    wide = classes.join(held, "cid", "left").select("cid", "embedding", "copies", large.alias("large"))
    links = checkpointed(pair_links(live, wide, least))
    blocks = checkpointed(block_links(live, wide, least))
    degree = links.select(F.col("a").alias("cid"), F.col("nb").alias("others")).unionByName(links.select(F.col("b").alias("cid"), F.col("na").alias("others"))).unionByName(blocks.select("cid", "others"))
    degree = degree.groupBy("cid").agg(F.sum("others").alias("others"))
    top = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(blocks.select(F.col("cid").alias("u"), F.col("top").alias("v"))))
    named = classes.select("cid", "h", "g", "least_id", "copies").join(top.select(F.col("u").alias("cid"), F.col("v").alias("top")), "cid", "left").withColumn("top", F.coalesce("top", "cid"))
    smallest = named.groupBy("top").agg(F.min("least_id").alias("component_id"))
    known = named.join(smallest, "top").join(degree, "cid", "left").select("h", "g", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = of.select("vec_id", "h", "g").join(known, ["h", "g"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_embeddings(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: By brute force over all pairs of a label.
OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, len(embedding) AS d FROM embeddings),
n AS MATERIALIZED (
  SELECT *, list_sum(list_transform(e, lambda x: x * x)) AS s FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND d > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.d = b.d AND a.vec_id <> b.vec_id
  WHERE a.s > 0 AND b.s > 0 AND list_sum(list_transform(range(1, a.d + 1), lambda i: a.e[i] * b.e[i])) / sqrt(a.s * b.s) >= 0.93),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
l AS (SELECT a, count(*) AS links FROM p GROUP BY a)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM v LEFT JOIN c ON vec_id = c.a LEFT JOIN l ON vec_id = l.a
"""


def planted(vectors: DataFrame) -> DataFrame:
    """Each vector and two others turned away from it (every second component times 1.2, and times 1.44), of cosines about 0.996 and 0.984."""
    turned = lambda by: F.transform(F.col("embedding").cast("array<double>"), lambda x, k: F.when(k % 2 == 0, x * by).otherwise(x))
    forms = F.array(*[F.struct(F.lit(k).alias("k"), turned(by).alias("e")) for k, by in enumerate((1.0, 1.2, 1.44))])
    return vectors.select("vec_id", "label", F.explode(forms).alias("f")).select((F.col("vec_id") * 3 + F.col("f.k")).alias("vec_id"), "label", F.col("f.e").alias("embedding"))


def planted_embeddings(spark, sf_dir) -> DataFrame:
    """The operator where there are links: over vectors derived from the table's."""
    return near_duplicates(planted(table(spark, sf_dir, "embeddings")))


PLANTED_SQL = OP9_SQL.replace(
    "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, len(embedding) AS d FROM embeddings",
    "SELECT vec_id * 3 + k AS vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: CASE WHEN i % 2 = 1 THEN x * f ELSE x END) AS e, len(embedding) AS d FROM embeddings, (VALUES (0, 1.0::DOUBLE), (1, 1.2::DOUBLE), (2, 1.44::DOUBLE)) forms(k, f)",
)
