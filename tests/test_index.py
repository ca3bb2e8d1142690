"""The interval index on made-up vectors: ranges at their edges, ties, few vectors; and maintenance."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rangeloom.operators import dyadic, exact, interval_index, keys, layers, metrics, nndescent, rectangles, search, store
from rangeloom.plans import sql
from rangeloom.streaming.append import Maintainer

K = 3


def frame(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "pos bigint, embedding array<float>")


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(0).integers(0, 5, (60, 4))  # few values: many equal distances, and copies
    return x, frame(spark, x)


@pytest.fixture(scope="module")
def index(spark, vectors):
    rows = interval_index.build(vectors[1], K, rows=16).toPandas()
    return spark.createDataFrame(rows, interval_index.SCHEMA).cache(), rows


def brute(x, low, high, k=K):
    out = set()
    for a in range(low, high + 1):
        near = sorted((float(((x[a] - x[b]) ** 2).sum()), b) for b in range(low, high + 1) if b != a)
        out |= {(a, b, r) for r, (_, b) in enumerate(near[:k], 1)}
    return out


def triples(df):
    return {(r.node, r.nbr, r.rank) for r in df.collect()}


def test_forms_agree(vectors, index):
    by_windows = interval_index.build_by_windows(vectors[1], K).toPandas()
    key = ["node", "side", "nbr", "sub"]
    assert sorted(map(tuple, by_windows[key].values)) == sorted(map(tuple, index[1][key].values))


def test_blocks_do_not_matter(vectors, index):
    key = ["node", "side", "nbr", "sub"]
    other = interval_index.build(vectors[1], K, rows=7).toPandas()
    assert sorted(map(tuple, other[key].values)) == sorted(map(tuple, index[1][key].values))


@pytest.mark.parametrize(("low", "high"), [(0, 59), (0, 0), (7, 9), (58, 59), (10, 40), (0, 3)])
def test_ranges(vectors, index, low, high):
    want = brute(vectors[0], low, high)
    assert triples(interval_index.graph(index[0], K, low, high)) == want
    assert triples(interval_index.replayed_graph(interval_index.raw(index[0]), K, low, high)) == want
    assert triples(exact.graph(vectors[1], K, low, high, rows=16)) == want


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 59), st.integers(0, 59))
def test_any_range(vectors, index, a, b):
    low, high = min(a, b), max(a, b)
    rows = index[1]
    rows = rows[(rows.node >= low) & (rows.node <= high)]
    held = rows[((rows.side == "L") & (rows["sub"] < low) & (rows.nbr >= low)) | ((rows.side == "R") & (rows["sub"] > high) & (rows.nbr <= high))]
    assert held.groupby(["node", "side"]).size().max() <= K if len(held) else True
    got = set()
    for node, g in held.sort_values(["dist", "nbr"]).groupby("node"):
        got |= {(node, n, r) for r, n in enumerate(g.nbr.head(K), 1)}
    assert got == brute(vectors[0], low, high)


def test_rectangles(vectors):
    table = rectangles.build(vectors[1], K).cache()
    for low, high in ((0, 59), (5, 20), (57, 59)):
        want = {}
        for a, b, _ in brute(vectors[0], low, high):
            want.setdefault(a, set()).add(b)
        got = {}
        for r in rectangles.lookup(table, low, high).collect():
            assert r.node not in got  # one window for each node
            got[r.node] = set(r.pts)
        assert got == {a: s for a, s in want.items() if high - low >= K}


def rows_of(df):
    return sorted((r.node, r.side, r.nbr, r["sub"]) for r in df.collect())


@pytest.mark.parametrize("sizes", [(1, 1), (7, 12)])
def test_append_equals_rebuild(spark, vectors, sizes):
    x, v = vectors
    index, n = interval_index.build(v.where("pos < 20"), K), 20
    for m in sizes:
        index = spark.createDataFrame(interval_index.append(index, v.where(F.col("pos") < n), v.where(F.col("pos").between(n, n + m - 1)), K).toPandas(), interval_index.SCHEMA)
        n += m
    assert rows_of(index) == rows_of(interval_index.build(v.where(F.col("pos") < n), K))


def test_repair_equals_rebuild(spark, vectors, index):
    x, v = vectors
    changed, gone = [3, 30, 31, 59], [0, 12, 44]
    now = v.where(~F.col("pos").isin(gone)).withColumn("embedding", F.when(F.col("pos").isin(changed), F.reverse("embedding")).otherwise(F.col("embedding")))
    got = interval_index.repair(index[0], now, spark.createDataFrame([(p,) for p in changed + gone], "pos bigint"), K)
    assert rows_of(got) == rows_of(interval_index.build(now, K))


@pytest.mark.parametrize("name", ["ip", "cosine", "l2"])
def test_metrics_of_choice(vectors, name):
    x, v = vectors
    low, high = 10, 40
    x = x.astype(float)
    size = np.sqrt((x**2).sum(axis=1))
    dots = x @ x.T
    d = {"ip": 1 - dots, "cosine": 1 - np.divide(dots, size[:, None] * size, out=np.zeros_like(dots), where=size[:, None] * size > 0), "l2": np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))}[name]
    want = {(a, r): d[a, b] for a in range(low, high + 1) for r, b in enumerate(sorted((b for b in range(low, high + 1) if b != a), key=lambda b: (d[a, b], b))[:K], 1)}
    for g in (interval_index.graph(interval_index.build(v, K, name=name), K, low, high), exact.graph(v, K, low, high, name=name)):
        got = {(r.node, r.rank): r.dist for r in g.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)  # ties may fall either way by rounding
    graph, _ = nndescent.build(v, nndescent.Params(k=K, keep=3 * K, rounds=8, name=name))
    best = {(r.node, r.rank): r.dist for r in exact.graph(v, K, name=name).collect()}
    near = {(r.node, r.rank): r.dist for r in nndescent.truncated(graph, K).collect()}
    assert np.mean([abs(near[k] - best[k]) < 1e-9 for k in best]) > 0.9


BAD = [None, [], [1.0, None, 0.0, 0.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0]]


def test_vectors_that_cannot_be_compared(spark, vectors):
    """Nulls, empty ones, null and non-finite components keep their positions, and are in no result; several lengths are refused."""
    x, v = vectors
    rows = [(k, [float(a) for a in row]) for k, row in enumerate(x[:30])]
    mixed = spark.createDataFrame([r for k, r in enumerate(rows) if k % 6] + [(6 * k, b) for k, b in enumerate(BAD)], "pos bigint, embedding array<float>")
    sound = spark.createDataFrame([r for k, r in enumerate(rows) if k % 6], "pos bigint, embedding array<float>")
    assert rows_of(interval_index.build(mixed, K)) == rows_of(interval_index.build(sound, K)) == rows_of(interval_index.build_by_windows(mixed, K))
    assert triples(exact.graph(mixed, K)) == triples(exact.graph(sound, K))
    assert triples(exact.graph(mixed, K, nodes=mixed.where("pos < 9"))) == triples(exact.graph(sound, K, nodes=sound.where("pos < 9")))
    assert [r.pos for r in exact.query(mixed, rows[1][1], 5).collect()] == [r.pos for r in exact.query(sound, rows[1][1], 5).collect()]
    assert rows_of(interval_index.build_near(mixed, nndescent.with_reverse(nndescent.hashed_graph(mixed, 2 * K)), K)) == rows_of(interval_index.build(sound, K))
    edges = exact.graph(sound, 2 * K)
    assert triples(nndescent.diverse(edges, mixed, K)) == triples(nndescent.diverse(edges, sound, K))
    assert triples(exact.rerank(edges, mixed, K)) == triples(exact.rerank(edges, sound, K))
    assert {r.node for r in nndescent.build(mixed, nndescent.Params(k=K, keep=9, rounds=3))[0].collect()} <= {r[0] for r in rows if r[0] % 6}
    assert {r.node for r in nndescent.hashed_graph(mixed, K).collect()} == {r[0] for r in rows if r[0] % 6}
    assert [r.pos for r in search.graph_search(edges, mixed, rows[1][1], 5).collect()] == [r.pos for r in exact.query(sound, rows[1][1], 5).collect()]
    pq = search.ProductQuantizer(parts=2, centres=8).fit(mixed)
    assert {r.pos for r in pq.encode(mixed).collect()} == {r[0] for r in rows if r[0] % 6}
    assert rectangles.build(mixed, K).count() == rectangles.build(sound, K).count()
    none = mixed.where("pos % 6 = 0")
    for empty in (exact.graph(none, K), interval_index.build(none, K), exact.query(none, rows[1][1], 5), nndescent.hashed_graph(none, K), nndescent.build(none)[0], layers.build(none), rectangles.build(none, K)):
        assert empty.count() == 0
    for ragged in ([(0, [1.0, 2.0]), (1, [1.0])], [(0, [1.0, 2.0, 3.0]), (1, [1.0])]):
        with pytest.raises(Exception, match="length"):
            exact.graph(spark.createDataFrame(ragged, "pos bigint, embedding array<float>"), K).collect()


def test_a_range_far_from_zero(spark, vectors):
    """Positions beyond 32 bits, with gaps: nothing depends on where they begin."""
    x, v = vectors
    base = 5 * 10**9
    far = v.select((F.col("pos") * 3 + base).alias("pos"), "embedding")
    assert triples(exact.graph(far, K)) == {((a * 3) + base, (b * 3) + base, r) for a, b, r in brute(x, 0, 59)}
    index = interval_index.build(far, K)
    assert triples(interval_index.graph(index, K, base + 30, base + 120)) == {((a * 3) + base, (b * 3) + base, r) for a, b, r in brute(x, 10, 40)}
    graph, _ = nndescent.build(far, nndescent.Params(k=K, keep=9, rounds=8))
    want = {(r.node, r.rank): r.dist for r in exact.graph(far, K).collect()}
    got = {(r.node, r.rank): r.dist for r in nndescent.truncated(graph, K).collect()}
    assert np.mean([got.get(k) == d for k, d in want.items()]) > 0.9


def test_pruning_by_the_pruned_graph(spark):
    """Edge by edge in order of rank and node: one goes if two that were kept lead the same way."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((120, 3))
    graph = exact.graph(frame(spark, x), 9)
    edges = sorted((r.rank, r.node, r.nbr) for r in graph.collect())
    kept: dict[int, set[int]] = {}
    for _, node, nbr in edges:
        if not any(nbr in kept.get(m, ()) for m in kept.get(node, ())):
            kept.setdefault(node, set()).add(nbr)
    assert {(r.node, r.nbr) for r in nndescent.without_detours(graph).collect()} == {(a, b) for a, s in kept.items() for b in s}


def test_pages(vectors):
    x, v = vectors
    point = [float(a) for a in x[5]]
    pages = [[(r.pos, r.rank) for r in p.orderBy("rank").collect()] for p in exact.pages(v, point, 7, 3, 30)]
    assert [len(p) for p in pages] == [7, 7, 7, 7]
    assert [r for p in pages for r in p] == [(r.pos, r.rank) for r in exact.query(v, point, 99, 3, 30).collect()]


def degrees_hold(graph, m):
    per = {(r.level, r.node): r["count"] for r in graph.groupBy("level", "node").count().collect()}
    assert all(n <= m * (1 if level else 2) for (level, _), n in per.items())
    assert graph.groupBy("level", "node", "nbr").count().where("count > 1").count() == 0
    return per


def layer_recall(spark, graph, x, gone=frozenset(), k=10, **more):
    """Of the true neighbours of points near all vectors, the share that the search finds; nothing that is gone may be."""
    v = frame(spark, x).where(~F.col("pos").isin([int(g) for g in gone]) if gone and "dead" not in more else F.lit(True))
    points = x * 0.95 + 0.02
    queries = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "qid bigint, embedding array<double>")
    found = {}
    for r in layers.search_many(graph, v, queries, k, **more).collect():
        found.setdefault(r.qid, set()).add(r.pos)
    hits = 0
    for i, p in enumerate(points):
        d = ((x - p) ** 2).sum(axis=1)
        d[list(gone)] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:k].tolist()) & found[i])
        assert not found[i] & set(gone)
    return hits / (len(points) * k)


def test_layers(spark):
    """Grown in batches, inserted into, searched with deleted nodes and ranges, repaired."""
    x = np.random.default_rng(3).standard_normal((220, 6))
    v = frame(spark, x)
    p = layers.Layers(m=8, candidates=24, first=160)
    graph = layers.insert(layers.build(v.where("pos < 150"), p), v.where("pos < 150"), v.where("pos >= 150"), p)
    per = degrees_hold(graph, p.m)
    assert {level for level, _ in per} >= {0, 1} and {node for level, node in per if level == 0} == set(range(220))
    tops = {r.pos: r.top for r in layers.tops(v, p).collect()}
    assert all(level <= tops[node] for level, node in per)
    assert layer_recall(spark, graph, x) >= 0.95
    gone = set(range(0, 220, 3))
    assert layer_recall(spark, graph, x, gone, dead=spark.createDataFrame([(g,) for g in gone], "pos bigint")) >= 0.95
    # Some vectors change, others go.
    changed, away = set(range(5, 220, 20)), set(range(10, 220, 25))
    y = x.copy()
    y[list(changed)] = -x[list(changed)]
    now = frame(spark, y).where(~F.col("pos").isin([int(a) for a in away]))
    fixed = layers.repair(graph, now, spark.createDataFrame([(c,) for c in changed | away], "pos bigint"), p)
    degrees_hold(fixed, p.m)
    assert fixed.where(F.col("node").isin([int(a) for a in away]) | F.col("nbr").isin([int(a) for a in away])).count() == 0
    stale = fixed.join(now.select(F.col("pos").alias("node"), F.col("embedding").alias("a")), "node").join(now.select(F.col("pos").alias("nbr"), F.col("embedding").alias("b")), "nbr")
    assert all(abs(sum((p - q) ** 2 for p, q in zip(r.a, r.b, strict=True)) - r.dist) < 1e-3 for r in stale.collect())
    assert layer_recall(spark, fixed, y, away) >= 0.95


def test_searches_many_at_once(spark):
    """The same results as one by one; trials, the largest distance, starts for each query, and rows a hop."""
    x = np.random.default_rng(4).standard_normal((200, 5))
    v = frame(spark, x).cache()
    graph = nndescent.with_reverse(exact.graph(v, 5)).cache()
    queries = spark.createDataFrame([(q * 10, (x[q] * 0.9).tolist()) for q in range(0, 200, 9)], "qid bigint, embedding array<double>")
    info = []
    found = search.graph_search_many(graph, v, queries, 5, search.Search(starts=4, trials=2, width=30), info=info).collect()
    want = {q * 10: {r.pos for r in exact.query(v, (x[q] * 0.9).tolist(), 5).collect()} for q in range(0, 200, 9)}
    got = {}
    for r in found:
        got.setdefault(r.qid, set()).add(r.pos)
    assert sum(len(want[q] & got[q]) for q in want) >= 0.95 * 5 * len(want)
    assert [r["hop"] for r in info] == list(range(1, len(info) + 1)) and info[-1]["entered"] == 0 and all(r["compared"] >= r["entered"] for r in info)
    near = search.graph_search_many(graph, v, queries, 5, search.Search(starts=500, epsilon=1.0)).collect()
    assert {(r.qid, r.pos) for r in near} == {(q, r) for q in want for r in want[q] if ((x[r] - x[q // 10] * 0.9) ** 2).sum() <= 1.0}
    ranged = queries.withColumn("l", F.lit(40).cast("bigint")).withColumn("r", F.lit(90).cast("bigint"))
    for r in search.graph_search_many(graph, v, ranged, 5, search.Search(starts=6, width=20)).collect():
        assert 40 <= r.pos <= 90
    assert search.graph_search_many(graph, v, queries.where("false"), 5, search.Search(starts=4)).count() == 0


def test_batches_are_judged(spark, monkeypatch):
    """Over a graph of separate parts a batch finds all by a screen where its walks fall short (before: what one part held), and its controls alone have walked for it where it is large."""
    x = np.random.default_rng(14).standard_normal((150, 5)) + np.repeat(np.eye(5) * 30, 30, axis=0)
    v, walked, walk = frame(spark, x).cache(), [], search.walk
    graph = nndescent.with_reverse(exact.graph(v, 4)).cache()
    queries = v.select(F.col("pos").alias("qid"), "embedding")
    monkeypatch.setattr(search, "CONTROLS", 12)
    monkeypatch.setattr(search, "walk", lambda asked, *more: walked.append(asked.count()) or walk(asked, *more))
    want = {(r.node, r.nbr) for r in exact.graph(v, 5, nodes=v, with_self=True).collect()}
    for tried, many in ((50, [12]), (1000, [150])):
        monkeypatch.setattr(search, "TRIED", tried)
        walked.clear()
        found = search.graph_search_many(graph, v, queries, 5, search.Search(starts=1, width=10))
        assert {(r.qid, r.pos) for r in found.collect()} == want and walked == many
    # Walks that find enough are what is returned.
    walked.clear()
    monkeypatch.setattr(search, "ENOUGH", 0.0)
    monkeypatch.setattr(search, "TRIED", 50)
    found = search.graph_search_many(graph, v, queries, 5, search.Search(starts=1, width=10))
    assert {(r.qid, r.pos) for r in found.collect()} < want | {(q, p) for q in range(150) for p in range(150)} and walked == [12, 150]


def test_layered_batches_are_judged(spark, monkeypatch):
    """As above, on a layered graph most of whose edges are missing; deleted nodes are not found by the screen either."""
    x = np.random.default_rng(15).standard_normal((70, 5))
    graph = layers.build(frame(spark, x), layers.Layers(m=8, candidates=16)).where("level > 0 OR (node % 7 = nbr % 7)")
    monkeypatch.setattr(search, "CONTROLS", 7)
    monkeypatch.setattr(search, "TRIED", 50)
    gone = set(range(0, 70, 3))
    assert layer_recall(spark, graph, x, gone, width=12, dead=spark.createDataFrame([(g,) for g in gone], "pos bigint")) * 10 * 70 == 10 * 70


def test_radius_gate(spark):
    """Fewer distances and no worse a graph, round by round."""
    x = np.random.default_rng(5).standard_normal((500, 8))
    v, done = frame(spark, x).cache(), {}
    want = {(r.node, r.nbr) for r in exact.graph(v, 6).collect()}
    for gate in (True, False):
        rounds = []
        graph, _ = nndescent.build(v, nndescent.Params(k=6, keep=18, sample=8, reverse=16, rounds=6, enough_recall=2.0, gate=gate), rounds=rounds)
        got = {(r.node, r.nbr) for r in nndescent.truncated(graph, 6).collect()}
        done[gate] = (sum(r["compared"] for r in rounds), len(want & got) / len(want))
        assert all(r["compared"] > 0 for r in rounds[:2])
    print("radius gate", done)
    assert done[True][1] >= done[False][1] - 0.02 and done[True][1] >= 0.9


@pytest.mark.parametrize("bits", [(1, 1), (2, 2), (6, 4)])
def test_dyadic(spark, vectors, index, monkeypatch, tmp_path, bits):
    """Every range, of grains of any size, from a table and from a saved one; rows are stored twice a level and grain at most."""
    monkeypatch.setattr(dyadic, "FIRST_BITS", bits[0])
    monkeypatch.setattr(dyadic, "STEP_BITS", bits[1])
    monkeypatch.setattr(dyadic, "NODES_A_FOLDER", 16)
    n = len(vectors[0])
    ranges = [(n * low + high, low, high) for low in range(0, n, 4) for high in range(low, n, 3)] + [(10**6, -5, 3), (10**6 + 1, 50, 900), (10**6 + 2, 9, 3)]
    df = spark.createDataFrame(ranges, "qid bigint, l bigint, r bigint")
    want = {(r.qid, r.node, r.nbr, r["rank"]) for r in interval_index.graphs(index[0], df.where("l <= r AND l >= 0 AND r < 60"), K).collect()}
    want |= {(q, *e) for q, low, high in ((10**6, 0, 3), (10**6 + 1, 50, n - 1)) for e in brute(vectors[0], low, high)}
    rows = dyadic.layout(index[0], n)
    assert {(r.qid, r.node, r.nbr, r["rank"]) for r in dyadic.graphs(rows, df, K, n).collect()} == want
    dyadic.save(index[0], n, f"{tmp_path}/dyadic")
    assert {(r.qid, r.node, r.nbr, r["rank"]) for r in dyadic.saved_graphs(spark, f"{tmp_path}/dyadic", df, K).collect()} == want
    assert rows.groupBy("grain", "side", "level", "node", "nbr").count().agg(F.max("count")).first()[0] <= 2
    few = dyadic.saved_graphs(spark, f"{tmp_path}/dyadic", df.where("qid = 1"), K)
    assert few._jdf.queryExecution().executedPlan().toString().count("CartesianProduct") == 0 and "NestedLoop" not in few._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("held", [1 << 20, 7])
def test_totals(spark, vectors, index, monkeypatch, held):
    """What a batch's graphs add up to equals sums over their edges, in groups and portions of any size, and no edge is a row of the plan."""
    monkeypatch.setattr(interval_index, "LEAST_TOTAL", 9)
    monkeypatch.setattr(interval_index, "RANGES_HELD", held)
    n = len(vectors[0])
    ranges = [(n * low + high, low, high) for low in range(0, n, 3) for high in range(low, n, 2)] + [(10**6, -5, 3), (10**6 + 1, 50, 900), (10**6 + 2, 9, 3), (10**6 + 3, 900, 950)]
    df = spark.createDataFrame(ranges, "qid bigint, l bigint, r bigint")
    edges = interval_index.graphs(index[0], df.where("l <= r").select("qid", F.greatest("l", F.lit(0)).alias("l"), F.least("r", F.lit(n)).alias("r")), K)
    want = {r.qid: (r.n, r.c, r.d) for r in edges.groupBy("qid").agg(F.count("*").alias("n"), F.sum(F.col("node") * 31 + F.col("nbr") * 17 + F.col("rank")).alias("c"), F.sum("dist").alias("d")).collect()}
    got = interval_index.totals(index[0], df, K, (31, 17, 1))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    got = {r.qid: (r.n_edges, r.checksum, r.dist) for r in got.collect()}
    assert got.keys() == want.keys() and all(got[q][:2] == want[q][:2] and abs(got[q][2] - want[q][2]) < 1e-6 for q in want)
    assert interval_index.totals(index[0].where("false"), df, K).count() == 0


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "pos bigint, embedding array<float>")
    assert interval_index.build(empty, K).count() == 0
    assert exact.graph(empty, K).count() == 0
    one = frame(spark, np.ones((1, 4)))
    assert interval_index.build(one, K).count() == 0
    graph, info = nndescent.build(one)
    assert graph.count() == 0 and info["stop"] == "size"


def test_rank(spark):
    rows = spark.createDataFrame([(k % 5, k) for k in range(50)], "key int, id int")
    got = [(r.key, r.id) for r in keys.rank(rows, "key", "id").orderBy("pos").collect()]
    assert got == sorted(got)
    assert [r.pos for r in keys.rank(rows, "key", "id").orderBy("pos").collect()] == list(range(50))


def test_save_and_load(spark, index, tmp_path):
    store.save_index(index[0], str(tmp_path / "ix"))
    assert store.load_index(spark, str(tmp_path / "ix"), 0, 59).count() == len(index[1])
    found = store.integrity(index[0], K).first().asDict()
    assert found.pop("n_rows") == len(index[1]) and set(found.values()) == {0}
    bad = index[0].limit(1).select("node", "side", F.col("node").alias("nbr"), "dist", "sub")
    wrong = store.integrity(index[0].unionByName(bad).unionByName(index[0].where("node = 30")), K).first()
    assert wrong.own == 1 and wrong.wrong_side == 1 and wrong.repeated > 0 and wrong.crowded > 0


def test_saved_things_are_checked(spark, index, tmp_path):
    path = str(tmp_path / "g")
    with pytest.raises(ValueError, match="nothing was saved"):
        store.load_graph(spark, path)
    edges = spark.createDataFrame([(0, 1, 0.5, 1), (1, 0, 0.5, 1)], "node bigint, nbr bigint, dist double, rank int")
    store.save_graph(edges, path)
    assert sorted(store.load_graph(spark, path).collect()) == sorted(edges.collect())
    with pytest.raises(ValueError, match="holds 'graph'"):
        store.load_vectors(spark, path)
    edges.limit(1).write.mode("append").parquet(f"{path}/data")
    with pytest.raises(ValueError, match="corrupt"):
        store.load_graph(spark, path)
    store.save_graph(edges, path)
    later = spark.read.json(f"{path}/about").withColumn("format", F.lit(99).cast("bigint")).collect()
    spark.createDataFrame(later).write.mode("overwrite").json(f"{path}/about")
    with pytest.raises(ValueError, match="later"):
        store.load_graph(spark, path)


def test_range_reads_little_of_a_saved_index(spark, index, tmp_path):
    """The folders of other nodes are left out, and the bounds reach the files."""
    wide = index[0].unionByName(index[0].withColumn("node", F.col("node") + 3 * store.NODES_A_FOLDER))
    store.save_index(wide, str(tmp_path / "ix"))
    graph = interval_index.graph(store.load_index(spark, str(tmp_path / "ix"), 10, 40), K, 10, 40)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = graph._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert len(scans) == 2 and all("PartitionFilters: [isnotnull(block" in s for s in scans)
    pushed = [s.split("PushedFilters: ")[1] for s in scans]
    assert all("GreaterThanOrEqual(node,10)" in s and "LessThanOrEqual(node,40)" in s for s in pushed)
    assert any("LessThan(sub,10)" in s and "GreaterThanOrEqual(nbr,10)" in s for s in pushed) and any("GreaterThan(sub,40)" in s and "LessThanOrEqual(nbr,40)" in s for s in pushed)


def test_sql_surface(spark, vectors, index):
    sql.register(spark, vectors[1], index[0])
    assert triples(spark.sql("SELECT * FROM rk_neighbours(10, 40, 3)")) == brute(vectors[0], 10, 40)
    assert spark.sql("SELECT rk_l2sqr(array(1f, 2f), array(1f, 4f)) AS d").first().d == 4


def test_stream(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal((30, 4))
    folder = tmp_path / "in"
    rows = lambda a, b: spark.createDataFrame([(k, k, [float(v) for v in x[k]]) for k in range(a, b)], "id bigint, search_key bigint, embedding array<float>")
    keeper = Maintainer(spark, str(tmp_path / "state"), K)
    for a, b in ((0, 25), (25, 27), (27, 30)):
        rows(a, b).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema("id bigint, search_key bigint, embedding array<float>").parquet(str(folder))
        keeper.start(stream, str(tmp_path / "progress")).awaitTermination()
    want = interval_index.build(keeper.vectors(), K).toPandas()
    key = ["node", "side", "nbr", "sub"]
    assert keeper.vectors().count() == 30
    assert sorted(map(tuple, keeper.index().toPandas()[key].values)) == sorted(map(tuple, want[key].values))
    with pytest.raises(ValueError, match="in order"):
        keeper.add(rows(3, 4), 99)


def test_stream_state_is_compacted(spark, tmp_path):
    """Open rows of all nodes are written anew now and then; batches that come again change nothing; an empty one neither."""
    x = np.random.default_rng(2).integers(0, 4, (24, 3))
    keeper = Maintainer(spark, str(tmp_path / "state"), K, compact_every=2)
    rows = lambda a, b: spark.createDataFrame([(k, k, [float(v) for v in x[k]]) for k in range(a, b)], "id bigint, search_key bigint, embedding array<float>")
    for version, (a, b) in enumerate([(0, 9), (9, 10), (10, 10), (10, 16), (16, 24)]):
        for _ in range(2):
            keeper.add(rows(a, b), version)
    assert [whole for _, whole in keeper._versions()] == [False, True, False, True, False]
    assert rows_of(keeper.index()) == rows_of(interval_index.build(keeper.vectors(), K))


def test_stream_state_stays_small(spark, tmp_path):
    """Folders are merged by levels: what is read, and the plan, do not grow with the number of batches."""
    x = np.random.default_rng(3).integers(0, 4, (18, 3))
    keeper = Maintainer(spark, str(tmp_path / "state"), K, compact_every=2)
    plans = {}
    for k in range(17):
        keeper.add(spark.createDataFrame([(k, k, [float(v) for v in x[k]])], "id bigint, search_key bigint, embedding array<float>"), k * 10)
        if k in (1, 15):
            plans[k] = keeper.index()._jdf.queryExecution().optimizedPlan().toString().count("Relation")
    assert plans[1] == plans[15] == 2
    assert keeper._live(17) == ["4-15", "0-16"] and keeper._live(7) == ["2-3", "1-5", "0-6"] and keeper._live(0) == []
    want = rows_of(interval_index.build(keeper.vectors(), K))
    assert rows_of(keeper.index()) == want
    left = lambda: sum(len(list((tmp_path / "state" / what).iterdir())) for what in ("vectors", "closed", "open"))
    before = left()
    assert keeper.vacuum() == before - 6 and left() == 6 and keeper.vacuum() == 0
    assert rows_of(keeper.index()) == want
    keeper.add(spark.createDataFrame([(17, 17, [float(v) for v in x[17]])], "id bigint, search_key bigint, embedding array<float>"), 170)
    assert rows_of(keeper.index()) == rows_of(interval_index.build(keeper.vectors(), K)) and keeper.vectors().count() == 18


def test_metrics(spark):
    edge = "node int, nbr int, dist double, rank int"
    truth = spark.createDataFrame([(0, 1, 1.0, 1), (0, 2, 2.0, 2), (1, 0, 1.0, 1)], edge)
    found = spark.createDataFrame([(0, 1, 1.0, 1), (0, 3, 4.0, 2)], edge)
    assert metrics.graph_recall(truth, found).first().asDict() == {"hits": 1, "recall": 1 / 3, "precision": 0.5}
    ratios = {r.qid: r.ratio for r in metrics.approximation_ratio(truth.withColumnRenamed("node", "qid"), found.withColumnRenamed("node", "qid")).collect()}
    assert ratios == {0: 2.0, 1: 0.0}
    assert {r.node: (r.recall, r.unstable) for r in metrics.distance_recall(truth, found).collect()} == {0: (0.5, 0), 1: (0.0, 0)}
    assert metrics.accuracy(truth, found).first().asDict() == {"error": 0.5, "one_recall": 1.0}
    # Equal distances meet one by one; a found one that is too small is told; true distances of 0 are left out.
    ties = spark.createDataFrame([(0, 1, 1.0, 1), (0, 2, 1.0, 2)], edge)
    assert metrics.distance_recall(ties, ties.limit(1)).first().recall == 0.5
    assert metrics.distance_recall(ties, ties.withColumn("dist", F.lit(0.5))).first().unstable == 2
    zero = spark.createDataFrame([(0, 1, 0.0, 1), (0, 2, 2.0, 2)], edge)
    assert metrics.accuracy(zero, zero.withColumn("dist", F.col("dist") + 1)).first().asDict() == {"error": 0.5, "one_recall": 0.0}
    assert metrics.delta(truth.withColumn("is_new", F.col("nbr") == 1), 2).first().delta == 0.25


@pytest.mark.parametrize("name", ["l2sqr", "ip", "cosine", "l2"])
def test_no_candidates_travel(spark, name):
    """What leaves a group of nodes is the index; lengths from 1e-30 to 1e30, copies and zeros do not mislead the screen."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((150, 6)) * 10.0 ** rng.choice([-30, -3, 0, 3, 30], (150, 1))
    x[20:30], x[90] = x[3], 0.0
    v = spark.createDataFrame([(k, [float(a) for a in r]) for k, r in enumerate(x)], "pos bigint, embedding array<double>")
    index = interval_index.build(v, 3, rows=16, name=name)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and plan.index("MapInArrow") < plan.index("Exchange")
    far = blocks_far(x, name)
    rows = [(r.node, r.side, r.nbr, r.sub) for r in index.collect()]
    want = []
    for node in range(len(x)):
        for nbr in range(len(x)):
            left = nbr < node
            nearer = [p for p in range(len(x)) if p != node and (p < node) == left and (far[node, p], p) < (far[node, nbr], nbr)]
            nearer = sorted(nearer, reverse=left)
            sub = nearer[2] if len(nearer) > 2 else (-1 if left else interval_index.OPEN)
            if nbr != node and (sub < nbr if left else nbr < sub):
                want.append((node, "L" if left else "R", nbr, sub))
    assert sorted(rows) == sorted(want)


def blocks_far(x, name):
    from rangeloom.functions.distance import row_distances

    n = len(x)
    return row_distances(np.repeat(x, n, axis=0), np.tile(x, (n, 1)), name).reshape(n, n)


def test_layers_scan_where_it_is_cheaper(spark, monkeypatch):
    """No hop is walked while a graph of few vectors grows, and a search walks its lowest level alone."""
    x = np.random.default_rng(5).standard_normal((120, 5))
    v, rows = frame(spark, x), []
    graph = layers.build(v, layers.Layers(m=8, candidates=16, first=60), rows)
    assert rows == []
    assert layer_recall(spark, graph, x, info=rows) >= 0.95
    assert {r["level"] for r in rows} == {0}


def test_layers_scanned_as_one(spark, monkeypatch):
    """The same graph as level by level, where both scan, in fewer jobs, since their number does not grow with the levels."""
    x = np.random.default_rng(8).standard_normal((150, 5))
    v = frame(spark, x).where("pos <> 40").cache()
    p, got = layers.Layers(m=2, candidates=160, first=100), []
    for pairs in (layers.SCAN_PAIRS, 0):
        monkeypatch.setattr(layers, "SCAN_PAIRS", pairs)
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
        graph = layers.insert(layers.build(v.where("pos < 90"), p), v.where("pos < 90"), v.where("pos >= 90"), p)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
        got.append(({(r.level, r.node, r.nbr, r.dist) for r in graph.collect()}, jobs))
    assert {level for level, *_ in got[0][0]} >= {0, 1} and got[0][0] == got[1][0]
    print("jobs", got[0][1], got[1][1])
    assert got[0][1] < 0.8 * got[1][1]


def test_layers_grow_in_few_batches(spark, monkeypatch):
    """Where a scan is cheaper, batches grow by more than twice (before: six batches here), and what is found is not less, also among clusters larger than the candidates."""
    rng, sizes, put = np.random.default_rng(9), [], layers._put
    x = rng.standard_normal((600, 6))
    x[300:] = rng.standard_normal((6, 6)).repeat(50, axis=0) * 9 + x[300:] / 9
    monkeypatch.setattr(layers, "_put", lambda graph, old, come, *more: sizes.append(come.count()) or put(graph, old, come, *more))
    p = layers.Layers(m=8, candidates=32, first=20)
    graph = layers.build(frame(spark, x), p)
    assert sum(sizes) == 600 and len(sizes) == 3
    degrees_hold(graph, p.m)
    assert layer_recall(spark, graph, x) >= 0.95
    # Not where these would be too many pairs: they double there.
    sizes.clear()
    monkeypatch.setattr(layers, "_put", lambda graph, old, come, *more: sizes.append(come.count()) or graph)
    monkeypatch.setattr(layers, "SCAN_PAIRS", 1000)
    layers.build(frame(spark, x), p)
    assert sum(sizes) == 600 and len(sizes) == 6


def test_large_layers_grow_by_scans(spark, monkeypatch):
    """A graph of 600,000 vectors grows eightfold a batch too, each scanned (before: its last batches doubled, and walked)."""
    v, sizes = spark.range(600_000).select(F.col("id").alias("pos"), F.array(F.lit(1.0)).alias("embedding")), []
    monkeypatch.setattr(layers, "_put", lambda graph, old, come, *more: sizes.append((old.count(), come.count())) or graph)
    layers.build(v, layers.Layers(first=256))
    assert sum(come for _, come in sizes) == 600_000 and len(sizes) == 5
    assert all((old + come) * come <= layers.SCAN_PAIRS for old, come in sizes)


def test_descent_is_finished_exactly(spark):
    """What a single round leaves out is found by the screen, where the controls say that it is too little."""
    x = np.random.default_rng(6).standard_normal((150, 8))
    v = frame(spark, x)
    graph, info = nndescent.build(v, nndescent.Params(k=K, keep=6, sample=1, reverse=2, rounds=1, enough_recall=1.0))
    assert info["stop"].endswith("then all") and info["recall"] == 1.0
    assert triples(nndescent.truncated(graph, K)) == triples(exact.graph(v, K))


def test_a_point_travels_once_to_each_part(spark):
    """Pairs are measured where their vectors are: each once, none that is known, none farther than a full beam's last."""
    rng = np.random.default_rng(4)
    x, q = rng.standard_normal((600, 4)), rng.standard_normal((20, 4))
    own = search.prepared(frame(spark, x))
    held = search._store(own)
    assert {c for c, kind in held.rows.dtypes if kind.startswith("array")} == set()
    asked = search.asked(spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(q)], "qid bigint, embedding array<double>"), 3)
    met = spark.createDataFrame([(a, b) for a in range(20) for b in (*range(a, 600, 7), a, 9999)], "qid bigint, pos bigint")
    far = lambda a, b: float(((np.float32(x[b]).astype(float) - q[a]) ** 2).sum())
    rows = search._measured(met, held, asked, "l2sqr").collect()
    pairs = {(r.qid, r.pos): r.dist for r in rows if r.qid is not None}
    assert set(pairs) == {(a, b) for a in range(20) for b in range(a, 600, 7)} and all(abs(d - far(*p)) < 1e-9 for p, d in pairs.items())
    assert sum(r.n or 0 for r in rows) == len(pairs) == sum(r.qid is not None for r in rows)
    best = {a: sorted((far(a, b), b) for b in range(600))[:40] for a in range(20)}
    known = spark.createDataFrame([(a, b, d, True) for a, near in best.items() for d, b in near[2:6]], "qid bigint, pos bigint, dist double, ok boolean")
    again = {(r.qid, r.pos) for r in search._measured(met, held, asked, "l2sqr", known).collect() if r.qid is not None}
    assert again == {(a, b) for a in range(20) for d, b in best[a][:2] if (b - a) % 7 == 0 and b >= a}


@pytest.mark.parametrize("hops", [1, 2, 10])
def test_frontier_as_defined(spark, hops):
    """Steps by packed lists equal the steps by the definition, node by node; nothing but packed lists is held."""
    rng = np.random.default_rng(6)
    n, k, reach = 90, 2, 0.5
    edges = {a: {int(b) for b in rng.integers(0, n, 3)} - {a} for a in range(n) if a != 7}
    got = interval_index.frontier(frame(spark, rng.standard_normal((n, 3))), spark.createDataFrame([(a, b) for a, to in edges.items() for b in to], "node bigint, nbr bigint"), k, hops, reach)
    assert dict(got.dtypes)["found"] == "binary"
    mean, least = sum(len(v) for v in edges.values()) / n, int(np.ceil(reach * np.sqrt(k * n)))
    want = {}
    for a in range(n):
        found, step = set(), edges.get(a, set())
        for hop in range(1, hops + 1):
            new = step - found - {a}
            found |= new
            left, right = sorted((b for b in found if b < a), reverse=True), sorted(b for b in found if b > a)
            l = max(min(left[k - 1] if len(left) >= k else -1, a - least), -1)
            r = min(max(right[k - 1] if len(right) >= k else n, a + least), n)
            if not new or not (r - l >= len(new) * mean or len(found) < min(least, n - 1)):
                break
            step = {c for b in new for c in edges.get(b, ())}
        want[a] = (l, r, sorted(found))
    assert {r.node: (r.l, r.r, np.frombuffer(r.found, dtype=np.int64).tolist()) for r in got.collect()} == want
