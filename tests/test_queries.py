"""Every registered query against its SQL on a small table, and what has no SQL against brute force."""

import math
import sys

import duckdb
import numpy as np
import pytest

from rangeloom import catalog
from rangeloom.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("embeddings", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def tidy(df):
    show = lambda x: "%.6f" % (round(float(x), 6) + 0.0) if isinstance(x, (float, np.floating)) and not math.isnan(x) else str(x)
    return sorted(tuple(show(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert tidy(got) == tidy(want)


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() == 200 * q.K


@pytest.fixture(scope="module")
def truth(spark):
    return {(r.node, r.nbr) for r in q.exact_knn_graph(spark, SF).collect()}


@pytest.mark.parametrize("name", ["nn_descent_graph", "lsh_knn_graph"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, name, sf):
    want, found = ({(r.node, r.nbr) for r in f(spark, f"/root/testdata/{sf}").collect()} for f in (q.exact_knn_graph, catalog.queries()[name]))
    print("recall", name, sf, len(want & found) / len(want))
    assert len(want & found) >= 0.9 * len(want)


def test_approximate_index_recall(spark):
    """On the larger table, over a tenth of the keys, two fifths, and all."""
    v, index = q._near_index(spark, "/root/testdata/sf0.1")
    index, n = q.cut(index), v.count()
    for low, high in ((100, 299), q.middle(n), (0, n - 1)):
        want, found = ({(r.node, r.nbr) for r in g.collect()} for g in (q.exact.graph(v, q.K, low, high), q.interval_index.graph(index, q.K, low, high)))
        print("recall", low, high, len(want & found) / len(want))
        assert len(want & found) >= 0.9 * len(want)


def test_parts_and_cells_do_not_matter(spark):
    """The same neighbours however a cell is cut; many small cells find fewer, and descent the rest."""
    v = q.by_label(spark, SF)
    assert q.edges(q.nndescent.hashed_edges(v, q.K, rows=7)).exceptAll(q.edges(q.nndescent.hashed_edges(v, q.K))).count() == 0


@pytest.mark.parametrize(("truth", "name"), [("range_knn_query", "beam_search"), ("range_knn_query", "quantized_range_search")])
def test_searches(spark, truth, name):
    want, found = ({r.pos for r in catalog.queries()[n](spark, SF).collect()} for n in (truth, name))
    assert len(want & found) >= 9


@pytest.mark.parametrize("name", ["graph_search", "layered_search"])
def test_graph_searches(spark, name):
    v = q.by_label(spark, SF)
    want = {r.pos for r in q.exact.query(v, q.point(v, 250), 10).collect()}
    assert len(want & {r.pos for r in catalog.queries()[name](spark, SF).collect()}) >= 9


def test_graph_search_as_defined(spark):
    """Trials, starts that are given, the largest distance, and the exact scan where there are as many starts as vectors."""
    v = q.by_label(spark, SF).cache()
    graph = q.nndescent.with_reverse(q.exact.graph(v, q.K)).cache()
    exact_ = [(r.pos, r.rank) for r in q.exact.query(v, q.point(v, 9), 5).collect()]
    info = {}
    found = q.search.graph_search(graph, v, q.point(v, 9), 5, q.search.Search(starts=500), info=info)
    assert info["stop"] == "exact" and [(r.pos, r.rank) for r in found.collect()] == exact_
    found = q.search.graph_search(graph, v, q.point(v, 9), 5, q.search.Search(starts=3, trials=3, width=40), info=info)
    assert info["hops"] > 3 and info["cost"] > 0 and len({r.pos for r in found.collect()} & {p for p, _ in exact_}) >= 4
    found = q.search.graph_search(graph, v, q.point(v, 9), 5, q.search.Search(epsilon=0.0), starts=[0, 400])
    assert [r.pos for r in found.collect()] == [9]


def test_every_query_has_sql_or_a_recall_row(spark):
    without = set(catalog.queries()) - set(catalog.oracle_sql())
    recall = {n.removesuffix("_recall") for n in catalog.oracle_sql() if n.endswith("_recall")}
    assert {n.removesuffix("_graph").removesuffix("_knn") for n in without} <= {n.removesuffix("_graph").removesuffix("_knn") for n in recall} | {"quantized_range_search", "search_information", "build_information"}


def test_core_without_the_training_data_operators(monkeypatch):
    """Where their subpackage, or something that it needs, is missing, all core queries are there."""
    import __spark_entry__

    monkeypatch.setitem(sys.modules, "rangeloom.llm", None)
    assert set(__spark_entry__.queries()) == set(catalog.queries()) and set(__spark_entry__.oracle_sql()) == set(catalog.oracle_sql())
    monkeypatch.undo()
    monkeypatch.delitem(sys.modules, "rangeloom.llm.catalog", raising=False)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    for name in [n for n in sys.modules if n.startswith("rangeloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    assert set(__spark_entry__.queries()) == set(catalog.queries())


def test_integer_distance_in_single_precision(spark, tmp_path):
    """0.18 as a float, times 100: 18 in single precision, as SQL reckons, 17.99… in double."""
    rows = [(0, [0.17999999225139618] * 64, 0), (1, [0.0] * 64, 0), (2, [0.28999999165534973] * 64, 0)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got, want = catalog.queries()["integer_distance"](spark, str(tmp_path)).toPandas(), con.execute(catalog.oracle_sql()["integer_distance"]).df()
    assert tidy(got) == tidy(want) and sorted(got["d"]) == [64 * 18**2, 64 * 29**2]


@pytest.mark.parametrize("name", ["multi_range_graph", "saved_index_multi_range"])
def test_batch_reads_its_ranges_part_of_the_index(spark, tmp_path, monkeypatch, name):
    """Of a saved index of four folders, the one that holds the batch's nodes."""
    monkeypatch.setattr(q.store, "NODES_A_FOLDER", 500)
    read, graphs = [], q.interval_index.graphs
    monkeypatch.setattr(q.interval_index, "graphs", lambda index, *more: read.append(index) or graphs(index, *more))
    spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.queries()[name](spark, str(tmp_path))
    assert read[0].agg({"node": "max"}).first()[0] == 499
    every = q.held(spark, str(tmp_path))
    want = graphs(every, spark.createDataFrame(q.RANGES, "qid int, l bigint, r bigint"), q.K)
    assert every.agg({"node": "max"}).first()[0] == 1999
    assert want.count() == got.count() and got.select("qid", "node", "nbr").exceptAll(want.select("qid", "node", "nbr")).count() == 0
