"""Binary graph files and folders: written and read, cut ones refused, old files kept where a job fails."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.operators import exact, interval_index, layers
from rangeloom.sources import graphs, sinks, vectors

K = 4


@pytest.fixture(scope="module")
def table(spark):
    x = np.random.default_rng(2).standard_normal((120, 4)).astype("f4")
    return x, spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "pos bigint, embedding array<float>").cache()


@pytest.mark.parametrize("bare", [False, True])
def test_graph_file(spark, table, tmp_path, bare):
    """Nodes without a neighbour are there; parts of any size read the same; a node's own numbers and marks come back."""
    graph = exact.graph(table[1].where("pos % 5 <> 0"), K).withColumn("is_new", F.col("nbr") % 2 == 0).withColumn("m", F.lit(3)).cache()
    path = f"{tmp_path}/graph"
    graphs.write_graph(graph, path, 130, with_distance=not bare)
    blob = open(path, "rb").read()
    assert blob[:20] == struct.pack("<8sIII", b"KNNGRAPH", 2, int(bare), 130)
    assert len(blob) == 20 + 130 * 8 + graph.count() * (4 if bare else 12)
    want = {(r.node, r.nbr, r["rank"], None if bare else round(r.dist, 4), None if bare else r.is_new, r.m) for r in graph.collect()}
    for size in (graphs.PART_BYTES, 100):
        read = graphs.read_graph(spark, path, size)
        assert {(r.node, r.nbr, r["rank"], None if bare else round(r.dist, 4), r.is_new, r.m) for r in read.collect()} == want
    assert read.rdd.getNumPartitions() > 5


def test_graph_file_by_hand(spark, tmp_path):
    path = f"{tmp_path}/hand"
    with open(path, "wb") as f:
        f.write(b"KNNGRAPH" + struct.pack("<III", 2, 0, 2) + struct.pack("<II", 1, 2) + struct.pack("<If?xxx", 1, 0.5, True) + struct.pack("<If?xxx", 7, 2.5, False) + struct.pack("<II", 0, 0))
    assert [tuple(r) for r in graphs.read_graph(spark, path).collect()] == [(0, 1, 0.5, 1, True, 1), (0, 7, 2.5, 2, False, 1)]


def test_cut_or_foreign_graph_files(spark, table, tmp_path):
    path = f"{tmp_path}/graph"
    graphs.write_graph(exact.graph(table[1], K), path)
    blob = open(path, "rb").read()
    for bad, message in ((blob[:10], "cut in its head"), (blob[:21], "is missing"), (blob[:-1], "cut in record"), (blob + b"x", "behind the last"), (b"KNNGRAPX" + blob[8:], "no K-NN graph"), (blob[:8] + struct.pack("<I", 3) + blob[12:], "version 3"), (blob[:12] + struct.pack("<I", 6) + blob[16:], "unknown flags")):
        open(path, "wb").write(bad)
        with pytest.raises(Exception, match=message):
            graphs.read_graph(spark, path).count()


def test_layered_file(spark, table, tmp_path):
    """Written, read, equal; searched after it was read; a cut file is refused."""
    x, v = table
    own = v.withColumn("id", F.col("pos") * 3 + 1).withColumn("deleted", F.col("pos") % 9 == 0)
    p = layers.Layers(m=4, candidates=16)
    built = layers.build(v, p)
    path = f"{tmp_path}/layers"
    graphs.write_layered(built, own, path, p.m)
    for size in (graphs.PART_BYTES, 200):
        nodes, links = graphs.read_layered(spark, path, size)
        assert {(r.pos, r.id, tuple(r.embedding), r.deleted) for r in nodes.collect()} == {(r.pos, r.id, tuple(r.embedding), r.deleted) for r in own.collect()}
        assert {(r.level, r.node, r.nbr) for r in links.collect()} == {(r.level, r.node, r.nbr) for r in built.collect()}
    queries = v.select(F.col("pos").alias("qid"), "embedding")
    one, other = ({(r.qid, r.pos) for r in layers.search_many(g, nodes, queries, 5, dead=nodes.where("deleted").select("pos")).collect()} for g in (built, links))
    assert one == other and all(pos % 9 for _, pos in one)
    blob = open(path, "rb").read()
    for bad, message in ((blob[:50], "cut in its head"), (blob[:500], "cut in its lowest"), (blob[:-2], "cut|missing"), (blob + b"xy", "behind the last"), (b"\1" + blob[1:], "of this layout")):
        open(path, "wb").write(bad)
        with pytest.raises(Exception, match=message):
            graphs.read_layered(spark, path)[1].count()


def test_index_text(spark, table, tmp_path):
    """Lines are numbered across files; nodes without rows have a line."""
    index = interval_index.build(table[1], K).where("node <> 7").cache()
    graphs.write_index_text(index, f"{tmp_path}/text", 120)
    lines = [line for name in sorted(os.listdir(f"{tmp_path}/text")) if name.startswith("part") for line in open(f"{tmp_path}/text/{name}").read().splitlines()]
    assert len(lines) == 120 and lines[7] == ";" and lines[0].startswith(";") and all(line.count(";") == 1 for line in lines)
    read = graphs.read_index_text(spark, f"{tmp_path}/text", 120)
    key = lambda df: sorted((r.node, r.side, r.nbr, r.sub) for r in df.collect())
    assert key(read) == key(index)


@pytest.mark.parametrize("layout", ["lshkit", "fvecs", "bvecs"])
def test_a_failed_job_leaves_the_old_files(spark, table, tmp_path, layout):
    path = f"{tmp_path}/{layout}"
    v = table[1].withColumn("embedding", F.transform("embedding", lambda x: F.floor(F.abs(x) * 50).cast("float")))
    vectors.write_matrix(v.where("pos < 60"), path, layout)
    before = {n: open(f"{path}/{n}", "rb").read() for n in os.listdir(path)}
    bad = v.withColumn("embedding", F.when(F.col("pos") == 100, F.slice("embedding", 1, 2)).otherwise(F.col("embedding")))
    with pytest.raises(Exception, match="several lengths"):
        vectors.write_matrix(bad, path, layout)
    assert {n: open(f"{path}/{n}", "rb").read() for n in os.listdir(path)} == before
    vectors.write_matrix(v, path, layout)
    got = {r.pos: list(r.embedding) for r in vectors.binary(spark, path, layout).collect()}
    assert got == {r.pos: list(r.embedding) for r in v.collect()} and not any(n.startswith("_writing") for n in os.listdir(path))


def test_placed_bytes(spark, tmp_path):
    """A file with a hole is refused, and the old one stays."""
    path = f"{tmp_path}/file"
    rows = spark.createDataFrame([(4, b"cd"), (0, b"abXX"), (6, b"ef")], "offset bigint, bytes binary").repartition(3)
    sinks.write_placed(rows, path, 8)
    assert open(path, "rb").read() == b"abXXcdef"
    with pytest.raises(Exception, match="were placed where"):
        sinks.write_placed(rows, path, 9)
    assert open(path, "rb").read() == b"abXXcdef" and os.listdir(tmp_path) == ["file"]


def test_a_written_graph_is_worked_out_once(spark, tmp_path):
    """Its plan runs once, though its nodes are counted and its lists made of it."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(n, (n + 1) % 6, 0.5, 1) for n in range(6)], "node bigint, nbr bigint, dist double, rank int")
    graphs.write_graph(rows.mapInArrow(run, rows.schema), f"{tmp_path}/once.bin")
    assert seen.value == 6 and graphs.read_graph(spark, f"{tmp_path}/once.bin").count() == 6
