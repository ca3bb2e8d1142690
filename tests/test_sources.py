"""Vector files: written by hand, read by the readers."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.functions import arrays, distance
from rangeloom.sources import vectors as V

X = np.random.default_rng(0).standard_normal((7, 5)).astype("<f4")


def rows(df):
    return [list(r.embedding) for r in df.collect()]


def test_binary_layouts(spark, tmp_path):
    f = tmp_path / "a.fvecs"
    f.write_bytes(b"".join(struct.pack("<i", 5) + r.tobytes() for r in X))
    got = V.read(spark, "local", str(f)).orderBy("pos")
    assert np.array_equal(np.array(rows(got), dtype="<f4"), X)
    assert [r.pos for r in got.collect()] == list(range(7))
    assert V.read(spark, "deep1b", str(f), limit=3).count() == 3
    b = tmp_path / "a.bvecs"
    b.write_bytes(b"".join(struct.pack("<i", 5) + bytes(range(k, k + 5)) for k in range(4)))
    assert rows(V.read(spark, "sift", str(b)).orderBy("pos"))[1] == [1, 2, 3, 4, 5]
    m = tmp_path / "a.lshkit"
    m.write_bytes(struct.pack("<III", 4, 7, 5) + X.tobytes())
    assert np.array_equal(np.array(rows(V.read(spark, "lshkit", str(m)).orderBy("pos")), dtype="<f4"), X)
    w = tmp_path / "a.raw"
    w.write_bytes(b"head" + b"".join(r.tobytes() + b"gap!" for r in X))
    assert np.array_equal(np.array(rows(V.binary(spark, str(w), "raw", dim=5, skip=4, gap=4).orderBy("pos")), dtype="<f4"), X)
    assert rows(V.read(spark, "raw", str(w), dim=5, skip=4, gap=4, limit=2).orderBy("pos"))[1] == X[1].tolist()
    with pytest.raises(ValueError, match="needs dim"):
        V.read(spark, "raw", str(w))
    (tmp_path / "bad.fvecs").write_bytes(struct.pack("<i", 5) + b"xx")
    with pytest.raises(Exception, match="whole number"):
        V.read(spark, "local", str(tmp_path / "bad.fvecs")).count()
    (tmp_path / "none.fvecs").write_bytes(b"")
    assert V.read(spark, "local", str(tmp_path / "none.fvecs")).count() == 0


def test_text_layouts(spark, tmp_path):
    (tmp_path / "d.txt").write_text("1 2.5 -3\n4 5 6\n")
    assert rows(V.read(spark, "ml25m", str(tmp_path / "d.txt"))) == [[1, 2.5, -3], [4, 5, 6]]
    (tmp_path / "w.txt").write_text("the 1 2\nof 3 4\n")
    assert [(r.id, list(r.embedding)) for r in V.read(spark, "glove", str(tmp_path / "w.txt")).collect()] == [("the", [1, 2]), ("of", [3, 4])]
    (tmp_path / "t.tsv").write_text("id\ta\tb\nx\t1\t2\n")
    assert [(r.id, list(r.embedding)) for r in V.read(spark, "biggraph", str(tmp_path / "t.tsv")).collect()] == [("x", [1, 2])]
    (tmp_path / "y.csv").write_text('v1,17,"1 2 3"\n')
    assert [(r.id, r.search_key, list(r.embedding)) for r in V.read(spark, "yt8m", str(tmp_path / "y.csv")).collect()] == [("v1", 17, [1, 2, 3])]
    with pytest.raises(ValueError):
        V.read(spark, "nothing", "x")


def test_truth_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("0 3 4 \n1 2 0 \n")
    assert [list(r.nbrs) for r in V.truth_lists(spark, str(tmp_path / "t.txt")).collect()] == [[0, 3, 4], [1, 2, 0]]
    (tmp_path / "q.csv").write_text('5,10,20,a,b,c,"1 2 3"\n')
    r = V.truth_queries(spark, str(tmp_path / "q.csv")).first()
    assert (r.qid, r.l, r.r, list(r.nbrs)) == (5, 10, 20, [1, 2, 3])


def test_write_text(spark, tmp_path):
    df = spark.createDataFrame([([1.0, 2.5],)], "embedding array<float>")
    V.write_text(df, str(tmp_path / "o"))
    assert rows(V.dense_text(spark, str(tmp_path / "o"))) == [[1.0, 2.5]]


@pytest.mark.parametrize("layout", ["lshkit", "fvecs", "bvecs"])
def test_write_matrix(spark, tmp_path, layout):
    """A folder of files in order of position reads as one, its first rows are those of the first files, and writing again replaces it."""
    x = np.random.default_rng(1).integers(0, 255, (50, 3)).astype("<f4")
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "pos bigint, embedding array<float>").repartition(7)
    for _ in range(2):
        V.write_matrix(df, str(tmp_path / layout), layout)
    got = V.read(spark, layout, str(tmp_path / layout)).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(50)) and [list(r.embedding) for r in got] == x.tolist()
    assert sorted(r.pos for r in V.read(spark, layout, str(tmp_path / layout), 11).collect()) == list(range(11))


def test_first_lines(spark, tmp_path):
    (tmp_path / "d.txt").write_text("".join(f"{k} {k}\n" for k in range(100)))
    assert sorted(rows(V.read(spark, "ml25m", str(tmp_path / "d.txt"), 5))) == [[k, k] for k in range(5)]


def test_write_truth(spark, tmp_path):
    g = spark.createDataFrame([(0, 3, 1), (0, 4, 2), (1, 0, 1)], "node bigint, nbr bigint, rank int")
    V.write_truth(g, str(tmp_path / "t"))
    assert sorted(list(r.nbrs) for r in V.truth_lists(spark, str(tmp_path / "t")).collect()) == [[0, 3, 4], [1, 0]]


def test_synthetic(spark):
    v = V.synthetic(spark, 50, 3, noise=0.1)
    x = np.array(rows(v.orderBy("pos")))
    assert x.shape == (50, 3) and np.abs(x).max() < 1.6 and np.array_equal(x, np.array(rows(V.synthetic(spark, 50, 3, noise=0.1).orderBy('pos'))))
    q = V.synthetic_queries(v, 9)
    assert all(y[k] in x[:, k] for y in rows(q) for k in range(3)) and q.count() == 9


def test_functions(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0], [0.0, 0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(arrays.argsort(F.col("a")).alias("o"), arrays.take(F.col("a"), arrays.argsort(F.col("a"))).alias("s"), distance.l2_normalize(F.col("z")).alias("n"), distance.l2sqr(F.col("a"), F.col("z"), 1, 2).alias("d"), arrays.split_keeping_empty(F.lit("a,b;"), ",;").alias("p"), arrays.base100_id(F.lit("ABab")).alias("i")).first()
    assert list(r.o) == [1, 2, 0] and list(r.s) == [1, 2, 3] and list(r.n) == [0, 0, 0] and r.d == 5 and list(r.p) == ["a", "b", ""] and r.i == 27285960
    s = spark.range(100).selectExpr("id % 3 AS g", "id AS x")
    assert arrays.sampled(s, "g", "x", 5, 1).groupBy("g").count().collect() == arrays.sampled(s, "g", "x", 5, 1).groupBy("g").count().collect()
    with pytest.raises(ValueError):
        distance.metric("none")
