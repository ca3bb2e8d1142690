"""The command line and the experiments on a small file."""

import struct

import numpy as np

from rangeloom import __main__ as cli
from rangeloom.operators import interval_index, store
from rangeloom.plans import experiment


def test_commands(spark, tmp_path, capsys):
    x = np.random.default_rng(0).standard_normal((40, 4)).astype("<f4")
    f = tmp_path / "x.fvecs"
    f.write_bytes(b"".join(struct.pack("<i", 4) + r.tobytes() for r in x))
    ix, g, t = (str(tmp_path / n) for n in ("ix", "g", "t"))
    cli.main(["index", "--data-path", str(f), "-k", "3", "--out", ix])
    assert store.load_index(spark, ix, check=True).count() > 100
    for _ in range(2):  # ground truth is added to what is there
        cli.main(["truth", "--data-path", str(f), "-k", "3", "--high", "9", "--out", t])
    assert spark.read.text(t).count() == 20
    cli.main(["search", "--data-path", str(f), "-k", "2", "--query", "5", "--high", "39"])
    assert "|5  |0.0" in capsys.readouterr().out
    cli.main(["search", "--data-path", str(f), "-k", "2", "--query", "5", "--high", "39", "--index", ix, "--eval"])
    out = capsys.readouterr().out
    assert "|5  |0.0" in out and "'recall': 1.0" in out
    cli.main(["index", "--data-path", str(f), "-k", "5", "--kind", "descent", "--reverse", "-1", "--prune", "2", "--out", g])
    assert "recall" in capsys.readouterr().out
    cli.main(["search", "--data-path", str(f), "-k", "2", "--query", "5", "--kind", "descent", "--index", g, "--init", "0", "20", "--eval"])
    assert "|5  |0.0" in capsys.readouterr().out
    cli.main(["search", "--data-path", str(f), "-k", "2", "--query", "5", "--high", "39", "--metric", "cosine", "--linear"])
    assert "|5  |" in capsys.readouterr().out
    cli.main(["index", "--dataset", "synthetic", "-n", "50", "--dim", "4", "-k", "3", "--kind", "near", "--out", ix])
    assert store.load_index(spark, ix).select("node").distinct().count() == 50


def test_experiments(spark):
    x = np.random.default_rng(0).standard_normal((60, 4))
    v = spark.createDataFrame([(k, [float(a) for a in r]) for k, r in enumerate(x)], "pos bigint, embedding array<float>")
    rows = {r.method: r for r in experiment.range_graphs(v, 3, 10, 49).collect()}
    assert rows["index"].recall == rows["index without bounds"].recall == 1.0 and rows["descent in the range"].recall > 0.7
    q = experiment.range_queries(interval_index.build(v, 3), v, [(0, x[20].tolist(), 10, 49)], 5).first()
    assert q.precision >= 0.6 and q.ratio >= 1.0
