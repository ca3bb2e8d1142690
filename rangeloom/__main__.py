"""Command line: ``python -m rangeloom index|search|truth|experiment``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.distance import METRICS, l2_normalize
from .operators import blocks, exact, interval_index, keys, metrics, nndescent, search, store
from .plans import experiment
from .sources import vectors as sources


def load(spark, args):
    """The data as (pos, embedding): in its own order, or ranked where it has a key."""
    if args.dataset == "synthetic":
        df = sources.synthetic(spark, args.n, args.dim, args.noise)
    else:
        options = {"dim": args.dim, "skip": args.skip, "gap": args.gap} if args.dataset == "raw" else {}
        df = sources.read(spark, args.dataset, args.data_path, args.n, **options)
    if "search_key" in df.columns:
        df = keys.vectors(df.withColumn("__id", F.monotonically_increasing_id()), "search_key", id="__id")
    elif "pos" not in df.columns:
        df = keys.rank(df.withColumn("__row", F.monotonically_increasing_id()), "__row")
    if args.l2norm:
        df = df.withColumn("embedding", l2_normalize(F.col("embedding")))
    return df.select("pos", "embedding")


def _search(spark, v, args, high) -> None:
    """The nearest to a vector of the data: by a scan of the range, over a saved graph, or over a saved index; with ``--eval``, against the scan."""
    point = list(v.where(F.col("pos") == args.query).first()["embedding"])
    info: dict = {}
    if args.linear or not args.index:
        found = exact.query(v, point, args.k, args.low, high, args.radius, args.metric)
    elif args.kind == "descent":
        p = search.Search(starts=args.starts, trials=args.trials, epsilon=1e30 if args.radius is None else args.radius, width=args.width)
        found = search.graph_search(store.load_graph(spark, args.index), v, point, args.k, p, args.init or None, args.metric, info)
    else:
        found = search.beam(store.load_index(spark, args.index, args.low, high), v, point, args.k, args.low, high, args.width, name=args.metric, info=info)
    found.show(args.k, False)
    if info:
        print(info)
    if args.eval:
        ranged = args.kind == "interval" or args.linear or not args.index
        want = exact.query(v, point, args.k, args.low if ranged else None, high if ranged else None, args.radius, args.metric)
        as_graph = lambda df: df.select(F.lit(0).alias("node"), F.col("pos").alias("nbr"), "dist", "rank")
        print(metrics.graph_recall(as_graph(want), as_graph(found)).first().asDict())


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="rangeloom")
    parser.add_argument("command", choices=["index", "search", "truth", "experiment"])
    parser.add_argument("--dataset", default="local", help="name or layout of the vector file, or synthetic")
    parser.add_argument("--data-path", default="")
    parser.add_argument("--out", default="")
    parser.add_argument("--index", default="", help="a saved index or graph to search")
    parser.add_argument("-n", type=int, default=-1, help="first so many vectors")
    parser.add_argument("-k", type=int, default=16)
    parser.add_argument("--low", type=int, default=0)
    parser.add_argument("--high", type=int, default=None, help="default: the middle of the positions")
    parser.add_argument("--query", type=int, default=0, help="position of the query vector")
    parser.add_argument("--radius", type=float, default=None)
    parser.add_argument("--metric", choices=sorted(METRICS), default="l2sqr")
    parser.add_argument("--kind", choices=["interval", "near", "descent"], default="interval")
    parser.add_argument("--linear", action="store_true", help="scan, whatever is saved")
    parser.add_argument("--eval", action="store_true", help="also print recall against the scan")
    parser.add_argument("--init", type=int, nargs="*", default=[], help="positions to begin a graph search at")
    parser.add_argument("--starts", type=int, default=100)
    parser.add_argument("--trials", type=int, default=1)
    parser.add_argument("--width", type=int, default=64)
    parser.add_argument("--prune", type=int, choices=[0, 1, 2], default=0)
    parser.add_argument("--reverse", type=int, default=0, help="also reverse edges, at most so many neighbours a node; -1: all")
    parser.add_argument("--l2norm", action="store_true")
    parser.add_argument("--dim", type=int, default=64, help="of raw and synthetic vectors")
    parser.add_argument("--skip", type=int, default=0)
    parser.add_argument("--gap", type=int, default=0)
    parser.add_argument("--noise", type=float, default=0.0)
    args = parser.parse_args(argv)
    if args.dataset != "synthetic" and not args.data_path:
        parser.error("--data-path is needed")
    spark = SparkSession.builder.appName("rangeloom").getOrCreate()
    v = load(spark, args)
    high = args.high if args.high is not None else max((v.agg(F.max("pos")).first()[0] or 0) // 2, args.low)
    if args.command == "index":
        if not args.out:
            parser.error("index needs --out")
        if args.kind == "interval":
            store.save_index(interval_index.build(v, args.k, name=args.metric), args.out)
        elif args.kind == "near":
            store.save_index(interval_index.build_near(v, nndescent.with_reverse(nndescent.hashed_graph(v, 2 * args.k, name=args.metric)), args.k, name=args.metric), args.out)
        else:
            graph, info = nndescent.build(v, nndescent.Params(k=args.k, name=args.metric))
            graph = graph.drop("is_new")
            if args.reverse:
                graph = nndescent.with_reverse(graph, None if args.reverse < 0 else args.reverse)
            if args.prune:
                graph = nndescent.truncated(graph, args.k)
            if args.prune == 2:
                graph = nndescent.without_detours(graph)
            store.save_graph(graph, args.out)
            print(info)
    elif args.command == "search":
        _search(spark, blocks.valid(v), args, high)
    elif args.command == "truth":
        truth = exact.graph(v, args.k, args.low, high, name=args.metric)
        sources.write_truth(truth, args.out) if args.out else truth.orderBy("node", "rank").show()
    else:
        experiment.range_graphs(v, args.k, args.low, high, args.out or None).show(truncate=False)


if __name__ == "__main__":
    main()
