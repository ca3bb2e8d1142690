"""A store of vectors that changes: versions, tombstones, and search over what is left; and saving, with checks on loading."""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import exists, remove, rename, shared_folder

#: What files of this library say of themselves.
FORMAT = 1


def upsert(old: DataFrame, new: DataFrame, id: str = "id") -> DataFrame:
    """All rows, those of ``new`` in the place of old ones of the same id; of several new ones, the last by ``version``."""
    both = old.withColumn("version", F.lit(-1).cast("bigint")).unionByName(new, allowMissingColumns=True)
    latest = Window.partitionBy(id).orderBy(F.desc("version"))
    return both.withColumn("__r", F.row_number().over(latest)).where("__r = 1").drop("__r", "version")


def remove_rows(rows: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    return rows.join(ids.select(id), id, "left_anti")


def mark_deleted(rows: DataFrame, ids: DataFrame, id: str = "id", deleted: bool = True) -> DataFrame:
    """``rows`` with the column ``deleted`` set for some ids."""
    known = rows if "deleted" in rows.columns else rows.withColumn("deleted", F.lit(False))
    return known.join(ids.select(id).distinct().withColumn("__m", F.lit(True)), id, "left").withColumn("deleted", F.when(F.col("__m"), F.lit(deleted)).otherwise(F.col("deleted"))).drop("__m")


def live(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("deleted"))


def _sums(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]))).first()
    return int(row[0]), int(row[1] or 0)


def save(df: DataFrame, path: str, kind: str, by: str | None = None, order: tuple[str, ...] = ()) -> None:
    """A table as Parquet under ``path``, with a note of its kind, format, rows and check sum, which is written last."""
    spark = df.sparkSession
    remove(spark, f"{path}/about")
    dealt = df.repartition(by) if by else df
    writer = (dealt.sortWithinPartitions(*([by] if by else []), *order) if order else dealt).write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(f"{path}/data")
    rows, total = _sums(spark.read.parquet(f"{path}/data"))
    spark.createDataFrame([(kind, FORMAT, rows, total)], "kind string, format int, rows bigint, total bigint").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load(spark: SparkSession, path: str, kind: str, check: bool = True) -> DataFrame:
    """A saved table. A missing note, another kind or a later format is refused; with ``check``, so are rows other than those that were saved."""
    if not exists(spark, f"{path}/about/_SUCCESS"):
        raise ValueError(f"{path}: nothing was saved here, or not to the end")
    about = spark.read.json(f"{path}/about").first()
    if about is None or about["kind"] != kind:
        raise ValueError(f"{path} holds {about and about['kind']!r}, not {kind!r}")
    if about["format"] > FORMAT:
        raise ValueError(f"{path} has format {about['format']}, later than {FORMAT}")
    df = spark.read.parquet(f"{path}/data")
    if check and _sums(df) != (about["rows"], about["total"]):
        raise ValueError(f"{path} is corrupt: its rows are not those that were saved")
    return df


#: Nodes of a folder of a saved index.
NODES_A_FOLDER = 4096


def save_index(index: DataFrame, path: str) -> None:
    """The interval index, by blocks of nodes and sorted, so that a range reads few folders and row groups."""
    save(index.withColumn("block", F.floor(F.col("node") / NODES_A_FOLDER)), path, "interval index", "block", ("side", "node", "sub"))


def load_index(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, check: bool = False) -> DataFrame:
    """A saved index, or what a range needs of it; a whole check reads every row, so it is asked for."""
    df = load(spark, path, "interval index", check)
    if low is not None and high is not None:
        df = df.where(F.col("block").between(low // NODES_A_FOLDER, high // NODES_A_FOLDER))
    return df.drop("block")


def save_vectors(vectors: DataFrame, path: str) -> None:
    """A store of vectors, whatever its columns, in order of its first."""
    save(vectors, path, "vectors")


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, "vectors")


def save_graph(graph: DataFrame, path: str, with_distance: bool = True, text: bool = False) -> None:
    """A K-NN graph: as a table, without distances, or as text (a line a node: its position, then its neighbours', nearest first), which is not read back."""
    if text:
        lists = graph.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "nbr"))), lambda p: p["nbr"]).alias("n"))
        lists.select(F.concat_ws(" ", F.col("node").cast("string"), F.transform("n", lambda x: x.cast("string")))).write.mode("overwrite").text(path)
    else:
        save(graph if with_distance else graph.drop("dist"), path, "graph")


def load_graph(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    return load(spark, path, "graph", check)


@functools.cache
def code_version() -> str:
    """A hash of this package's code, so that what older code saved is not taken for what this code would save."""
    top, found = Path(__file__).resolve().parent.parent, hashlib.sha256()
    for part in ("operators", "functions", "plans"):
        for p in sorted((top / part).glob("*.py")):
            found.update(p.name.encode() + p.read_bytes())
    return found.hexdigest()


def kept(spark: SparkSession, name: str, stamp: str, build: Callable[[str], None]) -> str:
    """The path, in the shared folder, of something saved there for data of this stamp by this code; built and saved if it is not. It is built aside and renamed, so of two sessions that build at once one's is kept, whole."""
    path = f"{shared_folder(spark)}/kept/{name}-{hashlib.sha256(f'{FORMAT}|{code_version()}|{stamp}'.encode()).hexdigest()[:24]}"
    if not exists(spark, f"{path}/about/_SUCCESS"):
        aside = f"{path}-{uuid.uuid4().hex}"
        build(aside)
        if not rename(spark, aside, path):
            remove(spark, aside)
    return path


def append_rows(df: DataFrame, path: str) -> None:
    """Result rows added to a folder of CSV files."""
    df.write.mode("append").option("header", True).csv(path)


def integrity(index: DataFrame, k: int) -> DataFrame:
    """One row: how many rows there are, and how many are on the wrong side, have an impossible bound, are of the node itself, repeat, or exceed ``k`` for some range end that a row begins or ends at."""
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    left = F.col("side") == "L"
    own = index.agg(
        F.count(F.lit(1)).alias("n_rows"),
        count((left & (F.col("nbr") >= F.col("node"))) | (~left & (F.col("nbr") <= F.col("node")))).alias("wrong_side"),
        count((left & (F.col("sub") >= F.col("nbr"))) | (~left & (F.col("sub") <= F.col("nbr")))).alias("wrong_bound"),
        count(F.col("nbr") == F.col("node")).alias("own"),
    )
    repeated = index.groupBy("node", "nbr").count().agg(count(F.col("count") > 1).alias("repeated"))
    # Rows that hold at once: a running sum of beginnings less ends, outwards from the node.
    near, far = F.when(left, -F.col("nbr")).otherwise(F.col("nbr")), F.when(left, -F.col("sub")).otherwise(F.col("sub"))
    steps = index.select("node", "side", F.explode(F.array(F.struct(near.alias("at"), F.lit(1).alias("step")), F.struct(far.alias("at"), F.lit(-1).alias("step")))).alias("x")).groupBy("node", "side", "x.at").agg(F.sum("x.step").alias("step"))
    held = F.sum("step").over(Window.partitionBy("node", "side").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    crowded = steps.withColumn("held", held).agg(count(F.col("held") > k).alias("crowded"))
    return own.crossJoin(repeated).crossJoin(crowded)  # three single rows


def profile(index: DataFrame) -> DataFrame:
    """Per side: rows, nodes, rows that hold to the end, and the fewest, mean and most rows of a node."""
    per = index.groupBy("side", "node").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when((F.col("sub") == -1) | (F.col("sub") == 2**63 - 1), 1).otherwise(0)).alias("open"))
    return per.groupBy("side").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_nodes"), F.sum("open").alias("n_open"), F.min("n").alias("fewest"), F.avg("n").alias("mean"), F.max("n").alias("most"))
