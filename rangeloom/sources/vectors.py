"""Reading and writing vector sets.

Rows come in file order; "the first n" of a text file are its first lines. A line that is empty is no row; a
number that cannot be read is a null component, which the operators leave out with its vector.

Text layouts go through Spark's own readers. The binary layouts (records of a dimension and that many
floats or bytes; a headed matrix; raw rows) are a Python data source, ``vectors``, whose partitions seek
to their own records, so a large file is read by many tasks. Its files must be where executors can
open them: a shared mount, or any store that pyarrow reads by URI.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .sinks import LAYOUTS, opened, write_folder

RECORDS_A_PART = 100_000


class _Part(InputPartition):
    def __init__(self, first: int, past: int):
        self.first, self.past = first, past


class _Reader(DataSourceReader):
    def __init__(self, options: dict, first: int = 0):
        self.path, self.layout, self.first = options["path"], options.get("layout", "fvecs"), first
        self.limit = int(options.get("limit", -1))
        fs, inner = opened(self.path)
        size = fs.get_file_info(inner).size
        with fs.open_input_file(inner) as f:
            self.head = 0
            if self.layout in ("fvecs", "bvecs"):
                self.lead = 4
                self.dim = struct.unpack("<i", f.read(4))[0] if size >= 4 else 0
                self.type = np.dtype("<f4" if self.layout == "fvecs" else "u1")
                self.record = 4 + self.dim * self.type.itemsize
            elif self.layout == "lshkit":
                width, _, self.dim = struct.unpack("<III", f.read(12))
                self.type = np.dtype({4: "<f4", 8: "<f8", 1: "u1"}[width])
                self.head, self.lead, self.record = 12, 0, self.dim * width
            elif self.layout == "raw":
                self.dim, self.head, self.lead = int(options["dim"]), int(options.get("skip", 0)), 0
                self.type = np.dtype("<f4")
                self.record = self.dim * 4 + int(options.get("gap", 0))
            else:
                raise ValueError(f"unknown layout {self.layout!r}")
        body = size - self.head
        # A raw file's last row may lack its gap.
        tail = int(options.get("gap", 0)) if self.layout == "raw" else 0
        self.count = (body + tail) // self.record if self.record and body > 0 else 0
        if self.record and self.layout != "raw" and body % self.record:
            raise ValueError(f"{self.path}: {body} bytes are no whole number of records of {self.record}")
        if self.limit >= 0:
            self.count = min(self.count, self.limit)

    def partitions(self):
        return [_Part(k, min(k + RECORDS_A_PART, self.count)) for k in range(0, self.count, RECORDS_A_PART)] or [_Part(0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        fs, inner = opened(self.path)
        with fs.open_input_file(inner) as f:
            step = max(1, (8 << 20) // max(self.record, 1))
            for first in range(partition.first, partition.past, step):
                n = min(step, partition.past - first)
                f.seek(self.head + first * self.record)
                raw = np.frombuffer(f.read(n * self.record).ljust(n * self.record, b"\0"), dtype=np.uint8).reshape(n, self.record)
                if self.lead and (raw[:, :4].copy().view("<i4") != self.dim).any():
                    raise ValueError(f"{self.path}: records of several dimensions")
                values = raw[:, self.lead : self.lead + self.dim * self.type.itemsize].copy().view(self.type).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, max(self.dim, 1)), pa.int32()), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n) + self.first, pa.int64()), lists], names=["pos", "embedding"])


class _Folder(DataSourceReader):
    """The files of a folder, in order of their names, one after the other."""

    def __init__(self, options: dict, paths: list[str]):
        self.readers, limit = [], int(options.get("limit", -1))
        for path in paths:
            first = self.readers[-1].first + self.readers[-1].count if self.readers else 0
            left = {} if limit < 0 else {"limit": str(max(limit - first, 0))}
            self.readers.append(_Reader({**options, "path": path, **left}, first))

    def partitions(self):
        parts = []
        for k, reader in enumerate(self.readers):
            for p in reader.partitions():
                p.file = k
                parts.append(p)
        return parts or [_Part(0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if self.readers:
            yield from self.readers[partition.file].read(partition)


class VectorSource(DataSource):
    """``spark.read.format("vectors").option("layout", ...)``: pos, embedding."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return "pos bigint, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        fs, inner = opened(options["path"])
        if fs.get_file_info(inner).type != pafs.FileType.Directory:
            return _Reader(options)
        lead = options["path"][: len(options["path"]) - len(inner)] if options["path"].endswith(inner) else ""
        found = fs.get_file_info(pafs.FileSelector(inner))
        return _Folder(options, [lead + f.path for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))])


def binary(spark: SparkSession, path: str, layout: str, limit: int = -1, **options) -> DataFrame:
    """pos, embedding of a binary file, or of a folder of such files: fvecs, bvecs, lshkit, or raw (dim, skip, gap)."""
    spark.dataSource.register(VectorSource)
    df = spark.read.format("vectors").options(layout=layout, limit=str(limit), **{k: str(v) for k, v in options.items()}).load(path)
    return df


def _floats(parts):
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: x.cast("float"))


def _limited(df: DataFrame, limit: int) -> DataFrame:
    """The first rows in file order."""
    return df if limit < 0 else df.withColumn("__line", F.monotonically_increasing_id()).orderBy("__line").limit(limit).drop("__line")


def dense_text(spark: SparkSession, path: str, limit: int = -1) -> DataFrame:
    """embedding: one vector a line, numbers between blanks."""
    return _limited(spark.read.text(path).where("trim(value) <> ''").select(_floats(F.split("value", " ")).alias("embedding")), limit)


def word_text(spark: SparkSession, path: str, limit: int = -1) -> DataFrame:
    """id, embedding: a word, then its vector, between blanks."""
    parts = F.split("value", " ")
    return _limited(spark.read.text(path).where("trim(value) <> ''").select(F.get(parts, F.lit(0)).alias("id"), _floats(F.slice(parts, 2, F.size(parts))).alias("embedding")), limit)


def tsv(spark: SparkSession, path: str, limit: int = -1) -> DataFrame:
    """id, embedding: a header line, then an id and its vector between tabs."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    first, *rest = df.columns
    return _limited(df.select(F.col(f"`{first}`").alias("id"), F.array(*[F.col(f"`{c}`").cast("float") for c in rest]).alias("embedding")), limit)


def keyed_csv(spark: SparkSession, path: str, header: bool = False, limit: int = -1) -> DataFrame:
    """id, search_key, embedding: an id, a whole-number key, and a quoted vector with blanks. All values are read."""
    df = spark.read.option("header", header).option("quote", '"').csv(path).toDF("id", "key", "v")
    return _limited(df.select("id", F.col("key").cast("bigint").alias("search_key"), _floats(F.split(F.trim("v"), " +")).alias("embedding")), limit)


#: Names of public vector sets and the layouts they come in.
DATASETS = {"local": "fvecs", "deep1b": "fvecs", "deep10m": "fvecs", "sift": "bvecs", "glove": "word", "ml25m": "text", "biggraph": "tsv", "yt8m": "csv"}


def read(spark: SparkSession, dataset: str, path: str, limit: int = -1, **options) -> DataFrame:
    """A named set's file, or any file by the name of its layout; ``raw`` needs ``dim`` and takes ``skip`` and ``gap``."""
    layout = DATASETS.get(dataset, dataset)
    if layout == "raw" and "dim" not in options:
        raise ValueError("the layout raw needs dim, the numbers of a vector")
    if layout in ("fvecs", "bvecs", "lshkit", "raw"):
        return binary(spark, path, layout, limit, **options)
    readers = {"text": dense_text, "word": word_text, "tsv": tsv, "csv": keyed_csv}
    if layout not in readers:
        raise ValueError(f"unknown dataset or layout {dataset!r}; known: {sorted({*DATASETS, *DATASETS.values(), 'lshkit', 'raw'})}")
    return readers[layout](spark, path, limit=limit)


def truth_lists(spark: SparkSession, path: str) -> DataFrame:
    """ids of each line of a ground-truth text file."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.transform(F.split(F.trim("value"), " +"), lambda x: x.cast("bigint")).alias("nbrs"))


def truth_queries(spark: SparkSession, path: str) -> DataFrame:
    """qid, l, r, nbrs: range queries with their true neighbours in the seventh column."""
    df = spark.read.option("quote", '"').csv(path)
    c = df.columns
    return df.select(F.col(c[0]).cast("int").alias("qid"), F.col(c[1]).cast("bigint").alias("l"), F.col(c[2]).cast("bigint").alias("r"), F.transform(F.split(F.trim(F.col(c[6])), " +"), lambda x: x.cast("bigint")).alias("nbrs"))


def write_text(vectors: DataFrame, path: str) -> None:
    """One vector a line, numbers between blanks."""
    vectors.select(F.concat_ws(" ", F.transform("embedding", lambda x: x.cast("string")))).write.mode("append").text(path)


def write_truth(graph: DataFrame, path: str) -> None:
    """A K-NN graph (node, nbr, rank) added as lines of ground truth: the node, then its neighbours, nearest first."""
    lists = graph.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "nbr"))), lambda p: p["nbr"].cast("string")).alias("n"))
    lists.orderBy("node").select(F.concat_ws(" ", F.col("node").cast("string"), "n")).write.mode("append").text(path)


def write_matrix(vectors: DataFrame, path: str, layout: str = "lshkit") -> None:
    """Vectors (pos, embedding) in order of position as a folder of headed matrices, fvecs or bvecs files, which ``binary`` reads as one. The folder's old files stay until all new ones are there."""
    if layout not in LAYOUTS:
        raise ValueError(f"cannot write layout {layout!r}")
    write_folder(vectors, path, layout)


def noisy(vectors: DataFrame, noise: float, seed: int = 1) -> DataFrame:
    """Vectors (pos, embedding) with Gaussian noise of ``noise`` times the standard deviation of all their numbers, drawn by position and place (the same when drawn again)."""
    spread = float(vectors.select(F.explode("embedding").alias("x")).agg(F.stddev_pop("x")).first()[0] or 0)
    # Two uniform numbers make one normal.
    uniform = lambda k, s: (F.pmod(F.xxhash64("pos", k, F.lit(2 * seed + s)), F.lit(1 << 40)) + 1) / float(1 << 40)
    normal = lambda k: F.sqrt(-2 * F.log(uniform(k, 0))) * F.cos(2 * math.pi * uniform(k, 1))
    return vectors.withColumn("embedding", F.transform("embedding", lambda x, k: (x + normal(k) * (noise * spread)).cast("float")))


def synthetic(spark: SparkSession, n: int, dimensions: int, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """pos, embedding: ``n`` vectors uniform in (-1, 1), and Gaussian noise of ``noise`` times the standard deviation of all their numbers."""
    plain = [F.rand(seed * 1000 + k) * 2 - 1 for k in range(dimensions)]
    spread = 0.0
    if noise and n and dimensions:
        numbers = spark.range(n).select(F.explode(F.array(*plain)).alias("x"))
        spread = float(numbers.agg(F.stddev_pop("x")).first()[0])
    values = [(c + (F.randn(seed * 1000 + 500 + k) * (noise * spread) if noise else F.lit(0.0))).cast("float") for k, c in enumerate(plain)]
    return spark.range(n).select(F.col("id").alias("pos"), F.array(*values).alias("embedding"))


def synthetic_queries(vectors: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """qid, embedding: each dimension of a query from a vector drawn for it."""
    spark = vectors.sparkSession
    many = vectors.count()
    first = vectors.select(F.size("embedding").alias("d")).first()
    if not many:
        return spark.range(0).select(F.col("id").alias("qid"), F.array().cast("array<float>").alias("embedding"))
    wanted = spark.range(n).select(F.col("id").alias("qid"), F.explode(F.sequence(F.lit(0), F.lit(first["d"] - 1))).alias("k"))
    wanted = wanted.withColumn("pos", F.pmod(F.xxhash64("qid", "k", F.lit(seed)), F.lit(many)))
    drawn = wanted.join(vectors.select("pos", "embedding"), "pos").select("qid", "k", F.element_at("embedding", F.col("k") + 1).alias("x"))
    return drawn.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("embedding"))
