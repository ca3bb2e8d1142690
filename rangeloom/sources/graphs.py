"""Graph files of native libraries, read by parts and written by many tasks.

K-NN graph files: eight letters, a version, a flag (without distances), the number of nodes, and for
each node how many neighbours count, how many there are, and these (number, distance, whether new; or numbers
alone). Records are of several lengths, so a pass over their heads finds where parts begin; a file
that is longer or shorter than its records, or of another kind or version, is refused.

Layered graph files: a head of fixed size; a record of fixed size a node (its lowest links, deletion mark,
vector, label); then each node's upper links, of several lengths. The lowest layer is read by seeking, the
upper ones from a pass over their lengths; the length of all must be the file's.

Links of layered files have no distances; those of the tables written are dropped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..plans.lineage import cut
from .sinks import opened, write_placed

#: The end of a row that holds for every range end, in the index.
OPEN = 2**63 - 1

#: A graph file's first letters, its version and the flag of a file without distances.
MAGIC, VERSION, NO_DISTANCE = b"KNNGRAPH", 2, 1
_HEAD = "<8sIII"
_HEAD_BYTES = struct.calcsize(_HEAD)
_ENTRY = np.dtype([("nbr", "<u4"), ("dist", "<f4"), ("new", "u1"), ("pad", "V3")])
#: Bytes of a part of a file, about, and of what a pass over heads reads at a time.
PART_BYTES, PASS_BYTES = 32 << 20, 8 << 20
#: Nodes whose bytes are summed together to find where each is written.
NODES_A_BLOCK = 4096


class _Part(InputPartition):
    def __init__(self, offset: int, past: int, first: int, count: int, kind: str = ""):
        self.offset, self.past, self.first, self.count, self.kind = offset, past, first, count, kind


def _passed(f, offset: int, size: int, count: int, lead: int, length, part_bytes: int, kind: str = "") -> tuple[list[_Part], int]:
    """Parts of ``count`` records from ``offset`` on, whose first ``lead`` bytes tell their length, and where the last ends. ValueError if the file ends before."""
    parts, at, first, began = [], offset, 0, offset
    window, start = b"", offset
    for k in range(count):
        if at + lead > size:
            raise ValueError(f"the file is cut: record {k} of {count} is missing")
        if not start <= at <= at + lead <= start + len(window):
            f.seek(at)
            window, start = f.read(PASS_BYTES), at
        at += length(window, at - start)
        if at > size:
            raise ValueError(f"the file is cut in record {k} of {count}")
        if at - began >= part_bytes:
            parts.append(_Part(began, at, first, k + 1 - first, kind))
            began, first = at, k + 1
    if first < count:
        parts.append(_Part(began, at, first, count - first, kind))
    return parts, at


class _GraphReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, part_bytes = options["path"], int(options.get("part_bytes", PART_BYTES))
        fs, inner = opened(self.path)
        size = fs.get_file_info(inner).size or 0
        with fs.open_input_file(inner) as f:
            head = f.read(_HEAD_BYTES)
            if len(head) < _HEAD_BYTES:
                raise ValueError(f"{self.path}: the file is cut in its head")
            magic, version, flags, count = struct.unpack(_HEAD, head)
            if magic != MAGIC:
                raise ValueError(f"{self.path} is no K-NN graph")
            if version != VERSION:
                raise ValueError(f"{self.path} has version {version}, not {VERSION}")
            if flags & ~NO_DISTANCE:
                raise ValueError(f"{self.path} has unknown flags {flags}")
            self.bare = bool(flags & NO_DISTANCE)
            self.width = 4 if self.bare else _ENTRY.itemsize
            self.parts, end = _passed(f, _HEAD_BYTES, size, count, 8, lambda w, k: 8 + struct.unpack_from("<I", w, k + 4)[0] * self.width, part_bytes)
        if end != size:
            raise ValueError(f"{self.path}: {size - end} bytes behind the last node")

    def partitions(self):
        return self.parts or [_Part(0, 0, 0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        fs, inner = opened(self.path)
        with fs.open_input_file(inner) as f:
            f.seek(partition.offset)
            blob = f.read(partition.past - partition.offset)
        at, used, sizes, entries = 0, [], [], []
        for _ in range(partition.count):
            m, k = struct.unpack_from("<II", blob, at)
            entries.append(blob[at + 8 : at + 8 + k * self.width])
            used.append(m)
            sizes.append(k)
            at += 8 + k * self.width
        sizes = np.array(sizes, dtype=np.int64)
        own = np.frombuffer(b"".join(entries), dtype="<u4" if self.bare else _ENTRY)
        node = np.repeat(np.arange(partition.first, partition.first + partition.count), sizes)
        rank = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        nbr = own if self.bare else own["nbr"]
        dist = pa.nulls(len(own), pa.float64()) if self.bare else pa.array(own["dist"].astype(np.float64))
        new = pa.nulls(len(own), pa.bool_()) if self.bare else pa.array(own["new"] != 0)
        columns = [pa.array(node), pa.array(nbr.astype(np.int64)), dist, pa.array(rank.astype(np.int32)), new, pa.array(np.repeat(np.array(used, dtype=np.int32), sizes))]
        for k in range(0, len(own), 1 << 16):
            yield pa.RecordBatch.from_arrays([c.slice(k, 1 << 16) for c in columns], names=["node", "nbr", "dist", "rank", "is_new", "m"])


class GraphSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "knn_graph"

    def schema(self) -> str:
        return "node bigint, nbr bigint, dist double, rank int, is_new boolean, m int"

    def reader(self, schema) -> _GraphReader:
        return _GraphReader(dict(self.options))


def read_graph(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """node, nbr, dist (null where the file has none), rank, is_new, m (how many of the node's neighbours count) of a K-NN graph file."""
    spark.dataSource.register(GraphSource)
    return spark.read.format("knn_graph").options(path=path, part_bytes=str(part_bytes)).load()


def _at(records: DataFrame, head: int) -> tuple[DataFrame, int]:
    """``records`` (node, size) with the offset of each, in order of node behind ``head`` bytes, and the length of all."""
    blocked = records.withColumn("block", F.floor(F.col("node") / NODES_A_BLOCK))
    sums = blocked.groupBy("block").agg(F.sum("size").alias("bytes"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    base = sums.withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0)) + head).drop("bytes")
    within = Window.partitionBy("block").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    found = blocked.join(base, "block").withColumn("offset", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))).drop("block", "base")
    total = sums.agg(F.sum("bytes")).first()[0] or 0
    return found, int(total) + head


def write_graph(graph: DataFrame, path: str, nodes: int | None = None, with_distance: bool = True) -> None:
    """A graph (node, nbr, dist, rank; is_new and m if it has them) of nodes from 0 on as one file; nodes without a neighbour have a record, too."""
    spark, graph = graph.sparkSession, cut(graph)
    own = graph.withColumns({c: v for c, v in {"is_new": F.lit(False), "m": F.lit(None).cast("int")}.items() if c not in graph.columns})
    lists = own.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rank", "nbr", "dist", "is_new"))).alias("n"), F.max("m").alias("m"))
    if nodes is None:
        nodes = int(graph.agg(F.max(F.greatest("node", "nbr"))).first()[0] if not graph.isEmpty() else -1) + 1
    every = cut(spark.range(nodes).select(F.col("id").alias("node")).join(lists, "node", "left").select("node", F.coalesce(F.size("n"), F.lit(0)).alias("k"), "n", "m"))
    width = _ENTRY.itemsize if with_distance else 4
    found, total = _at(every.select("node", (F.greatest("k", F.lit(0)) * width + 8).cast("bigint").alias("size")), _HEAD_BYTES)
    head = spark.createDataFrame([(0, struct.pack(_HEAD, MAGIC, VERSION, 0 if with_distance else NO_DISTANCE, nodes))], "offset bigint, bytes binary")

    def run(batches):
        for batch in batches:
            blobs = []
            for n, m in zip(batch.column("n").to_pylist(), batch.column("m").to_pylist(), strict=True):
                n = n or []
                lead = struct.pack("<II", len(n) if m is None else m, len(n))
                ids = np.array([x["nbr"] for x in n], dtype="<u4")
                if with_distance:
                    entries = np.zeros(len(n), dtype=_ENTRY)
                    entries["nbr"], entries["dist"], entries["new"] = ids, [x["dist"] for x in n], [bool(x["is_new"]) for x in n]
                    ids = entries
                blobs.append(lead + ids.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("offset"), pa.array(blobs, pa.binary())], names=["offset", "bytes"])

    body = every.join(found, "node").select("offset", "n", "m").mapInArrow(run, "offset bigint, bytes binary")
    write_placed(head.unionByName(body), path, total)


#: A layered file's head (offset of links, room, nodes, bytes a node, offset of the label, offset of the vector, highest level, door, neighbours above, neighbours below, M, level factor, candidates) and the deletion mark.
_LAYERED, DELETED = "<QQQQQQiIQQQdQ", 1
_LAYERED_BYTES = struct.calcsize(_LAYERED)


class _LayeredReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.links, part_bytes = options["path"], options["part"] == "links", int(options.get("part_bytes", PART_BYTES))
        fs, inner = opened(self.path)
        size = fs.get_file_info(inner).size or 0
        with fs.open_input_file(inner) as f:
            head = f.read(_LAYERED_BYTES)
            if len(head) < _LAYERED_BYTES:
                raise ValueError(f"{self.path}: the file is cut in its head")
            first, _, self.count, self.stride, self.label, self.data, top, _, self.above, self.below, _, _, _ = struct.unpack(_LAYERED, head)
            if first or self.data != 4 + 4 * self.below or self.label < self.data or self.stride != self.label + 8 or (self.label - self.data) % 4:
                raise ValueError(f"{self.path} is no layered graph of this layout")
            upper = _LAYERED_BYTES + self.count * self.stride
            if upper > size:
                raise ValueError(f"{self.path}: the file is cut in its lowest layer")
            room = 4 + 4 * self.above

            def length(window, k):
                n = struct.unpack_from("<I", window, k)[0]
                if n % room or n > room * max(top, 0):
                    raise ValueError(f"{self.path}: a node has {n} bytes of upper links")
                return 4 + n

            above, end = _passed(f, upper, size, self.count, 4, length, part_bytes, "upper")
            if end != size:
                raise ValueError(f"{self.path}: {size - end} bytes behind the last node")
        step = max(1, part_bytes // self.stride)
        self.parts = [_Part(_LAYERED_BYTES + k * self.stride, 0, k, min(step, self.count - k), "base") for k in range(0, self.count, step)]
        # The upper part tells a node's links there, and its highest level.
        self.parts += above if self.links else []

    def partitions(self):
        return self.parts or [_Part(0, 0, 0, 0)]

    def _rows(self, level, node, lists, counts) -> Iterator[pa.RecordBatch]:
        on = np.arange(lists.shape[1]) < counts[:, None]
        r, c = np.nonzero(on)
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(level)[r].astype(np.int32)), pa.array(node[r]), pa.array(lists[r, c].astype(np.int64)), pa.array((c + 1).astype(np.int32))], names=["level", "node", "nbr", "rank"])

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        fs, inner = opened(self.path)
        with fs.open_input_file(inner) as f:
            f.seek(partition.offset)
            blob = f.read(partition.count * self.stride if partition.kind == "base" else partition.past - partition.offset)
        node = np.arange(partition.first, partition.first + partition.count)
        if partition.kind == "upper":
            room, at, level, of, raw = 4 + 4 * self.above, 0, [], [], []
            for k in range(partition.count):
                n = struct.unpack_from("<I", blob, at)[0] // room
                level += range(1, n + 1)
                of += [partition.first + k] * n
                raw.append(blob[at + 4 : at + 4 + n * room])
                at += 4 + n * room
            own = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(-1, room)
            if len(own):
                yield from self._rows(level, np.array(of), own[:, 4:].copy().view("<u4"), own[:, :2].copy().view("<u2")[:, 0])
            return
        own = np.frombuffer(blob, dtype=np.uint8).reshape(partition.count, self.stride)
        counts = own[:, :2].copy().view("<u2")[:, 0]
        if self.links:
            yield from self._rows(np.zeros(len(node)), node, own[:, 4 : 4 + 4 * self.below].copy().view("<u4"), counts)
            return
        x = own[:, self.data : self.label].copy().view("<f4")
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(own[:, self.label :].copy().view("<i8")[:, 0]), lists, pa.array((own[:, 2] & DELETED) != 0)], names=["pos", "id", "embedding", "deleted"])


class LayeredSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "layered_graph"

    def schema(self) -> str:
        return "level int, node bigint, nbr bigint, rank int" if self.options["part"] == "links" else "pos bigint, id bigint, embedding array<float>, deleted boolean"

    def reader(self, schema) -> _LayeredReader:
        return _LayeredReader(dict(self.options))


def read_layered(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """A layered graph file's vectors (pos, id, embedding, deleted) and links (level, node, nbr, rank)."""
    spark.dataSource.register(LayeredSource)
    return tuple(spark.read.format("layered_graph").options(path=path, part=part, part_bytes=str(part_bytes)).load() for part in ("nodes", "links"))


def write_layered(layers: DataFrame, vectors: DataFrame, path: str, m: int, candidates: int = 200) -> None:
    """A graph (level, node, nbr, dist) of vectors (pos from 0 on, embedding; id and deleted if they have them) as one file of at most ``m`` neighbours a node, and twice as many on the lowest level."""
    spark = vectors.sparkSession
    own = vectors.withColumns({c: v for c, v in {"id": F.col("pos"), "deleted": F.lit(False)}.items() if c not in vectors.columns}).select(F.col("pos").cast("bigint").alias("node"), F.col("id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), "deleted")
    n, dim = own.count(), len((own.select("embedding").first() or [[]])[0])
    lists = layers.groupBy("node", "level").agg(F.array_sort(F.collect_list(F.struct("dist", "nbr"))).alias("n"))
    nested = lists.groupBy("node").agg(F.collect_list(F.struct("level", F.transform("n", lambda x: x["nbr"]).alias("n"))).alias("links"), F.max("level").alias("top"))
    every = cut(own.join(nested, "node", "left").withColumn("top", F.coalesce("top", F.lit(0))))
    ends = every.agg(F.max("top"), F.max_by("node", F.struct("top", -F.col("node")))).first()
    room, stride = 4 + 4 * m, 4 + 8 * m + 4 * dim + 8
    label, data = stride - 8, 4 + 8 * m
    start = _LAYERED_BYTES + n * stride
    found, total = _at(every.select("node", (4 + F.col("top") * room).cast("bigint").alias("size")), start)
    head = struct.pack(_LAYERED, 0, n, n, stride, label, data, int(ends[0]) if n else -1, int(ends[1]) if n else 2**32 - 1, m, 2 * m, m, 1 / np.log(m), candidates)

    def block(links, most, deleted=False):
        if len(links) > most:
            raise ValueError(f"a node has {len(links)} neighbours, more than {most}")
        return struct.pack("<HBB", len(links), DELETED if deleted else 0, 0) + np.array(links, dtype="<u4").tobytes().ljust(4 * most, b"\0")

    def run(batches):
        for batch in batches:
            at, blobs = [], []
            for r in batch.to_pylist():
                by_level = {x["level"]: x["n"] for x in r["links"] or []}
                at += [_LAYERED_BYTES + r["node"] * stride, r["offset"]]
                blobs.append(block(by_level.get(0, []), 2 * m, r["deleted"]) + np.array(r["embedding"], dtype="<f4").tobytes() + struct.pack("<q", r["id"]))
                blobs.append(struct.pack("<I", r["top"] * room) + b"".join(block(by_level.get(k, []), m) for k in range(1, r["top"] + 1)))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(blobs, pa.binary())], names=["offset", "bytes"])

    body = every.join(found.select("node", "offset"), "node").select("node", "id", "embedding", "deleted", "links", "top", "offset").mapInArrow(run, "offset bigint, bytes binary")
    write_placed(spark.createDataFrame([(0, head)], "offset bigint, bytes binary").unionByName(body), path, total)


def write_index_text(index: DataFrame, path: str, nodes: int) -> None:
    """An interval index as text files, a line a node in order: ``nbr sub,nbr sub,...;nbr sub,...``, left rows then right ones, each from the farthest key on; -1 and the number of nodes stand for open ends."""
    side = lambda s: F.transform(F.array_sort(F.filter("rows", lambda x: x["side"] == s)), lambda x: F.concat(x["nbr"].cast("string"), F.lit(" "), F.least(x["sub"], F.lit(nodes)).cast("string"), F.lit(",")))
    rows = index.groupBy("node").agg(F.collect_list(F.struct(F.when(F.col("side") == "L", F.col("nbr")).otherwise(-F.col("nbr")).alias("order"), "side", "nbr", "sub")).alias("rows"))
    every = index.sparkSession.range(nodes).select(F.col("id").alias("node")).join(rows, "node", "left").withColumn("rows", F.coalesce("rows", F.array().cast("array<struct<order:bigint,side:string,nbr:bigint,sub:bigint>>")))
    lines = every.select("node", F.concat(F.array_join(side("L"), ""), F.lit(";"), F.array_join(side("R"), "")).alias("value"))
    lines.repartitionByRange("node").sortWithinPartitions("node").select("value").write.mode("overwrite").text(path)


def read_index_text(spark: SparkSession, path: str, nodes: int) -> DataFrame:
    """The rows of ``write_index_text``'s files: node, side, nbr, sub. Lines are numbered across the files, in order of their names: each part's lines are counted, and the parts before it added."""
    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))
    lines = cut(spark.read.text(path).select("value", split.alias("split"), F.monotonically_increasing_id().alias("id")))
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row a split of a file
    base = lines.groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    numbered = lines.withColumn("at", F.row_number().over(Window.partitionBy("split").orderBy("id")) - 1).join(base, "split").select((F.col("base") + F.col("at")).alias("node"), F.split("value", ";").alias("sides"))
    bad = F.raise_error(F.lit("a line of an index file has no two sides"))
    sided = numbered.select("node", F.posexplode(F.when(F.size("sides") == 2, F.col("sides")).otherwise(bad)).alias("k", "pairs")).select("node", F.when(F.col("k") == 0, "L").otherwise("R").alias("side"), F.explode(F.filter(F.split("pairs", ","), lambda x: x != "")).alias("pair"))
    nbr, sub = (F.element_at(F.split("pair", " "), k).cast("bigint") for k in (1, 2))
    return sided.select("node", "side", nbr.alias("nbr"), F.when((F.col("side") == "R") & (sub >= nodes), OPEN).otherwise(sub).alias("sub"))
