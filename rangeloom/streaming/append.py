"""Keeping an interval index up to date from a stream of vectors with growing keys.

Each micro-batch is ordered by key and its vectors get the next positions. A batch writes only what is new:
its vectors, the rows that can change no more, and the open right rows (a node's K nearest on that side) of
the nodes that it reached; of a node's open rows the newest batch's hold. A note of the batch, with the number
of vectors and the largest key so far, is written last, so a batch that is lost halfway, or comes again,
changes nothing twice, and the next one need not read the vectors to go on.

Every ``compact_every`` batches their folders are merged into one, as many of those into a larger one, and so
on: of n batches fewer than ``compact_every`` folders of each of log n sizes are read, by one scan a kind, and
a row is written anew log n times. Which folders count follows from the number of notes alone. Merged
ones stay for readers that hold older plans, until ``vacuum``.

Keys must come in order: a batch with a key below the largest so far is refused, since it would move
positions. Vectors that cannot be compared keep a position and have no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators import interval_index
from ..operators.keys import rank
from ..plans.lineage import cut, file_system, remove

COMPACT_EVERY = 16
OPEN_SCHEMA = interval_index.SCHEMA + ", batch bigint"


class Maintainer:
    """The vectors and the index under ``path``, after the newest batch."""

    def __init__(self, spark: SparkSession, path: str, k: int, compact_every: int = COMPACT_EVERY):
        if compact_every < 2:
            raise ValueError("at least two folders are merged at a time")
        self.spark, self.path, self.k, self.compact_every = spark, path.rstrip("/"), k, compact_every

    def _notes(self) -> list[tuple[int, int]]:
        """Ordinal and version of the batches that are done."""
        fs, at = file_system(self.spark, f"{self.path}/done")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted((int(n.split("-")[0]), int(n.split("-", 1)[1])) for n in names)

    def _versions(self) -> list[tuple[int, bool]]:
        """The batches that are done, and whether folders were merged with each."""
        return [(version, (o + 1) % self.compact_every == 0) for o, version in self._notes()]

    def _live(self, n: int) -> list[str]:
        """The folders that hold the first ``n`` batches, each named by its level and its last batch."""
        size, level = 1, 0
        while size * self.compact_every <= n:
            size, level = size * self.compact_every, level + 1
        out, at = [], 0
        while at < n:
            while at + size > n:
                size, level = size // self.compact_every, level - 1
            at += size
            out.append(f"{level}-{at - 1}")
        return out

    def _scan(self, what: str, folders: list[str], schema: str) -> DataFrame:
        """One scan of the folders, however many they are."""
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{what}/{f}" for f in folders])

    def _vectors_schema(self) -> str:
        live = self._live(len(self._notes()))
        if not live:
            return "pos bigint, id bigint, search_key bigint, embedding array<float>"
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.spark.read.parquet(f"{self.path}/vectors/{live[0]}").schema)

    def vectors(self) -> DataFrame:
        return self._scan("vectors", self._live(len(self._notes())), self._vectors_schema())

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        return rows.withColumn("newest", F.max("batch").over(Window.partitionBy("node"))).where("batch = newest").drop("newest")

    def _open(self) -> DataFrame:
        rows = self._newest(self._scan("open", self._live(len(self._notes())), OPEN_SCHEMA))
        return rows.where(F.col("nbr").isNotNull()).drop("batch")

    def index(self) -> DataFrame:
        closed = self._scan("closed", self._live(len(self._notes())), interval_index.SCHEMA)
        return closed.unionByName(self._open())

    def _merge(self, ordinal: int, vectors_schema: str) -> None:
        """The folders that end with a batch, of each level that it completes."""
        step, level = 1, 0
        while (ordinal + 1) % (step * self.compact_every) == 0:
            parts = [f"{level}-{ordinal - step * k}" for k in reversed(range(self.compact_every))]
            level, step = level + 1, step * self.compact_every
            for what, schema in (("vectors", vectors_schema), ("closed", interval_index.SCHEMA), ("open", OPEN_SCHEMA)):
                rows = self._scan(what, parts, schema)
                (self._newest(rows) if what == "open" else rows).write.mode("overwrite").parquet(f"{self.path}/{what}/{level}-{ordinal}")

    def add(self, batch: DataFrame, version: int) -> None:
        """Add rows (id, search_key, embedding) as batch number ``version``."""
        notes = self._notes()
        if version in (v for _, v in notes):
            return
        ordinal, name = len(notes), f"0-{len(notes)}"
        n, key = self.spark.read.parquet(f"{self.path}/done/{notes[-1][0]}-{notes[-1][1]}").first() if notes else (0, None)
        fresh = cut(rank(batch.select("id", "search_key", "embedding"), "search_key", "id").select((F.col("pos") + F.lit(n)).cast("bigint").alias("pos"), "id", "search_key", "embedding"))
        came = fresh.agg(F.count(F.lit(1)).alias("n"), F.min("search_key").alias("least"), F.max("search_key").alias("most"))
        m, least, _ = came.first()
        if key is not None and least is not None and least < key:
            raise ValueError(f"a key of batch {version}, {least!r}, is below {key!r}: keys must come in order")
        old = self.vectors()
        fresh.write.mode("overwrite").parquet(f"{self.path}/vectors/{name}")
        rows = cut(interval_index.appended(self._open(), old, fresh, self.k)) if m else self.spark.createDataFrame([], interval_index.SCHEMA)
        rows.where(~interval_index.is_open()).write.mode("overwrite").parquet(f"{self.path}/closed/{name}")
        # A node whose open rows all closed is noted as having none.
        now = rows.where(interval_index.is_open())
        none = rows.select("node").distinct().join(now.select("node"), "node", "left_anti")
        empty = none.select("node", *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in interval_index.SCHEMA.split(", ")[1:]])
        now.unionByName(empty).withColumn("batch", F.lit(ordinal).cast("bigint")).write.mode("overwrite").parquet(f"{self.path}/open/{name}")
        self._merge(ordinal, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fresh.schema))
        note = came.select((F.col("n") + F.lit(n)).alias("n"), F.coalesce("most", F.lit(key).cast(fresh.schema["search_key"].dataType)).alias("key"))
        note.write.mode("overwrite").parquet(f"{self.path}/done/{ordinal}-{version}")

    def vacuum(self) -> int:
        """Remove the folders whose rows are in merged ones, and those of batches that were lost; how many. No reader may hold an older plan, and no batch be under way."""
        live, gone = set(self._live(len(self._notes()))), 0
        for what in ("vectors", "closed", "open"):
            fs, at = file_system(self.spark, f"{self.path}/{what}")
            for name in [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []:
                if name not in live:
                    remove(self.spark, f"{self.path}/{what}/{name}")
                    gone += 1
        return gone

    def start(self, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Follow a streaming DataFrame (id, search_key, embedding)."""
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.add)
        return (writer.trigger(availableNow=True) if once else writer).start()
