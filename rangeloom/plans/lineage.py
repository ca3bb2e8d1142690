"""Cutting lineage where a plan would otherwise be computed again, and the folder that tasks share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the session's checkpoint folder; a temporary one of our own only where neither is set and the master is local."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if context.master.startswith("local-cluster") or not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="checkpoints-")
    return _OWN[context.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder's checkpoints."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """``df`` written to the checkpoints, and aggregates of its rows that were observed meanwhile."""
    seen = Observation()
    out = cut(df.observe(seen, *[c.alias(n) for n, c in figures.items()]))
    return out, seen.get


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """The folder or file, with all in it, if it is there."""
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    """Whether the folder has its new name now; not if something of that name is there."""
    fs, at = file_system(spark, path)
    new = file_system(spark, to)[1]
    return not fs.exists(new) and fs.rename(at, new)


def stamp(spark: SparkSession, path: str) -> str:
    """What tells a table's files from others: their names, lengths and times of change."""
    fs, at = file_system(spark, path)
    found = [fs.getFileStatus(at)]
    if found[0].isDirectory():
        found = list(fs.listStatus(at))
    return "|".join(sorted(f"{s.getPath().toString()}:{s.getLen()}:{s.getModificationTime()}" for s in found))
