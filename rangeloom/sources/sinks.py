"""Binary files written whole or not at all, by Spark data sources.

``folder``: the tasks write files of their own beside the target, and the commit puts them in the place of what
was there before; when a task or the job fails, the old files stay and the new ones go. A task that comes again
writes files of another name, of which the commit takes the last attempt's alone.

``placed``: one file of a known length, rows (offset, bytes) of which each task writes at their places in a file
beside the target, which the commit renames. Writing a row twice changes nothing. It needs a folder that all executors
mount, as a single file that many write at once does anywhere.
"""

from __future__ import annotations

import os
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes of a file of a layout whose header tells its rows; such a file is held until it is written.
FILE_BYTES = 64 << 20
LAYOUTS = ("lshkit", "fvecs", "bvecs")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path and not path.startswith("file://"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file://")


@dataclass
class Written(WriterCommitMessage):
    """The files of a task."""

    names: list[str]


class _Folder(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.layout, self.dim = options["path"].rstrip("/"), options["layout"], int(options["dim"])
        if self.layout not in LAYOUTS:
            raise ValueError(f"cannot write layout {self.layout!r}")
        self.aside = f"_writing-{uuid.uuid4().hex}"

    def _records(self, batch: pa.RecordBatch) -> bytes:
        column = batch.column("embedding")
        if column.null_count or (np.diff(column.offsets.to_numpy()) != self.dim).any():
            raise ValueError("vectors of several lengths, or null ones")
        x = column.flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(batch.num_rows, -1)
        lead = np.full((len(x), 1), self.dim, dtype="<i4")
        if self.layout == "fvecs":
            x = np.concatenate([lead.view("<f4"), x], axis=1)
        if self.layout == "bvecs":
            x = np.concatenate([lead.view(np.uint8), x.astype(np.uint8)], axis=1)
        return x.tobytes()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, inner = opened(self.path)
        top = f"{inner}/{self.aside}"
        fs.create_dir(top, recursive=True)
        names, held, rows, size = [], [], 0, 0

        def put() -> None:
            nonlocal held, rows, size
            name = f"part-{context.partitionId():06d}-{len(names):05d}-{context.taskAttemptId()}.{self.layout}"
            with fs.open_output_stream(f"{top}/{name}") as f:
                if self.layout == "lshkit":
                    f.write(struct.pack("<III", 4, rows, self.dim))
                for blob in held:
                    f.write(blob)
            names.append(name)
            held, rows, size = [], 0, 0

        for batch in iterator:
            if batch.num_rows:
                held.append(self._records(batch))
                rows, size = rows + batch.num_rows, size + len(held[-1])
                if size >= FILE_BYTES:
                    put()
        if held:
            put()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, inner = opened(self.path)
        before = [f.path for f in fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)) if not f.base_name.startswith("_writing-")]
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{inner}/{self.aside}/{name}", f"{inner}/{name}")
        for path in before:
            fs.delete_dir(path) if fs.get_file_info(path).type == pafs.FileType.Directory else fs.delete_file(path)
        self._clear(fs, inner)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, fs: pafs.FileSystem, inner: str) -> None:
        if fs.get_file_info(f"{inner}/{self.aside}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{inner}/{self.aside}")


class _Placed(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.total = options["path"].removeprefix("file://"), int(options["total"])
        if "://" in self.path:
            raise ValueError("a file that many tasks write needs a mounted folder")
        self.aside = posixpath.join(posixpath.dirname(self.path), f"_writing-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(posixpath.dirname(self.path) or ".", exist_ok=True)
        n = 0
        with os.fdopen(os.open(self.aside, os.O_RDWR | os.O_CREAT, 0o644), "r+b") as f:
            for batch in iterator:
                for offset, blob in zip(batch.column("offset").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                    f.seek(offset)
                    f.write(blob)
                    n += len(blob)
        return Written([str(n)])

    def commit(self, messages: list[Written | None]) -> None:
        written = sum(int(m.names[0]) for m in messages if m)
        if written != self.total:
            self.abort(messages)
            raise ValueError(f"{self.path}: {written} bytes were placed where {self.total} belong")
        os.replace(self.aside, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.aside):
            os.remove(self.aside)


class FolderSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vector_folder"

    def schema(self) -> str:
        return "embedding array<float>"

    def writer(self, schema, overwrite: bool) -> _Folder:
        return _Folder(dict(self.options))


class PlacedSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "placed_bytes"

    def schema(self) -> str:
        return "offset bigint, bytes binary"

    def writer(self, schema, overwrite: bool) -> _Placed:
        return _Placed(dict(self.options))


def write_folder(vectors: DataFrame, path: str, layout: str) -> None:
    """Vectors (pos, embedding) in order of position as a folder of files."""
    vectors.sparkSession.dataSource.register(FolderSink)
    width = vectors.select(F.size("embedding").alias("d")).first()
    dealt = vectors.select("pos", "embedding").repartitionByRange("pos").sortWithinPartitions("pos").select(F.col("embedding").cast("array<float>").alias("embedding"))
    dealt.write.format("vector_folder").mode("overwrite").options(path=path, layout=layout, dim=str(width["d"] if width else 0)).save()


def write_placed(rows: DataFrame, path: str, total: int) -> None:
    """Rows (offset, bytes) as one file of ``total`` bytes."""
    rows.sparkSession.dataSource.register(PlacedSink)
    rows.select("offset", "bytes").write.format("placed_bytes").mode("overwrite").options(path=path, total=str(total)).save()
