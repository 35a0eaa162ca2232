"""A data source that writes one ordered text file, which appears whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "single_text_file"
#: Bytes of a part that are in memory while it is appended.
CHUNK = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the place in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _beside(path: str, run: str) -> tuple[fs.FileSystem, str, list[str]]:
    """The file system of ``path``, its place in it, and the files that the tries of this run have beside it."""
    store, at = place(path)
    folder, _, name = at.rpartition("/")
    found = store.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
    return store, at, [f.path for f in found if f.base_name.startswith(f".{name}.{run}.")]


def _own(path: str, run: str) -> tuple[fs.FileSystem, str]:
    """A file of this try's own beside ``path``."""
    store, at = place(path)
    folder, _, name = at.rpartition("/")
    store.create_dir(folder or ".", recursive=True)
    return store, f"{folder or '.'}/.{name}.{run}.{uuid.uuid4().hex}"


def _put_lines(out: pa.NativeFile, batches: Iterator[pa.RecordBatch]) -> int:
    rows = 0
    for batch in batches:
        out.write("".join(f"{x}\n" for x in batch.column(0).to_pylist()).encode())
        rows += len(batch)
    return rows


def _put_parts(out: pa.NativeFile, store: fs.FileSystem, batches: Iterator[pa.RecordBatch]) -> int:
    parts = 0
    for batch in batches:
        for part in batch.column(0).to_pylist():
            with store.open_input_stream(part) as f:
                while chunk := f.read(CHUNK):
                    out.write(chunk)
            parts += 1
    return parts


class SingleFile(DataSource):
    """``df.write.format("single_text_file")``: the lines of a table of one text column; ``header`` goes before them.
    With the option ``parts`` (the name that the parts' writers gave their run) the column has files beside ``path``
    instead, which are appended in the order of the rows, and go.

    A try of the task writes a file of its own beside ``path``; commit moves that of the try that succeeded to
    ``path``, in one step, and takes away those of other tries. Abort takes all away and leaves an older file as it was.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if len(schema) != 1:
            raise ValueError("one column of lines is wanted")
        return SingleFileWriter(self.options["path"], self.options.get("header"), overwrite, self.options.get("parts"))


class SingleFileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, header: str | None, overwrite: bool, parts: str | None = None):
        self.path, self.header, self.parts, self.run = path, header, parts is not None, parts or uuid.uuid4().hex
        store, at = place(path)
        if not overwrite and store.get_file_info(at).type != fs.FileType.NotFound:
            raise FileExistsError(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, own = _own(self.path, self.run)
        with store.open_output_stream(own) as out:
            if self.header is not None:
                out.write(f"{self.header}\n".encode())
            rows = _put_parts(out, store, iterator) if self.parts else _put_lines(out, iterator)
        return Written(own, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, at, tries = _beside(self.path, self.run)
        made = [m for m in messages if isinstance(m, Written)]
        if len(made) != 1:
            self.abort(messages)
            raise ValueError(f"one task must write a single file, not {len(made)}")
        store.move(made[0].path, at)
        for p in tries:
            if p != made[0].path:
                store.delete_file(p)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _clear(self.path, self.run)


def _clear(path: str, run: str) -> None:
    store, _, tries = _beside(path, run)
    for p in tries:
        store.delete_file(p)


def _part_writer(path: str, run: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, own = _own(path, run)
        with store.open_output_stream(own) as out:
            _put_lines(out, batches)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [own]})

    return write


def write_lines(df: DataFrame, line: str, path: str, order: list[str], header: str | None = None, overwrite: bool = True) -> None:
    """The texts of column ``line``, in the order of ``order``, as one file at ``path`` (a mounted folder, or an address
    that Arrow's file systems know).

    Many tasks sort a range of rows each and write it as a part beside ``path``; one task then appends the parts by
    their numbers, in pieces of bounded size. It neither sorts nor holds rows, whatever their number.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    store, at = place(path)
    if not overwrite and store.get_file_info(at).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    spark.dataSource.register(SingleFile)
    # A range's number tells its place, as their number is given.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in order]
    lines = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys) if keys else df).select(line)
    try:
        parts = sorted(lines.mapInArrow(_part_writer(path, run), "part int, file string").collect())
        files = spark.createDataFrame([(p.part, p.file) for p in parts], "part int, file string").coalesce(1).sortWithinPartitions("part").select("file")
        writer = files.write.format(NAME).option("path", path).option("parts", run).mode("overwrite" if overwrite else "append")
        (writer if header is None else writer.option("header", header)).save()
    except BaseException:
        _clear(path, run)
        raise
