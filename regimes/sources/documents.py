"""A data source for JSON documents: the elements of an array in each, one row for each element."""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from .single_file import place

NAME = "json_elements"
#: Bytes of documents that a task reads, about; a document is never divided.
SPLIT_BYTES = 64 << 20
#: What opening a file counts as, in bytes: many small files share a task, but not too many.
OPEN_BYTES = 1 << 20
#: Elements that go to Spark at a time, at most.
BATCH_ROWS = 2000
#: A row's place is its file's number times this, plus its document's place in the file and its own in the document.
FILE_STEP = 1 << 40


@dataclass
class Piece:
    """The documents of a file that begin within a range of bytes."""

    file: str
    number: int
    start: int
    stop: int


class Pieces(ds.InputPartition):
    def __init__(self, pieces: list[Piece]):
        super().__init__(None)
        self.pieces = pieces


class JsonElements(ds.DataSource):
    """``spark.read.format("json_elements")``: elements of the array at ``at`` of each document (nothing: the document itself).

    ``fields`` is a JSON object of column names and dotted paths within an element. Columns are texts: of numbers and
    nested values their JSON, of null and missing ones null. ``pos`` orders elements as they are in the files, by path.
    A file is one document or, with ``lines``, has one in each line. A document without the array has no elements; a
    broken one stops the job. With ``strip``, blanks around texts are taken off.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def _fields(self) -> dict[str, str]:
        return json.loads(self.options["fields"])

    def schema(self) -> str:
        return ", ".join(["pos bigint", *[f"`{c}` string" for c in self._fields()]])

    def reader(self, schema) -> ds.DataSourceReader:
        o = self.options
        return JsonElementsReader(o["path"], o.get("at", ""), self._fields(), o.get("lines") == "true", o.get("strip") == "true", int(o.get("splitbytes", SPLIT_BYTES)))


_COMPARE = {ds.EqualTo: pc.equal, ds.GreaterThan: pc.greater, ds.GreaterThanOrEqual: pc.greater_equal, ds.LessThan: pc.less, ds.LessThanOrEqual: pc.less_equal, ds.StringStartsWith: pc.starts_with}


class JsonElementsReader(ds.DataSourceReader):
    def __init__(self, path: str, at: str, fields: dict[str, str], lines: bool, strip: bool, split: int):
        self.path, self.at, self.lines, self.strip, self.split = path, at.split(".") if at else [], lines, strip, split
        self.fields, self.filters = {c: p.split(".") for c, p in fields.items()}, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Comparisons of texts are applied by the tasks that read; texts compare by their bytes, as in Spark."""
        for f in filters:
            known = isinstance(f, (ds.In, ds.IsNotNull, *_COMPARE)) and f.attribute[0] in self.fields
            if known:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[ds.InputPartition]:
        """Files, or ranges of their lines, dealt so that each task has about ``split`` bytes."""
        store, where = place(self.path)
        info = store.get_file_info(where)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(where, recursive=True))
        below = lambda f: f.path[len(where):].split("/")
        files = [f for f in found if f.is_file and f.size and (info.is_file or not any(p.startswith((".", "_")) for p in below(f)))]
        parts, room = [], 0
        for number, f in enumerate(sorted(files, key=lambda f: f.path)):
            step = self.split if self.lines else f.size
            for start in range(0, f.size, step):
                piece = Piece(f.path, number, start, min(start + step, f.size))
                weight = piece.stop - start + OPEN_BYTES
                if not parts or weight > room:
                    parts.append(Pieces([]))
                    room = self.split + OPEN_BYTES
                parts[-1].pieces.append(piece)
                room -= weight
        return parts or [Pieces([])]

    def _documents(self, piece: Piece) -> Iterator[tuple[int, bytes]]:
        store, _ = place(self.path)
        with store.open_input_file(piece.file) as raw, io.BufferedReader(raw, 1 << 20) as f:
            if not self.lines:
                yield 0, f.read()
                return
            at = piece.start
            if at:
                # A line belongs to the range in which it begins: the one before ends with the first line end from here.
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < piece.stop:
                line = f.readline()
                if not line:
                    return
                yield at, line
                at += len(line)

    def _elements(self, piece: Piece) -> Iterator[tuple[int, object]]:
        for start, data in self._documents(piece):
            if not data.strip():
                continue
            try:
                found = json.loads(data.decode("utf-8-sig"))
            except ValueError as e:
                raise ValueError(f"broken document at byte {start} of {piece.file}: {e}") from e
            found = _walk(found, self.at)
            found = found if isinstance(found, list) else [] if found is None else [found]
            for i, x in enumerate(found):
                yield piece.number * FILE_STEP + start + i, x

    def _batch(self, rows: list[tuple[int, object]]) -> pa.RecordBatch:
        columns = [pa.array([pos for pos, _ in rows], pa.int64())]
        for path in self.fields.values():
            texts = [_text(_walk(x, path)) for _, x in rows]
            columns.append(pa.array([t.strip() if self.strip and t is not None else t for t in texts], pa.string()))
        batch = pa.record_batch(columns, ["pos", *self.fields])
        for f in self.filters:
            column = batch.column(f.attribute[0])
            if isinstance(f, ds.IsNotNull):
                mask = pc.is_valid(column)
            elif isinstance(f, ds.In):
                mask = pc.is_in(column, pa.array([v for v in f.value if v is not None], pa.string()))
            else:
                mask = _COMPARE[type(f)](column, f.value)
            batch = batch.filter(mask)
        return batch

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        for piece in partition.pieces:
            rows = []
            for row in self._elements(piece):
                rows.append(row)
                if len(rows) == BATCH_ROWS:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)


def _walk(x: object, path: list[str]) -> object:
    for p in path:
        x = x.get(p) if isinstance(x, dict) else None
    return x


def _text(x: object) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def read_elements(spark: SparkSession, path: str, at: str, fields: dict[str, str], lines: bool = False, strip: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Elements of the array ``at`` of the documents at ``path`` (a file, or a folder with all below it): ``pos`` and ``fields``.

    ``path`` is in a mounted folder or an address that Arrow's file systems know. Comparisons of columns with texts
    reach the reading tasks: Spark leaves that off for sources in Python, so the session's setting is turned on.
    """
    spark.dataSource.register(JsonElements)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    flags = {"lines": str(lines).lower(), "strip": str(strip).lower(), "splitbytes": str(split_bytes)}
    return spark.read.format(NAME).options(at=at, fields=json.dumps(fields), **flags).load(path)
