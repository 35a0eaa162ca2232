"""A content-addressed web archive: payloads stored once, exact record headers beside them, records by joins."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.single_file import place
from .common import new_folder, partitions, small_batches

VERSION = "WARC/1.1"
CRLF = "\r\n"
#: Bytes of records that one task writes, and bytes of an archive file at which the next one begins, about.
FILE_BYTES = 32 << 20
#: Bytes of a file that are decompressed at a time, and bytes of payloads in one batch of parsed records, about.
CHUNK, BATCH_BYTES = 1 << 16, 8 << 20
#: zlib's way of asking for the gzip format.
GZIP = 31
INDEX = "page_id long, file string, offset long, length long"
#: Responses with one payload that are rebuilt in one place; a payload that has more is laid out several times.
SPREAD = 64
#: Places in which the pages of one payload learn their leader.
SALTS = 32
PARSED = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload_sha256 string, payload string"


def _uuid(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def build(pages: DataFrame, min_revisit_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """The archive's two tables, ``(payloads, headers)``.

    ``payloads`` has ``sha256, payload, n, spread``, one row for each distinct payload. ``headers`` has ``page_id,
    record_type, refers_to, sha256, place, header``: the header block of each record, byte for byte. Of records with
    equal payloads of at least ``min_revisit_bytes`` that with the largest ``page_id`` is the response and the
    others revisit it; all smaller ones are responses. If the row with the largest ``page_id`` is repeated, each
    repetition is a response; where all of a group's ``page_id`` are null, all of them are.

    A payload that very many pages share is no single task's work: its pages meet their leader in ``SALTS`` places,
    and its responses are spread over ``spread`` places, of which ``place`` is a record's own.

    A null ``html`` is an empty payload. A null ``url`` leaves the target line out; line breaks in a URL are
    percent-encoded. Other columns are ignored.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    raw = raw.withColumn("sha256", F.sha2(F.col("payload").cast("binary"), 256))
    size = F.octet_length("payload").cast("long")
    keyed = raw.select("page_id", "url", "sha256", size.alias("n"), F.sha1(F.col("payload").cast("binary")).alias("sha1"))
    large = F.col("n") >= min_revisit_bytes
    spread = F.when(large & (F.col("ids") > 0), 1).otherwise(F.ceil(F.col("pages") / SPREAD)).cast("int").alias("spread")

    payloads = raw.groupBy("sha256").agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("pages"), F.count("page_id").alias("ids"))  # of equal bytes any copy serves
    payloads = payloads.withColumn("n", size).select("sha256", "payload", "n", spread)

    shared = keyed.groupBy("sha256").agg(F.max("page_id").alias("leader"), F.first("n").alias("n"), F.count(F.lit(1)).alias("pages"), F.count("page_id").alias("ids")).where("pages > 1")
    shared = shared.select("sha256", "leader", spread, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = F.xxhash64("page_id", "url")
    h = keyed.withColumn("salt", F.pmod(own, F.lit(SALTS)).cast("int")).join(shared, ["sha256", "salt"], "left")
    h = h.withColumn("place", F.pmod(F.shiftright(own, 8), F.coalesce("spread", F.lit(1))).cast("int"))
    revisit = large & F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader"))
    h = h.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("leader")))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.concat(
        F.lit(VERSION + CRLF),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _uuid(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(revisit, _uuid(F.col("refers_to")))),
        _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("X-Page-Id", F.col("page_id").cast("string")),
        _line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        _line("X-Payload-Length", F.col("n").cast("string")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
    )
    return payloads, h.select("page_id", "record_type", "refers_to", "sha256", "place", block.alias("header"))


def records(payloads: DataFrame, headers: DataFrame, parts: int | None = None) -> DataFrame:
    """The original records, rebuilt by joining headers with payloads: ``page_id`` and a binary ``record`` each.

    Only responses need their payload; revisits take no part in the join. Each payload is verified against its
    address on the way; a record whose payload is missing or altered stops the job. ``parts``: in how many parts the
    responses are rebuilt.
    """
    p = payloads.select("sha256", F.when(F.sha2(F.col("payload").cast("binary"), 256) == F.col("sha256"), F.col("payload")).alias("payload"), F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("place"))
    response = headers.where("record_type = 'response'").select("page_id", "sha256", "place", "header")
    if parts:
        p, response = p.repartition(parts, "sha256", "place"), response.repartition(parts, "sha256", "place")
    body = F.coalesce("payload", F.raise_error(F.concat(F.lit("no such payload: "), F.col("sha256"))))
    whole = response.join(p, ["sha256", "place"], "left").select("page_id", F.concat("header", F.lit(CRLF), body).cast("binary").alias("record"))
    return whole.unionByName(headers.where("record_type = 'revisit'").select("page_id", F.concat("header", F.lit(CRLF)).cast("binary").alias("record")))


def _written(path: str, file_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Write a task's records into files of its own, and hand on where each record is."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = place(path)
        store.create_dir(top, recursive=True)
        out = None
        try:
            for batch in batches:
                files, offsets, lengths = [], [], []
                for record in batch.column("record"):
                    if out is None:
                        name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{top}/{name}", compression=None)
                    z = zlib.compressobj(wbits=GZIP)
                    member = b"".join((z.compress(record.as_buffer()), z.compress(2 * CRLF.encode()), z.flush()))
                    out.write(member)
                    files.append(name)
                    offsets.append(at)
                    lengths.append(len(member))
                    at += len(member)
                    if at >= file_bytes:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return write


def write_warc(recs: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> str:
    """Write records as archive files ``part-*.warc.gz``, each record a gzip member of its own, followed by two line breaks, as the format has it.

    Tasks write files of their own, with names never used before, and hand on rows ``page_id, file, offset, length``,
    which Spark writes as the table ``index`` beside the files. Spark commits those of one try of each task, and the
    index alone says which files are the archive's: a lost try leaves a file that nothing names, which ``unnamed``
    finds. The folder must be one that Arrow's file systems open.
    """
    small_batches(recs.sparkSession)
    recs.select("page_id", "record").mapInArrow(_written(path, file_bytes), INDEX).write.option("compression", "zstd").parquet(f"{path}/index")
    return path


def index(spark: SparkSession, path: str) -> DataFrame:
    """Where each record of an archive is: ``page_id, file, offset, length``."""
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def unnamed(spark: SparkSession, path: str) -> DataFrame:
    """``file``: those beside the index that it doesn't name, left by lost tries of tasks."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select(F.substring_index("path", "/", -1).alias("file"))
    return found.join(index(spark, path).select("file").distinct(), "file", "left_anti")


def _members(data: Iterator[bytes]) -> Iterator[bytes]:
    """The gzip members of a file, decompressed one at a time."""
    z, got = zlib.decompressobj(GZIP), []
    for chunk in data:
        while chunk:
            got.append(z.decompress(chunk))
            chunk = z.unused_data
            if z.eof:
                yield b"".join(got)
                z, got = zlib.decompressobj(GZIP), []
    if got:
        raise ValueError("a file is cut short within a record")


def _parse(data: bytes) -> Iterator[dict]:
    import hashlib

    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split(CRLF)
        if lines[0] != VERSION:
            raise ValueError(f"no record starts at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        body = data[end + 4 : end + 4 + size]
        at = end + 4 + size
        if len(body) != size or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record of {size} bytes is cut short at byte {at}")
        at += 4
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        response = fields["WARC-Type"] == "response"
        if response and hashlib.sha1(body).hexdigest() != digest:
            raise ValueError(f"the payload at byte {at} does not match its digest")
        number = lambda k: int(fields[k]) if k in fields else None
        yield {"page_id": number("X-Page-Id"), "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id"), "payload_digest": digest, "payload_bytes": size if response else number("X-Payload-Length"), "payload_sha256": hashlib.sha256(body).hexdigest() if response else None, "payload": body.decode("utf-8", "replace") if response else None}


def _frames(members: Iterator[bytes], payload: bool) -> Iterator[pd.DataFrame]:
    """The parsed records of gzip members, in frames of bounded size."""

    def frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows)
        for c in ("page_id", "refers_to", "payload_bytes"):
            out[c] = out[c].astype("Int64")
        return out

    rows, size = [], 0
    for member in members:
        for x in _parse(member):
            if not payload:
                x["payload"] = None
            rows.append(x)
            size += len(x["payload"] or "") + 200
        if size > BATCH_BYTES:
            yield frame(rows)
            rows, size = [], 0
    if rows:
        yield frame(rows)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of an archive that ``write_warc`` made, parsed by their ``Content-Length`` and checked against their digests.

    The files that the index names are read member by member, so a task holds one record of a file at a time. A file
    of another length than the index says stops the job. A revisit has null ``payload_sha256`` and ``payload``; its
    ``payload_bytes`` are those that its own header states. :func:`lost_revisits` finds revisits whose response isn't
    there.
    """
    files = index(spark, path).groupBy("file").agg(F.sum("length").alias("size"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = place(path)

        def chunks(name: str, size: int) -> Iterator[bytes]:
            with store.open_input_stream(f"{top}/{name}", compression=None) as f:
                while data := f.read(CHUNK):
                    size -= len(data)
                    yield data
            if size:
                raise ValueError(f"{name} is cut short or longer: {size} bytes from what its index says")

        for batch in batches:
            yield from _frames((m for name, size in zip(batch["file"], batch["size"]) for m in _members(chunks(name, size))), payload)

    # Files are of about one size; a number of parts that is given isn't lessened for their few names.
    return files.repartition(partitions(spark)).mapInPandas(parse, PARSED)


def lookup(spark: SparkSession, path: str, wanted: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the ``page_id`` in ``wanted``, of which only their own bytes are read, by their places in the index.

    Repeated and unknown ids do no harm; a null id finds nothing. Columns are those of :func:`read_warc`.
    """
    found = index(spark, path).join(wanted.select(F.col("page_id").cast("long").alias("page_id")).distinct(), "page_id")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = place(path)

        def pieces(batch: pd.DataFrame) -> Iterator[bytes]:
            for name, places in batch.groupby("file", sort=False):
                with store.open_input_file(f"{top}/{name}") as f:
                    for offset, length in zip(places["offset"].tolist(), places["length"].tolist()):
                        yield f.read_at(length, offset)

        for batch in batches:
            yield from _frames((m for piece in pieces(batch) for m in _members(iter([piece]))), payload)

    return found.repartition(partitions(spark), "file").sortWithinPartitions("file", "offset").mapInPandas(read, PARSED)


def resolve(recs: DataFrame) -> DataFrame:
    """Each record's payload facts. A revisit carries those of its response in its own header, so no record meets another."""
    return recs.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def lost_revisits(recs: DataFrame) -> DataFrame:
    """Revisits without a response of their ``refers_to``, digest and length: none in a whole archive.

    Revisits of one response are counted before they are joined, so that a very common payload is one row.
    """
    keys = ["refers_to", "payload_digest", "payload_bytes"]
    responses = recs.where("record_type = 'response' AND page_id IS NOT NULL").select(F.col("page_id").alias("refers_to"), *keys[1:]).distinct()
    return recs.where("record_type = 'revisit'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(responses, keys, "left_anti")


def archive(pages: DataFrame, path: str | None = None, **options) -> str:
    """Build the two tables in a folder of the shared one, rebuild the records from them, and write the archive files."""
    spark = pages.sparkSession
    top = path or new_folder(spark, "warc")
    payloads, headers = build(pages, **options)
    payloads.write.option("compression", "zstd").parquet(f"{top}/payloads")
    headers.write.option("compression", "zstd").parquet(f"{top}/headers")
    payloads = spark.read.parquet(f"{top}/payloads")
    size = payloads.agg(F.coalesce(F.sum(F.col("n") * F.col("spread")), F.lit(0))).first()[0]
    return write_warc(records(payloads, spark.read.parquet(f"{top}/headers"), max(partitions(spark), -(-size // FILE_BYTES))), f"{top}/warc")
