"""WARC archives: a PySpark Python data source that writes and reads them.

Writing: one gzip member per record, in rolled files.  Tasks write into a work
folder of their job below the target and name their files to the driver; only files of
committed tasks are moved out of it, so lost or repeated tasks leave no record.
A member carries its compressed and full length (the ``sl`` extra field), so a
reader can step over it.

Reading: the driver lists the files and packs them into partitions by size.  A
task inflates only the head of a record, tests the pushed-down predicates on it,
and then either inflates the rest or steps to the next record.  With the option
``payload`` set to false no payload is inflated at all.  Archives of others, with
members that lack ``sl``, and plain ``.warc`` files are read too.

Paths may have any scheme that pyarrow knows; executors must reach them.

Deduplication: of records with equal payloads, that with the least page id is a
response and the others are revisits that refer to it.  Rows that share this
least id are all responses.  A null page id comes after all others; a null page
has an empty payload; a null url gives a record without a target.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

SCHEMA = (
    "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, "
    "date string, content_type string, payload_bytes long, payload binary"
)
_FIELDS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "date": "WARC-Date",
    "content_type": "Content-Type",
}
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ROLL = 256 << 20
_READ = 128 << 20
_BATCH = 8 << 20
_GZIP = b"\x1f\x8b\x08"
_WORK = "_writing"


# writing


def _head(lines: Iterable[tuple[str, object]], first: str) -> bytes:
    body = "".join(
        f"{k}: {re.sub('[\r\n]', ' ', str(v))}\r\n" for k, v in lines if v is not None
    )
    return f"{first}\r\n{body}\r\n".encode()


def record_bytes(row: dict, date: str) -> bytes:
    """One uncompressed record of a row (record_type, record_id, target_uri, payload_digest, refers_to, payload)."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))], "HTTP/1.1 200 OK")
    block = http if revisit else http + payload
    lines = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", date),
        ("WARC-Target-URI", row["target_uri"]), ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
        ("WARC-Profile", _SAME_PAYLOAD if revisit else None),
        ("WARC-Refers-To", f"<{row['refers_to']}>" if row["refers_to"] is not None else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    return _head(lines, "WARC/1.1") + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member with its lengths in the ``sl`` field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 24 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    if max(size, len(data)) >> 32:
        extra = b"xx" + extra[2:]
    head = _GZIP + b"\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str, overwrite: bool):
        self.path, self.date, self.overwrite = path, date, overwrite
        self.work = f"{_WORK}-{uuid.uuid4().hex}"  # of this job alone: others may write to the same path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{root}/{self.work}")
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for at in range(batch.num_rows):
                row = {name: batch.column(i)[at].as_py() for i, name in enumerate(batch.schema.names)}
                if out is None or size > _ROLL:
                    if out:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/{self.work}/{names[-1]}", compression=None), 0
                data = member(record_bytes(row, self.date))
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file] if self.overwrite else []
        names = [n for m in messages if m for n in m.names]
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda n: fs.move(f"{root}/{self.work}/{n}", f"{root}/{n}"), names))
            list(pool.map(fs.delete_file, old))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(f"{root}/{self.work}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.work}")


# reading


class _Source:
    """Bytes of one record, inflated as far as asked for."""

    def __init__(self, file: io.BufferedReader, start: int):
        self.file, self.have = file, b""
        file.seek(start)
        head = file.read(12)
        self.end: int | None = None
        self.inflate = None
        self.rest = b""
        if head[:3] == _GZIP:
            flags = head[3]
            if flags & 4:
                extra = file.read(struct.unpack("<H", head[10:12])[0])
                if extra[:2] == b"sl":
                    self.end = start + struct.unpack("<I", extra[4:8])[0]
            else:
                file.seek(start + 10)
            for flag in (8, 16):  # name and comment end with a zero byte
                while flags & flag and file.read(1) not in (b"\0", b""):
                    pass
            if flags & 2:
                file.read(2)
            self.inflate = zlib.decompressobj(-15)
        else:
            file.seek(start)

    def more(self, size: int) -> bool:
        """Read on by about ``size`` bytes; false at the end of the member or file."""
        if self.inflate is None:
            data = self.file.read(size)
            self.have += data
            return bool(data)
        if self.inflate.eof:
            return False
        packed = self.inflate.unconsumed_tail or self.file.read(65536 if size > 4096 else 4096)
        data = self.inflate.decompress(packed, size)
        self.have += data
        return bool(packed or data)

    def after(self, length: int) -> int:
        """Where the next record starts; ``length``: full bytes of this one."""
        if self.end is not None:
            return self.end
        if self.inflate is None:
            return self.file.tell() - len(self.have) + length
        while not self.inflate.eof and self.more(1 << 16):
            self.have = b""
        return self.file.tell() - len(self.inflate.unused_data) + 8


def _parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def records(
    file: io.BufferedReader, size: int, wanted: dict[str, set] | None = None, payloads: bool = True
) -> Iterator[tuple]:
    """Rows of SCHEMA; records whose head fails ``wanted`` (column: values) are stepped over."""
    at = 0
    while at < size:
        source = _Source(file, at)
        while b"\r\n\r\n" not in source.have and source.more(1024):
            pass
        head, found, _ = source.have.partition(b"\r\n\r\n")
        if not found:
            if head.strip():
                raise ValueError(f"no WARC record at byte {at}")
            return
        field = _parse(head)
        block = int(field.get("content-length", 0))
        full = len(head) + 4 + block + 4
        row = {c: field.get(h.lower()) for c, h in _FIELDS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c] and row[c].strip("<>")
        row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
        if all(row[c] in values for c, values in (wanted or {}).items()):
            payload, length = None, block
            http = (row["content_type"] or "").startswith("application/http")
            stop = full - 4
            if http:
                while source.have.find(b"\r\n\r\n", len(head) + 4) < 0 and len(source.have) < stop and source.more(1024):
                    pass
                end = source.have.find(b"\r\n\r\n", len(head) + 4, stop)
                begin = end + 4 if end >= 0 else stop
                length = int(_parse(source.have[len(head) + 4 : begin]).get("content-length", stop - begin))
            else:
                begin = len(head) + 4
            if payloads and row["record_type"] != "revisit":
                while len(source.have) < stop and source.more(stop - len(source.have)):
                    pass
                payload = source.have[begin:stop]
                length = len(payload)
            yield (*row.values(), length, payload)
        at = source.after(full)


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool, tasks: int = 1):
        self.path, self.payloads, self.tasks = path, payloads, tasks
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality and membership on header columns are tested on the head of a record."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in _FIELDS and isinstance(f, (EqualTo, In)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted[name] = self.wanted.get(name, values) & (values - {None})
            elif not (isinstance(f, IsNotNull) and name == "record_type"):
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        listed = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        files = sorted((f.path, f.size) for f in listed if f.is_file and re.search(r"\.warc(\.gz)?$", f.path))
        out: list[Files] = []
        room, share = 0, min(_READ, -(-sum(size for _, size in files) // self.tasks))
        for path, size in files:
            if not out or size > room:
                out.append(Files([]))
                room = share
            out[-1].files.append((path, size))
            room -= size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string())
                           for n in names])
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), kinds)], schema=kinds)

        for path, size in partition.files:
            with fs.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 20) as file:
                for row in records(file, size, self.wanted, self.payloads):
                    rows.append(row)
                    held += len(row[-1] or b"") + 200
                    if held > _BATCH:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class WarcDataSource(DataSource):
    """Options: path; payload (true) and tasks (1), the least number wanted, for reading; date for writing."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false",
                          int(self.options.get("tasks", "1")))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# pages


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1, five hex digits (four base32 digits) at a time."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_id_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^urn:page:(-?\d+)$", 1).try_cast("long")


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The records to write for pages (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload")))
    shared = (
        rows.filter(F.octet_length("payload") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("payload_digest", "first")
    )
    met = rows.join(shared, "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    return met.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), name(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"), "payload_digest",
        F.when(again, name(F.col("first"))).alias("refers_to"), "payload",
    )


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a record per page below ``path``, which every executor must reach."""
    register(pages.sparkSession)
    page_records(pages, least_bytes).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    tasks = spark.sparkContext.defaultParallelism
    return spark.read.format("warc").option("payload", str(payload).lower()).option("tasks", tasks).load(path)


def page_digests(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record.

    A response's digest and length come from its payload as read; a digest that
    differs from the one in its head is an error.
    """
    real = F.when(F.col("record_type") == "response", base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest"))
    wrong = F.raise_error(F.concat(F.lit("payload of another digest: "), F.col("record_id")))
    checked = F.when(real == F.col("payload_digest"), real).otherwise(wrong.cast("string"))
    return archive.select(
        page_id_of(F.col("record_id")).alias("page_id"), "payload_bytes", checked.alias("payload_digest"),
        "record_type", page_id_of(F.col("refers_to")).alias("refers_to"),
    )
