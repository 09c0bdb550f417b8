"""WARC archives as a Spark data source, for reading and writing.

Reading plans one partition for a group of files, parses the header block of a record first, applies the predicates on
record type and header fields that Spark pushes down, and decodes the payload only of records that pass and only if
payloads are asked for. Files may be plain or gzipped, by record or as a whole. The writer stores each record as a gzip
member whose extra field says how long it is, so that the reader can step over a payload without inflating it; other
members are inflated and thrown away.

Options of the reader: payload (default true: fill the payload column), digest (default false: fill payload_length and
payload_digest from the payload itself, and fail if a header says otherwise). Of the writer: max_file_bytes.

Paths are opened with pyarrow's file systems, so they must be in a folder that all executors share.

Defined cases: a null payload is empty; a record without payload (revisit) reads back with a null payload; unknown header
fields are kept in the map `headers`; an empty folder gives an empty table; a cut-off file and a record
without a length raise ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .scratch import Scratch
from .text import whole

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, headers map<string,string>, payload binary, file string, offset long"
#: Header fields that have a column.
FIELDS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
_STEP = 1 << 16
MOST_HOT = 1000


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


# ---------------------------------------------------------------- reading


class _Stream:
    """A file's records as uncompressed bytes; can step over the rest of a gzip member."""

    def __init__(self, source):
        self.source, self.buffer = source, b""
        self.zipped = source.read(2) == b"\x1f\x8b"
        source.seek(0)
        self.inflater, self.raw, self.raw_at, self.member, self.skip_to = None, b"", 0, 0, None

    def more(self) -> bool:
        """Put more bytes into the buffer; False at the end of the file."""
        if not self.zipped:
            block = self.source.read(_STEP)
            self.buffer += block
            return bool(block)
        while True:
            if self.inflater is None:
                self.raw = self.raw or self.source.read(_STEP)
                if not self.raw:
                    return False
                self.raw += self.source.read(32) if len(self.raw) < 32 else b""
                self.member = self.source.tell() - len(self.raw)
                self.skip_to = self.member + _member_length(self.raw) if _member_length(self.raw) else None
                self.inflater = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.source.read(_STEP)
                if not self.raw:
                    raise ValueError("the archive ends inside a gzip member")
            out = self.inflater.decompress(self.raw, _STEP)
            self.raw = self.inflater.unconsumed_tail
            if self.inflater.eof:
                self.raw, self.inflater = self.inflater.unused_data, None
            if out:
                self.buffer += out
                return True

    def step_over(self, n: int) -> None:
        """Leave out the next n bytes; a member whose length is known is not inflated."""
        if self.zipped and self.skip_to is not None and self.inflater is not None and n >= len(self.buffer):
            self.source.seek(self.skip_to)
            self.buffer, self.raw, self.inflater = b"", b"", None
            return
        while len(self.buffer) < n:
            n -= len(self.buffer)
            self.buffer = b""
            if not self.more():
                raise ValueError("the archive ends inside a record")
        self.buffer = self.buffer[n:]

    def take(self, n: int) -> bytes:
        parts, got = [self.buffer], len(self.buffer)
        while got < n:
            self.buffer = b""
            if not self.more():
                raise ValueError("the archive ends inside a record")
            parts.append(self.buffer)
            got += len(self.buffer)
        joined = b"".join(parts)
        self.buffer = joined[n:]
        return joined[:n]

    def header(self) -> bytes | None:
        """The next header block, or None at the end of the file."""
        while True:
            self.buffer = self.buffer.lstrip(b"\r\n")
            at = self.buffer.find(b"\r\n\r\n")
            if self.buffer and at >= 0:
                block, self.buffer = self.buffer[:at], self.buffer[at + 4 :]
                return block
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("the archive ends inside a header")
                return None


def _member_length(head: bytes) -> int:
    """Length of a gzip member from its extra field SL, 0 if it has none."""
    if len(head) >= 20 and head[3] & 4 and head[12:16] == b"SL\x08\x00":
        return struct.unpack("<Q", head[16:24])[0]
    return 0


def parse_header(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in " \t" and name:  # a folded field
            out[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def payload_of(header: dict[str, str], block: bytes) -> bytes:
    """The payload of a record: for HTTP messages what follows their header."""
    if header.get("content-type", "").startswith("application/http"):
        _, cut, body = block.partition(b"\r\n\r\n")
        return body if cut else b""
    return block


@dataclass
class _Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.digest = options.get("digest", "false").lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", 128 << 20))
        self.wanted: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        """Take what can be decided from a header; hand the rest back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in FIELDS or (column == "payload_digest" and self.digest):
                yield f
            elif isinstance(f, EqualTo):
                self.wanted.append((FIELDS[column], "in", (f.value,)))
            elif isinstance(f, In):
                self.wanted.append((FIELDS[column], "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.wanted.append((FIELDS[column], "starts", (f.value,)))
            elif isinstance(f, IsNotNull):
                self.wanted.append((FIELDS[column], "present", ()))
            else:
                yield f

    def partitions(self):
        fs, root = _open(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            found = [info]
        else:
            found = [x for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.type == pafs.FileType.File and x.base_name.endswith((".warc", ".warc.gz")) and not x.base_name.startswith(("_", "."))]
        out: list[_Files] = []
        size = self.partition_bytes
        for x in sorted(found, key=lambda x: x.path):
            if size + x.size > self.partition_bytes:
                out.append(_Files([]))
                size = 0
            out[-1].paths.append(x.path)
            size += x.size
        return out or [_Files([])]

    def _passes(self, header: dict[str, str]) -> bool:
        for field, how, values in self.wanted:
            value = header.get(field)
            if value is None or (how == "in" and value not in values) or (how == "starts" and not value.startswith(values[0])):
                return False
        return True

    def records(self, source, path: str) -> Iterator[dict]:
        stream = _Stream(source)
        while (block := stream.header()) is not None:
            header = parse_header(block)
            length = header.get("content-length", "")
            if not length.isdecimal():
                raise ValueError(f"{path}: a record at {stream.member} without a length")
            at, n = stream.member, int(length)
            if not self._passes(header):
                stream.step_over(n)
                continue
            row = {c: header.get(f) for c, f in FIELDS.items()} | {"headers": list(header.items()), "file": path, "offset": at, "payload": None, "payload_length": None}
            if header.get("warc-type") == "revisit" or not (self.payload or self.digest):
                stream.step_over(n)
            else:
                body = payload_of(header, stream.take(n))
                if self.payload:
                    row["payload"] = body
                if self.digest:
                    said = (row["payload_digest"] or "").removeprefix("sha1:")
                    row |= {"payload_length": len(body), "payload_digest": f"sha1:{sha1_base32(body)}"}
                    if said and row["payload_digest"] != f"sha1:{said}":
                        raise ValueError(f"{path}: {row['record_id']} has another payload than its digest says")
            yield row

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string()) for c in ("record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest")] + [("payload_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())])
        fs, _ = _open(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as source:
                for row in self.records(source, path):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= 2000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


# ---------------------------------------------------------------- writing


def record_bytes(row: dict) -> bytes:
    """A record, uncompressed. Its digest is that of the payload given, also for a revisit, which stores none."""
    payload = row["payload"] or b""
    kind = row["record_type"] or "resource"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Date: {row['date']}"]
    if row.get("target_uri"):
        lines.append(f"WARC-Target-URI: {row['target_uri']}")
    lines.append(f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {row['refers_to']}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "Content-Type: application/http; msgtype=response"]
        block = http
    elif kind == "response":
        lines.append("Content-Type: application/http; msgtype=response")
        block = http + payload
    else:
        lines.append("Content-Type: application/octet-stream")
        block = payload
    lines += [f"{k}: {v}" for k, v in (row.get("headers") or [])] + [f"Content-Length: {len(block)}"]
    clean = [x.replace("\r", " ").replace("\n", " ") for x in lines]
    return "\r\n".join(clean).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    """A gzip member whose extra field SL holds its own length."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", 12) + b"SL\x08\x00" + struct.pack("<Q", total)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex[:12]
        self.most = int(options.get("max_file_bytes", 512 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        """Each attempt of a task writes files of its own; only those of attempts that Spark accepts are committed."""
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        files: list[tuple[str, str]] = []
        sink, size = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if sink is None or size > self.most:
                        if sink is not None:
                            sink.close()
                        name = f"{self.job}-{uuid.uuid4().hex}"
                        files.append((f"{root}/_{name}.tmp", f"{root}/{name}.warc.gz"))
                        sink, size = fs.open_output_stream(files[-1][0]), 0
                        sink.write(gzip_member(_info()))
                    member = gzip_member(record_bytes(row))
                    sink.write(member)
                    size += len(member)
        finally:
            if sink is not None:
                sink.close()
        return _Written(files)

    def commit(self, messages) -> None:
        fs, root = _open(self.path)
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if x.base_name.endswith(".warc.gz"):
                    fs.delete_file(x.path)
        for message in messages:
            for held, final in message.files if message else ():
                fs.move(held, final)

    def abort(self, messages) -> None:
        fs, _ = _open(self.path)
        for message in messages:
            for held, _ in message.files if message else ():
                fs.delete_file(held)


def _info() -> bytes:
    body = b"software: sievework\r\nformat: WARC File Format 1.1\r\n"
    return b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:" + str(uuid.uuid4()).encode() + b">\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def write_warc(records: DataFrame, path: str, **options: str) -> None:
    """records: record_type, record_id, target_uri, date, refers_to, headers, payload; others are left out."""
    register(records.sparkSession)
    kinds = {"headers": "map<string,string>", "payload": "binary"}
    columns = [F.col(c) if c in records.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in ("record_type", "record_id", "target_uri", "date", "refers_to", "headers", "payload")]
    records.select(*columns).write.format("warc").mode("append").options(**options).save(path)


def archive_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """One record per page. Of pages with equal payloads of least_bytes or more, that with the smallest page_id is the
    response (a null page_id counts as smallest; rows that share identifier and payload are all responses), the others
    revisit it; smaller payloads are all responses."""
    scratch = Scratch(pages.sparkSession, "firsts")
    payload = F.encode(whole(F.col("html")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("same", F.unhex(F.sha2("payload", 256))).withColumn("bytes", F.length("payload"))
    firsts = scratch.write(rows.groupBy("same").agg(F.min(F.struct("page_id")).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # Payloads that more than one row in MOST_HOT has: fewer than MOST_HOT, so their firsts travel; the rest meet theirs by a shuffle,
    # in which rows of hot payloads are dealt by identifier instead.
    hot = firsts.filter(F.col("n") * MOST_HOT > total).select(F.col("same").alias("h"), F.col("first").alias("hot_first"))
    rows = rows.join(F.broadcast(hot), F.col("same") == F.col("h"), "left")
    own = F.sha2(F.concat_ws(":", F.hex("same"), F.col("page_id").cast("string"), "url").cast("binary"), 256)
    rows = rows.withColumn("meets", F.when(F.col("h").isNull(), F.col("same")).otherwise(F.unhex(own)))
    rows = rows.join(firsts.select(F.col("same").alias("s"), F.col("first").alias("cold_first")), F.col("meets") == F.col("s"), "left")
    rows = rows.select("page_id", "url", "payload", "bytes", F.coalesce("hot_first", "cold_first")["page_id"].alias("first"))
    again = (F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    records = rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), record_id("page_id").alias("record_id"), F.col("url").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("date"), F.when(again, record_id("first")).alias("refers_to"),
        F.create_map(F.lit("X-Payload-Length"), F.col("bytes").cast("string")).alias("headers"), "payload",
    )
    write_warc(records, path)
    scratch.drop("firsts")


def record_id(column: str):
    return F.concat(F.lit("<urn:sievework:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").path("archives")
    archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = read_warc(spark, path, payload="false", digest="true").filter(F.col("record_type").isin("response", "revisit"))

    def page(c: str):
        return F.nullif(F.regexp_extract(c, r"page:(-?\d*)>", 1), F.lit("")).cast("long")

    return records.select(
        page("record_id").alias("page_id"), F.coalesce("payload_length", F.element_at("headers", "x-payload-length").cast("long")).alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (SELECT *, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, octet_length(b) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM g
"""
