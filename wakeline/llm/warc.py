"""WARC archives as a Spark data source, for writing and reading.

Writing: each task writes one gzip archive (one member a record, the member's length in its extra field) below a
temporary name; the commit renames the files of the tasks that succeeded, so that lost or repeated attempts leave no
records. Payloads that occur more than once are stored once: the row with the largest page_id becomes the response,
the others revisit it.

Reading: the driver plans one partition for each file. Filters on record type and other header fields are taken over
from Spark; a task inflates no more of a record than its headers, tests the filters on them, and only then decodes the
payload, if it is wanted at all. Otherwise it jumps to the next member by the length in the extra field; archives
without it, members that hold many records, and plain .warc files are read too. Every record but a revisit has a
payload: the body of an HTTP message, or else the whole block.

Paths go through pyarrow's file systems (file:, hdfs:, s3: and so on). Edge cases: null html is an empty payload; empty
payloads count as equal; a null page_id sorts below all others and gets a random record id, a null url no target; rows
that repeat the largest page_id of a payload are all responses; other columns are ignored; an empty table writes and
reads no records.
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
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from wakeline.llm.common import checked_join, delete_at_exit, materialise, shared_dir

SCHEMA = "record_id string, record_type string, target_uri string, page_id long, payload_bytes long, payload_digest string, refers_to long, headers map<string,string>, payload binary"
#: Fields known from the headers alone, on which filters can be tested before the payload.
EARLY = ("record_id", "record_type", "target_uri", "page_id", "payload_digest", "refers_to")
ID, LEVEL, WINDOW = "urn:x-page:", 3, 1 << 20
DATE = "2024-01-01T00:00:00Z"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def member(record: bytes) -> bytes:
    """A gzip member whose extra field `sl` holds its compressed and uncompressed length."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = c.compress(record) + c.flush()
    size = 12 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(record)) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _one_line(s: str) -> str:
    return s.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    head = [b"WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}".encode()]
    head += [f"WARC-Record-ID: <{ID}{page_id}>".encode() if page_id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>".encode(), f"WARC-Date: {DATE}".encode()]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}".encode("utf-8", "replace"))
    head += [f"WARC-Payload-Digest: sha1:{digest}".encode(), f"WARC-X-Payload-Length: {len(payload)}".encode()]
    if revisit:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID}{refers_to}>".encode()]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head += [b"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = file_system(self.path)
        fs.create_dir(f"{root}/_temporary-{self.job}")
        name, out = f"{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            if not batch.num_rows:
                continue
            out = out or fs.open_output_stream(f"{root}/_temporary-{self.job}/{name}", compression=None)
            html = batch.column("html").cast(pa.large_binary())
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
                out.write(member(record_bytes(get("page_id"), get("url"), html[i].as_py() or b"", get("payload_digest"), get("refers_to"), get("revisit"))))
        if out:
            out.close()
        return _Written(name if out else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = file_system(self.path)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if f.is_file:
                    fs.delete_file(f.path)
        fs.create_dir(root)
        for m in messages:
            if m and m.name:
                fs.move(f"{root}/_temporary-{self.job}/{m.name}", f"{root}/part-{m.name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = file_system(self.path)
        if fs.get_file_info(f"{root}/_temporary-{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/_temporary-{self.job}")


class _Bytes:
    """Random reads of a file through one buffered window."""

    def __init__(self, path: str):
        fs, name = file_system(path)
        self.file = fs.open_input_file(name)
        self.size, self.at, self.held = self.file.size(), 0, b""

    def get(self, pos: int, n: int) -> bytes:
        n = min(n, self.size - pos)
        if pos < self.at or pos + n > self.at + len(self.held):
            self.at, self.held = pos, self.file.read_at(min(max(n, WINDOW), self.size - pos), pos)
        return self.held[pos - self.at : pos - self.at + n]


def _parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {"version": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def records(src: _Bytes, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers of every record for which wanted(headers) is not None, with the block if it is true."""
    pos = 0
    while pos < src.size:
        first = src.get(pos, 8192)
        if first[:2] == b"\x1f\x8b":
            skip, length = 10, 0
            if first[3] & 4:
                n = struct.unpack("<H", first[10:12])[0]
                extra, skip = src.get(pos + 12, n), 12 + n
                while len(extra) >= 4:
                    k = struct.unpack("<H", extra[2:4])[0]
                    if extra[:2] == b"sl" and k == 8:
                        length = struct.unpack("<I", extra[4:8])[0]
                    extra = extra[4 + k :]
            for flag in (8, 16):
                if first[3] & flag:
                    skip = src.get(pos, 1 << 16).index(b"\0", skip) + 1
            skip += 2 * bool(first[3] & 2)
            d, text, at = zlib.decompressobj(-15), b"", pos + skip
            while b"\r\n\r\n" not in text and not d.eof and at < src.size:
                chunk = d.unconsumed_tail or src.get(at, 4096)
                at += 0 if d.unconsumed_tail else len(chunk)
                text += d.decompress(chunk, 8192)
            head, _, rest = text.partition(b"\r\n\r\n")
            headers = _parse(head)
            want = wanted(headers)
            if want or not length:
                parts, head = [rest], b""
                while not d.eof and at <= src.size:
                    chunk = d.unconsumed_tail or src.get(at, WINDOW // 2)
                    if not chunk:
                        break
                    at += 0 if d.unconsumed_tail else len(chunk)
                    parts.append(d.decompress(chunk))
                length = length or at - len(d.unused_data) + 8 - pos
                rest = b"".join(parts)
            while headers is not None:
                if want is not None:
                    yield headers, rest[: int(headers.get("content-length", 0))] if want else None
                # What follows the block in the same member, if all of it was inflated, is another record.
                rest = rest[int(headers.get("content-length", 0)) :].lstrip(b"\r\n") if not head else b""
                headers = None
                if rest:
                    more, _, rest = rest.partition(b"\r\n\r\n")
                    headers = _parse(more)
                    want = wanted(headers)
            pos += length
        else:
            n = 8192
            while b"\r\n\r\n" not in (text := src.get(pos, n)) and pos + n < src.size:
                n *= 2
            head = text.partition(b"\r\n\r\n")[0]
            headers = _parse(head)
            size, want = int(headers.get("content-length", 0)), wanted(headers)
            if want is not None:
                yield headers, src.get(pos + len(head) + 4, size) if want else None
            pos += len(head) + 4 + size + 4


def _page(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").removeprefix(ID)
    return int(name) if urn and ID in urn and name.lstrip("-").isdigit() else None


def early_fields(h: dict[str, str]) -> dict:
    digest = h.get("warc-payload-digest")
    return {"record_id": h.get("warc-record-id", "").strip("<>"), "record_type": h.get("warc-type"), "target_uri": h.get("warc-target-uri"), "page_id": _page(h.get("warc-record-id")), "payload_digest": digest.removeprefix("sha1:") if digest else None, "refers_to": _page(h.get("warc-refers-to"))}


def holds(f: Filter, row: dict) -> bool:
    v = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return v is None
    if isinstance(f, EqualNullSafe):
        return v == f.value
    if v is None:
        return False
    if isinstance(f, IsNotNull):
        return True
    if isinstance(f, In):
        return v in f.value
    if isinstance(f, StringStartsWith):
        return v.startswith(f.value)
    return {EqualTo: v == f.value, GreaterThan: v > f.value, GreaterThanOrEqual: v >= f.value, LessThan: v < f.value, LessThanOrEqual: v <= f.value}[type(f)]


@dataclass
class _File(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, verify: bool):
        self.path, self.payload, self.verify, self.filters = path, payload, verify, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith)
        for f in filters:
            if isinstance(f, kinds) and f.attribute[0] in EARLY and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = file_system(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else "file:" if self.path.startswith("file:") else ""
        names = [f.path for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz")) and not f.base_name.startswith(("_", "."))]
        return [_File(f"{scheme}{n}") for n in sorted(names)] or [_File("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.path:
            return

        def wanted(h: dict[str, str]) -> bool | None:
            row = early_fields(h)
            if not all(holds(f, row) for f in self.filters):
                return None
            return (self.payload or self.verify) and row["record_type"] != "revisit"

        for h, block in records(_Bytes(partition.path), wanted):
            row, n = early_fields(h), h.get("warc-x-payload-length")
            body = None
            if block is not None:
                body = block.partition(b"\r\n\r\n")[2] if h.get("content-type", "").startswith("application/http") else block
                n = len(body)
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                if self.verify and row["payload_digest"] not in (None, digest):
                    raise ValueError(f"payload of {row['record_id']} does not match its digest")
                row["payload_digest"] = digest
            yield (row["record_id"], row["record_type"], row["target_uri"], row["page_id"], None if n is None else int(n), row["payload_digest"], row["refers_to"], h, body if self.payload else None)


class WarcDataSource(DataSource):
    """format("warc"): options path, payload (true: decode payloads), verify (true: decode and check digests)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "false") == "true", self.options.get("verify", "false") == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


@F.pandas_udf(T.StringType())
def _base32(hexes):
    return hexes.map(lambda x: base64.b32encode(bytes.fromhex(x)).decode())


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write one record for each row; equal payloads of at least `least_bytes` bytes are stored once."""
    register(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    often = materialise(rows.where(F.octet_length("html") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"))
    rows = checked_join(rows, often, "sha1", "left")
    revisit = F.coalesce((F.col("first") != F.col("page_id")) | F.col("page_id").isNull(), F.lit(False)) & F.col("first").isNotNull()
    out = rows.select("page_id", "url", "html", _base32("sha1").alias("payload_digest"), F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    out.write.format("warc").option("path", path).mode("append").save()


def read_warc(spark: SparkSession, path: str, payload: bool = False, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).option("verify", str(verify).lower()).load()


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive `pages` in the shared folder and read the archives back; payloads are decoded and checked.

    The archives are read when the result is; the driver deletes them when its session ends.
    """
    path = shared_dir(pages.sparkSession)
    write_warc(pages, path)
    delete_at_exit(pages.sparkSession, path)
    return read_warc(pages.sparkSession, path, verify=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")


ORACLE_SQL = """
with p as (select page_id, url, encode(coalesce(html, '')) b, sha1(encode(coalesce(html, ''))) h from pages),
x as (select *, max(page_id) over (partition by h) m from p)
select page_id, octet_length(b) payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(h, cast(1 + 10 * (i // 8) as bigint), 10) as bigint) >> cast(35 - 5 * (i % 8) as bigint)) & 31 as bigint), 1)), '') payload_digest,
  case when page_id = m then 'response' else 'revisit' end record_type, case when page_id <> m then m end refers_to, url target_uri
from x
"""
