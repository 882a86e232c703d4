"""Operator 1: a WARC data source for Spark.

Reading: file partitions are planned from the committed index (split points every few MB of every archive), or one a
file for archives from elsewhere.  Of each record the headers are parsed first; pushed-down predicates on record type
and header columns are tested on them, and the rest of an unwanted record is skipped without decoding, by the length
that the gzip member's "sl" extra field gives (or, uncompressed, by Content-Length).  Writing: one archive a task,
a gzip member a record, published by the driver's commit alone, so a lost or repeated task leaves nothing visible.

Options: path; payload = full (default), digest (length and SHA-1 only) or none.

Defined results: a null payload is written as empty; a null target URI leaves its header out; an empty table makes an
archive folder with no records; extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringContains, StringStartsWith, WriterCommitMessage

from spotweave.llm.common import narrow_batches, shared_dir, small

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, record_date string, content_type string, payload_digest string, payload_bytes bigint, payload_sha1 string, payload binary"
#: Columns that headers alone give, and so take predicates.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "record_date": "warc-date", "content_type": "content-type"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT_BYTES = 16 << 20
READ_ROWS = 256
#: Stretches that the driver plans at most; neighbours in a file are read by one task beyond it.
MOST_STRETCHES = 50_000
COLUMNS = ["record_id", "record_type", "target_uri", "refers_to", "record_date", "payload"]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member whose extra field "sl" holds its own length and that of its content."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    total = 10 + 2 + 12 + len(body) + 8
    lengths = (total, len(data)) if max(total, len(data)) < 1 << 32 else (0, 0)
    head = struct.pack("<BBBBIBBH2sHII", 0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"sl", 8, *lengths)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def header_value(text: str) -> str:
    """A header's value stays on its line."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict) -> bytes:
    """A response record, or a revisit record, whose block keeps the HTTP headers only."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{header_value(row['record_id'])}>",
        f"WARC-Date: {row['record_date']}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(),
    ]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {header_value(row['target_uri'])}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{header_value(row['refers_to'])}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


@dataclass
class Archive(WriterCommitMessage):
    """What a task has written: the file's name and its split points, the last being its length."""

    name: str | None
    splits: list[int]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Archive:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        splits, size, out = [0], 0, None
        for b in batches:
            for row in b.select(COLUMNS).to_pylist():
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                if size - splits[-1] >= SPLIT_BYTES:
                    splits.append(size)
                data = member(record(row))
                out.write(data)
                size += len(data)
        if out is None:
            return Archive(None, [])
        out.close()
        return Archive(name, [*splits, size])

    def commit(self, messages: list[Archive | None]) -> None:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root)):
                if info.base_name.startswith("_committed-"):
                    store.delete_file(info.path)
        with store.open_output_stream(f"{root}/_committed-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([[m.name, m.splits] for m in messages if m and m.name]).encode())

    def abort(self, messages: list[Archive | None]) -> None:
        store, root = opened(self.path)
        for m in messages:
            if m and m.name:
                store.delete_file(f"{root}/{m.name}")


@dataclass
class Stretch(InputPartition):
    """Bytes of one archive, from a record's start to another's (end None: to the file's end)."""

    path: str
    start: int
    end: int | None


def parse_headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    out = {"": lines[0]}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: str):
        self.path, self.payload = path, payload
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters):
        """Takes predicates on header columns; whatever else stays with Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In | StringStartsWith | StringContains) and len(f.attribute) == 1 else None
            if column in HEADERS:
                self.tests.append((column, f))
            else:
                yield f

    @staticmethod
    def _holds(value: str | None, f) -> bool:
        if value is None:
            return False
        if isinstance(f, EqualTo):
            return value == f.value
        if isinstance(f, In):
            return value in f.value
        return value.startswith(f.value) if isinstance(f, StringStartsWith) else f.value in value

    def partitions(self) -> list[Stretch]:
        store, root = opened(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [Stretch(root, 0, None)]
        listed = [i for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File]
        manifests = [i.path for i in listed if i.base_name.startswith("_committed-")]
        if not manifests:
            return [Stretch(i.path, 0, None) for i in listed if i.base_name.endswith((".warc", ".warc.gz"))]
        found = []
        for m in manifests:
            with store.open_input_stream(m, compression=None) as f:
                found += [(f"{m.rpartition('/')[0]}/{name}", splits) for name, splits in json.loads(f.read())]
        step = max(1, -(-sum(len(splits) - 1 for _, splits in found) // MOST_STRETCHES))  # neighbours of a file go together
        marks = [(name, [*splits[:-1:step], splits[-1]]) for name, splits in found if len(splits) > 1]
        return [Stretch(name, a, b) for name, at in marks for a, b in zip(at, at[1:], strict=False)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = opened(self.path)
        rows: list[tuple] = []
        with store.open_input_file(partition.path) as f:
            end = f.size() if partition.end is None else partition.end
            f.seek(partition.start)
            stream = io.BufferedReader(_Bounded(f, end), 1 << 20)
            for row in self._gzip(stream) if partition.path.endswith(".gz") else self._plain(stream):
                if row is not None:
                    rows.append(row)
                if len(rows) >= READ_ROWS:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.binary()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def _columns(self, headers: dict[str, str]) -> dict[str, str | None] | None:
        """The header columns, or None if a pushed predicate rejects them."""
        out = {c: headers.get(h) for c, h in HEADERS.items()}
        for c in ("record_id", "refers_to"):
            out[c] = out[c].strip("<>") if out[c] is not None else None
        return out if all(self._holds(out[c], f) for c, f in self.tests) else None

    def _row(self, columns: dict[str, str | None], headers: dict[str, str], block: bytes | None) -> tuple:
        digest = headers.get("warc-payload-digest", "")
        kind, _, value = digest.partition(":")
        if kind == "sha1":
            value = base64.b32decode(value).hex() if len(value) == 32 else value.lower()
        size = sha = payload = None
        if block is not None:
            if "application/http" in (columns["content_type"] or ""):
                head, _, payload = block.partition(b"\r\n\r\n")
                told = parse_headers(head).get("content-length")
                size = int(told) if told and columns["record_type"] == "revisit" else len(payload)
            else:
                payload, size = block, len(block)
            if columns["record_type"] != "revisit":
                sha = hashlib.sha1(payload).hexdigest()
        return (*(columns[c] for c in HEADERS), value or None, size, sha, payload if self.payload == "full" else None)

    def _plain(self, f: io.BufferedReader) -> Iterator[tuple | None]:
        """A row of every record, None for one that a predicate rejects."""
        while True:
            line = f.readline()
            while line in (b"\r\n", b"\n"):
                line = f.readline()
            if not line:
                return
            head = [line]
            while (line := f.readline()).strip():
                head.append(line)
            headers = parse_headers(b"".join(head))
            length = int(headers.get("content-length", 0))
            columns = self._columns(headers)
            if columns is None or self.payload == "none":
                f.seek(length, io.SEEK_CUR) if f.seekable() else f.read(length)
                yield None if columns is None else self._row(columns, headers, None)
            else:
                yield self._row(columns, headers, f.read(length))

    def _gzip(self, f: io.BufferedReader) -> Iterator[tuple | None]:
        """The same of gzip members.  A member that tells its length holds one record, and what is not wanted of it is
        passed over; any other may hold many, which are read as they unfold."""
        while len(fixed := f.read(10)) == 10:
            if fixed[:3] != b"\x1f\x8b\x08":
                raise ValueError("not a gzip member")
            flags, used, total = fixed[3], 10, 0
            if flags & 4:
                n = struct.unpack("<H", f.read(2))[0]
                extra = f.read(n)
                used += 2 + n
                while len(extra) >= 4:
                    k = struct.unpack("<H", extra[2:4])[0]
                    if extra[:2] == b"sl" and k == 8:
                        total = struct.unpack("<I", extra[4:8])[0]
                    extra = extra[4 + k :]
            for bit in (8, 16):  # name, comment
                if flags & bit:
                    while (c := f.read(1)) not in (b"\0", b""):
                        used += 1
                    used += 1
            if flags & 2:
                used += len(f.read(2))
            member = _Member(f, total - 8 - used if total else None)
            while member.starts():
                headers = parse_headers(member.head())
                length, columns = int(headers.get("content-length", 0)), self._columns(headers)
                if columns is None or self.payload == "none":
                    row = None if columns is None else self._row(columns, headers, None)
                    if not total:
                        member.skip(length)
                else:
                    row = self._row(columns, headers, member.take(length))
                yield row
                if total:
                    break
            member.leave()


class _Member:
    """The content of a gzip member, unfolded as far as it is asked for."""

    def __init__(self, f: io.BufferedReader, size: int | None):
        self.f, self.left, self.inflate = f, size, zlib.decompressobj(-15)
        self.data, self.pending = b"", b""

    def more(self, least: int) -> None:
        """Unfolds until so many bytes are there, or to the member's end."""
        parts, have = [self.data], len(self.data)
        while not self.inflate.eof and have < least:
            if not self.pending:
                self.pending = self.f.read(1 << 14 if self.left is None else min(1 << 14, self.left))
                if not self.pending:
                    raise ValueError("a gzip member ends early")
                self.left = None if self.left is None else self.left - len(self.pending)
            parts.append(self.inflate.decompress(self.pending, max(1, least - have)))
            have += len(parts[-1])
            self.pending = self.inflate.unconsumed_tail
        self.data = b"".join(parts)

    def starts(self) -> bool:
        """Whether another record begins, past the line ends before it."""
        while True:
            self.more(4)
            rest = self.data.lstrip(b"\r\n")
            if rest or (self.inflate.eof and not rest):
                self.data = rest
                return bool(rest)
            self.data = rest

    def head(self) -> bytes:
        while b"\r\n\r\n" not in self.data and not self.inflate.eof:
            self.more(len(self.data) + 1024)
        out, _, self.data = self.data.partition(b"\r\n\r\n")
        return out

    def take(self, n: int) -> bytes:
        self.more(n)
        out, self.data = self.data[:n], self.data[n:]
        return out

    def skip(self, n: int) -> None:
        while n:
            got = len(self.take(min(n, 1 << 16)))
            if not got:
                return
            n -= got

    def leave(self) -> None:
        """To the next member: over the unread rest by its known length, else back from what was read too much."""
        if self.left is not None:
            rest = self.left + 8
            self.f.read(rest) if rest < 1 << 20 else self.f.seek(rest, io.SEEK_CUR)
        else:
            while not self.inflate.eof:
                self.more(len(self.data) + (1 << 16))
                self.data = b""
            over = self.inflate.unused_data
            self.f.read(8 - len(over)) if len(over) < 8 else self.f.seek(8 - len(over), io.SEEK_CUR)


class _Bounded(io.RawIOBase):
    """A file up to a place, for buffering."""

    def __init__(self, f, end: int):
        self.f, self.end = f, end

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self.f.read(max(0, min(len(buffer), self.end - self.f.tell())))
        buffer[: len(got)] = got
        return len(got)

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        return self.f.seek(offset, whence)

    def tell(self) -> int:
        return self.f.tell()


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "full"))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    narrow_batches(spark)


def write_warc(records: DataFrame, path: str) -> None:
    """records: record_id, record_type (response or revisit), target_uri, refers_to, record_date, payload binary."""
    register(records.sparkSession)
    records.select(*COLUMNS).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: str = "full") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)


def revisits(pages: DataFrame, least_bytes: int = 1000, id_col: str = "page_id", payload_col: str = "payload") -> DataFrame:
    """(id, sha, refers_to) of rows whose payload of at least so many bytes a row with a larger id holds too."""
    told = pages.select(F.col(id_col).alias("id"), F.unhex(F.sha2(payload_col, 256)).alias("sha"), F.octet_length(payload_col).alias("n")).where(F.col("n") >= least_bytes)
    heads = told.groupBy("sha").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    return told.select("id", "sha").join(heads, "sha").where(F.col("id") < F.col("refers_to")).distinct()


def archive_pages(pages: DataFrame, path: str, least_bytes: int = 1000) -> None:
    """A record a page (page_id, url, html): revisits refer to the equal page of the largest id."""
    page = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    again = small(revisits(page, least_bytes)).alias("r")
    found = page.alias("p").join(again, (F.col("p.page_id") == F.col("r.id")) & (F.unhex(F.sha2(F.col("p.payload"), 256)) == F.col("r.sha")), "left")
    named = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    write_warc(
        found.select(
            named("p.page_id").alias("record_id"),
            F.when(F.col("r.id").isNull(), "response").otherwise("revisit").alias("record_type"),
            F.col("p.url").alias("target_uri"),
            F.when(F.col("r.id").isNotNull(), named("r.refers_to")).alias("refers_to"),
            F.lit("2020-01-01T00:00:00Z").alias("record_date"),
            F.col("p.payload").alias("payload"),
        ),
        path,
    )


def round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Archives the pages in the shared folder and reads the records back."""
    spark = pages.sparkSession
    path = shared_dir(spark) + "/warc"
    archive_pages(pages, path, least_bytes)
    page = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as bigint)")
    back = read_warc(spark, path, payload="digest")
    return back.select(page("record_id").alias("page_id"), "payload_bytes", F.coalesce("payload_sha1", "payload_digest").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))
