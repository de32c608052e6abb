"""WARC archives as a PySpark Python data source, and deduplicating archives of payloads.

``spark.dataSource.register(WarcSource)`` gives ``spark.read.format("warc").load(folder)`` and
``df.write.format("warc").mode("append").save(folder)``. Every record is a gzip member of its own whose header names
the member's length (the ``sl`` field), so a reader inflates a record's first bytes, parses its WARC headers, and goes
on to the next record without reading the payload if a pushed predicate on record type or headers fails. Each file is a
partition. Archives without that field, and plain ``.warc`` files, are read too. Every job writes a manifest of its files
when all its tasks have ended, and a folder's manifests together list its files; what lost or repeated tasks left is in
none and is never read. The first job in a folder without manifests lists the files that were there as well.

A damaged archive raises DamagedArchive where it is read: a file that ends within a record, a record whose block is shorter
than its header says, or, where the payload is read, a wrong checksum.

Defined results: a null payload is empty, a null url leaves its header out, line ends in header values are escaped; a
record with a null id has a null id when read back; repeated rows give a record each.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from causeway.llm._common import met, written

MANIFEST = "_manifest"
#: Bytes after which a task begins another file.
FILE_BYTES = 256 << 20
HEAD_BYTES = 4096
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Column of the table and WARC header.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
READ_SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_bytes long, payload binary"
WRITE_COLUMNS = (*HEADERS, "payload_bytes", "payload")


class DamagedArchive(ValueError):
    """What is read is no whole WARC record."""


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _manifests(fs: pafs.FileSystem, path: str) -> tuple[list[str], list[str]]:
    """The manifests of a folder, and its files where it has none."""
    names = [x.base_name for x in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))]
    found = sorted(n for n in names if n.startswith(MANIFEST) and n.endswith(".json"))
    return found, [] if found else [n for n in names if n.endswith((".warc", ".warc.gz"))]


def _escaped(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def encode(row: dict) -> bytes:
    """A record as a gzip member. A revisit has the HTTP headers of its payload but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if row["record_type"] == "revisit" else http + (row["payload"] or b"")
    lines = ["WARC/1.1", *(f"{name}: {_escaped(row[c])}" for c, name in HEADERS.items() if row[c] is not None)]
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    plain = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, 24 + len(body) + 8, len(plain))
    return head + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class _Member:
    """A record at an offset of an open file, inflated only as far as it is asked for."""

    def __init__(self, file: pa.NativeFile, at: int, size: int) -> None:
        self.file, self.size, self.start = file, size, at
        raw = file.read_at(min(HEAD_BYTES, size - at), at)
        self.next, self.inflate, self.plain, self.done, self.checked = None, None, bytearray(), False, True
        if raw[:2] == b"\x1f\x8b":
            skip = 0
            if raw[3:4] == b"\x04" and raw[12:14] == b"sl" and len(raw) >= 24:
                self.next = at + struct.unpack_from("<I", raw, 16)[0]
                skip = 12 + struct.unpack_from("<H", raw, 10)[0]
                self.checked = False
                if self.next > size or self.next <= at:
                    raise self.damaged("the file ends within it")
            self.inflate = zlib.decompressobj(-15 if skip else 31)
            self.feed(raw[skip:])
        else:
            self.plain += raw
        self.at = at + len(raw)
        self.check()

    def damaged(self, why: str) -> DamagedArchive:
        return DamagedArchive(f"record at byte {self.start}: {why}")

    def feed(self, raw: bytes) -> None:
        try:
            self.plain += self.inflate.decompress(raw)
        except zlib.error as e:
            raise self.damaged(str(e)) from e

    def check(self) -> None:
        if self.inflate is not None and self.inflate.eof and not self.done:
            self.done = True
            if self.next is None:
                self.next = self.at - len(self.inflate.unused_data)
        self.done = self.done or self.at >= self.size

    def more(self) -> bool:
        if self.done:
            return False
        raw = self.file.read_at(min(1 << 16, self.size - self.at), self.at)
        self.at += len(raw)
        if self.inflate is not None:
            self.feed(raw)
        else:
            self.plain += raw
        self.check()
        return True

    def upto(self, mark: bytes, start: int = 0) -> int:
        """Where mark ends in the plain bytes, or -1."""
        while (i := self.plain.find(mark, start)) < 0:
            if not self.more():
                return -1
        return i + len(mark)

    def part(self, start: int, end: int) -> bytes:
        """These bytes of the record, the last of which end its block."""
        while len(self.plain) < end and self.more():
            pass
        if len(self.plain) < end:
            raise self.damaged("its block is shorter than its header says")
        if not self.checked:  # zlib itself looks at the checksum of members without the length field only
            while self.more():
                pass
            if not self.inflate.eof or self.file.read_at(8, self.next - 8) != struct.pack("<II", zlib.crc32(self.plain), len(self.plain) & 0xFFFFFFFF):
                raise self.damaged("its checksum is wrong")
        return bytes(self.plain[start:end])

    def end(self, block_end: int) -> int:
        """Where the next record begins."""
        if self.inflate is None:
            if self.start + block_end > self.size:
                raise self.damaged("its block is shorter than its header says")
            return min(self.size, self.start + block_end + 4)
        while self.next is None and self.more():
            pass
        if self.next is None:
            raise self.damaged("the file ends within it")
        return self.next


def records(file: pa.NativeFile, wanted, payload: bool = True) -> Iterator[tuple]:
    """Rows of READ_SCHEMA for the records whose header columns wanted() accepts."""
    at, size = 0, file.size()
    while at < size:
        member = _Member(file, at, size)
        head = member.upto(b"\r\n\r\n")
        if head < 0 or not member.plain.startswith(b"WARC/"):
            if member.inflate is None and not member.plain.strip() and not member.more():
                return  # line ends after the last record
            raise member.damaged("it has no WARC header")
        fields = _fields(bytes(member.plain[: head - 4]))
        length_said = fields.get("content-length", "")
        if not length_said.isdigit():
            raise member.damaged("it has no Content-Length")
        block = int(length_said)
        row = {c: fields.get(name.lower()) for c, name in HEADERS.items()}
        if wanted(row):
            body, length = head, block
            if "application/http" in fields.get("content-type", ""):
                body = member.upto(b"\r\n\r\n", head)
                if body < 0 or body > head + block:
                    raise member.damaged("its HTTP header does not end")
                length = int(_fields(bytes(member.plain[head : body - 4])).get("content-length", block - (body - head)))
            held = row["record_type"] != "revisit"
            yield (*row.values(), length, member.part(body, head + block) if payload and held else None)
        at = member.end(head + block)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.payload, self.tests = options["path"], options.get("payload", "true") == "true", []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In | StringStartsWith | IsNotNull) and len(f.attribute) == 1 else None
            if name in HEADERS:
                self.tests.append((type(f).__name__, name, getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for kind, name, value in self.tests:
            x = row[name]
            if x is None or (kind == "EqualTo" and x != value) or (kind == "In" and x not in value) or (kind == "StringStartsWith" and not x.startswith(value)):
                return False
        return True

    def partitions(self) -> list[_File]:
        fs, path = _file_system(self.path)
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        manifests, names = _manifests(fs, path)
        for manifest in manifests:
            with fs.open_input_stream(f"{path}/{manifest}") as f:
                names += json.loads(f.read())
        return [_File(x) for x in sorted(set(names))] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition.value:
            fs, path = _file_system(self.path)
            with fs.open_input_file(f"{path}/{partition.value}") as f:
                yield from records(f, self.wanted, self.payload)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.file_bytes = options["path"], int(options.get("file_bytes", FILE_BYTES))
        # Taken before the tasks begin: what an append must keep, and what an overwrite replaces.
        manifests, files = _manifests(*_file_system(self.path))
        self.replaced, self.present = (manifests, []) if overwrite else ([], files)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, path = _file_system(self.path)
        fs.create_dir(path, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for i in range(0, batch.num_rows, 64):
                for row in batch.slice(i, 64).to_pylist():
                    if out is None or size >= self.file_bytes:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{path}/{names[-1]}", compression=None, buffer_size=1 << 20), 0
                    member = encode(row)
                    out.write(member)
                    size += len(member)
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, path = _file_system(self.path)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{MANIFEST}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([*self.present, *(n for m in messages if m for n in m.names)]).encode())
        for name in self.replaced:
            fs.delete_file(f"{path}/{name}")

    def abort(self, messages: list[_Written | None]) -> None:
        fs, path = _file_system(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{path}/{name}")


class WarcSource(DataSource):
    """Options: path; payload ("false": payloads stay unread); file_bytes, for writing."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive_rows(df: DataFrame, key: str, url: str, html: str, *, min_bytes: int = 100, date: str = DATE) -> DataFrame:
    """A record for each row of df: of equal payloads of min_bytes or more, the row with the smallest key (null last;
    all rows with that key) is a response and the others revisit it; smaller payloads are all responses."""
    name = lambda c: F.when(c.isNotNull(), F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))).otherwise("<urn:page:>")
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("target_uri"), F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    # Only ids and digests are grouped; the payloads meet the revisits by their own id.
    seen = written(rows.where(F.col("payload_bytes") >= min_bytes).select("key", "digest"), "digests")
    first = written(seen.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    again = written(met(seen, first, ["digest"], "n").where(~F.col("first").eqNullSafe(F.col("key"))).select("key", "digest", "first").distinct().withColumn("revisit", F.lit(True)), "revisits")
    marked = rows.alias("r").join(again.alias("a"), F.expr("r.key <=> a.key AND r.digest = a.digest"), "left").select("r.*", F.col("a.first").alias("first"), F.coalesce("a.revisit", F.lit(False)).alias("revisit"))
    return marked.select(
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), name(F.col("key")).alias("record_id"), "target_uri", F.lit(date).alias("date"),
        F.when(F.col("revisit"), name(F.col("first"))).alias("refers_to"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), "payload_bytes", F.when(~F.col("revisit"), F.col("payload")).alias("payload"),
    )


def write_archive(records_df: DataFrame, path: str) -> None:
    register(records_df.sparkSession)
    records_df.select(*WRITE_COLUMNS).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
