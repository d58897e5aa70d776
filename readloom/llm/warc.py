"""WARC archives as a PySpark data source, read and written.

Files hold one gzip member a record. Each member names its own length in its header's extra field ('RL', an unsigned 64-bit
number) and the CRC-32 of the record's headers and of the packed bytes ('HC'), so a reader can trust the headers and pass over a record without
decoding its payload; members without the fields are decoded to find their end. A folder's manifest (written on commit) lists the files with the places where a partition may
begin, about every ``split`` bytes.

Reading: partitions are planned from the manifest, or one a file. A record's headers are decoded first; records whose
type or headers fail the pushed filters are passed over with their payload still compressed. With option payload=false no
payload is decoded at all. Filters that Spark pushes: equality and IN on record_type, record_id, target_uri, page_id and
payload_digest, and IS NOT NULL; comparisons on page_id.

Columns: file, offset, record_type, record_id, target_uri, page_id, payload_digest, payload_bytes, refers_to, headers
(map), payload (binary; null for records that revisit another, or if not asked for).

Nulls: a null html is an empty payload; a null url has no WARC-Target-URI; a row with a null page_id has no id header, and
is a response, for nothing can refer to it. Rows that share the smallest page_id of equal payloads are all responses.
An empty table gives an archive without files. Damage raises an error: headers are checked wherever a record is met, and a
payload that is read against the member's CRC-32 and length, the record's length, and the digest in its headers. What is
passed over is not decoded and so not checked. Payloads of any length: one is in memory at a time, packed and unpacked.
"""

from __future__ import annotations

import dataclasses
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from .common import shared_dir

MANIFEST = "_manifest.json"
SPLIT = 16 << 20
SMALL = 100
SCHEMA = "file string, `offset` long, record_type string, record_id string, target_uri string, page_id long, payload_digest string, payload_bytes long, refers_to long, headers map<string,string>, payload binary"
ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
WRITTEN = ("record_type", "target_uri", "page_id", "payload_digest", "payload_bytes", "refers_to", "payload")


def open_fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Any store that pyarrow knows; plain paths are local ones."""
    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), path
    return pyarrow.fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def urn(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


EXTRA = struct.Struct("<2sHQ2sHII")
FIXED = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"


def member(data: bytes) -> bytes:
    """One gzip member with its own length, and the CRC-32 of the headers in ``data`` and of the packed data, in the extra field."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    extra = EXTRA.pack(b"RL", 8, len(FIXED) + 2 + EXTRA.size + len(body) + 8, b"HC", 8, zlib.crc32(data[: data.find(b"\r\n\r\n") + 4]), zlib.crc32(body))
    return FIXED + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _value(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


@dataclasses.dataclass
class Written(WriterCommitMessage):
    name: str | None
    size: int
    records: int
    splits: list[int]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, split: int, overwrite: bool):
        self.path, self.split, self.overwrite = path, split, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file a task, under a name of its own; a task that runs again leaves another, which no manifest lists."""
        fs, root = open_fs(self.path)
        name, out, at, n, splits = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, 0, [0]
        try:
            for batch in iterator:
                columns = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in WRITTEN}
                for kind, uri, page, digest, size, refers, payload in zip(*columns.values(), strict=True):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    if at - splits[-1] >= self.split:
                        splits.append(at)
                    headers = [("WARC-Type", kind), ("WARC-Record-ID", urn(page) if page is not None else f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
                    if uri is not None:
                        headers.append(("WARC-Target-URI", _value(uri)))
                    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size))]
                    if kind == "revisit":
                        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", urn(refers))]
                    data = member(record(headers, b"" if kind == "revisit" else payload or b""))
                    out.write(data)
                    at, n = at + len(data), n + 1
        finally:
            if out is not None:
                out.close()
        return Written(name if n else None, at, n, splits)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        files = [] if self.overwrite else manifest(self.path) or []
        files += [{"name": m.name, "size": m.size, "records": m.records, "splits": m.splits} for m in messages if m and m.name]
        with fs.open_output_stream(f"{root}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = open_fs(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{root}/{m.name}")


def manifest(path: str) -> list[dict] | None:
    fs, root = open_fs(path)
    if fs.get_file_info(f"{root}/{MANIFEST}").type == pyarrow.fs.FileType.NotFound:
        return None
    with fs.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
        return json.loads(f.read())


@dataclasses.dataclass
class Piece(InputPartition):
    name: str
    start: int
    end: int

    def __post_init__(self):
        super().__init__(None)


COMPARE = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
TEXTS = ("record_type", "record_id", "target_uri", "payload_digest")


class Test:
    """One pushed filter over a record's head."""

    def __init__(self, column: str, kind: type, value: object):
        self.column, self.kind, self.value = column, kind, value

    def __call__(self, head: dict) -> bool:
        x = head[self.column]
        if x is None:
            return False
        if self.kind is IsNotNull:
            return True
        return x in self.value if self.kind is In else x == self.value if self.kind is EqualTo else COMPARE[self.kind](x, self.value)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, options: dict[str, str]):
        self.path, self.payload, self.tests = path, payload, []
        self.types = tuple(x for x in options.get("record_type", "").split(",") if x)

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Takes what the head of a record decides; Spark applies the rest."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            exact = isinstance(f, (EqualTo, In)) and column in (*TEXTS, "page_id", "refers_to")
            if exact or isinstance(f, IsNotNull) and column in (*TEXTS, "page_id", "refers_to") or type(f) in COMPARE and column in ("page_id", "refers_to"):
                self.tests.append(Test(column, type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Piece]:
        listed = manifest(self.path)
        if listed is None:
            fs, root = open_fs(self.path)
            info = fs.get_file_info(root)
            found = [info] if info.type == pyarrow.fs.FileType.File else fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
            files = sorted((f.path, f.size) for f in found if f.type == pyarrow.fs.FileType.File and f.base_name.endswith((".warc", ".warc.gz")))
            return [Piece(name, 0, size) for name, size in files] or [Piece("", 0, 0)]
        _, root = open_fs(self.path)
        return [Piece(f"{root}/{f['name']}", a, b) for f in listed for a, b in zip(f["splits"], [*f["splits"][1:], f["size"]], strict=True)] or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, _ = open_fs(self.path)
        found, held = [], 0
        with fs.open_input_file(partition.name) as f:
            f.seek(partition.start)
            data = io.BufferedReader(_Raw(f), 1 << 20)
            for at, head, load in records(data, partition.start, partition.end, partition.name.endswith(".gz")):
                if self.types and head["record_type"] not in self.types or not all(t(head) for t in self.tests):
                    continue
                payload = load() if self.payload else None
                if head["record_type"] == "revisit":
                    payload = None
                found.append((partition.name.rsplit("/", 1)[-1], at, *(head[k] for k in ARROW.names[2:9]), list(head["headers"].items()), payload))
                held += len(payload or b"") + 500
                if held > 8 << 20:
                    yield _batch(found)
                    found, held = [], 0
        if found:
            yield _batch(found)


def _batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), ARROW.types, strict=True)], schema=ARROW)


class _Raw(io.RawIOBase):
    """An Arrow file as a raw stream."""

    def __init__(self, f):
        self.f = f

    def readable(self):
        return True

    def readinto(self, buffer):
        data = self.f.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def _head(lines: bytes) -> dict:
    version, *rest = lines.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    headers: dict[str, str] = {}
    for line in rest:
        name, colon, value = line.partition(":")
        if colon:
            headers[name.strip()] = value.strip()
    low = {k.lower(): v for k, v in headers.items()}

    def page(name):
        x = low.get(name, "")
        return int(x[10:-1]) if x.startswith("<urn:page:") else None

    digest = low.get("warc-payload-digest")
    return {
        "record_type": low.get("warc-type"), "record_id": low.get("warc-record-id"), "target_uri": low.get("warc-target-uri"), "page_id": page("warc-record-id"),
        "digest": digest[7:] if digest and re.fullmatch("sha256:[0-9a-f]{64}", digest) and "x-payload-length" in low else None,
        "payload_digest": digest.removeprefix("sha256:") if digest else None, "payload_bytes": int(low.get("x-payload-length", low.get("content-length", "0"))),
        "refers_to": page("warc-refers-to"), "headers": headers, "length": int(low.get("content-length", "0")),
    }


def damaged(at: int, what: str) -> ValueError:
    return ValueError(f"damaged record at {at}: {what}")


def _content(at: int, head: dict, rest: bytes) -> bytes:
    """The block, from what follows the headers: the block and two line ends. Digests of our own records are checked."""
    n = head["length"]
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise damaged(at, "its length")
    block = rest[:n]
    if head["digest"] and n == head["payload_bytes"] and hashlib.sha256(block).hexdigest() != head["digest"]:
        raise damaged(at, "its digest")
    return block


def _checked(at: int, data: bytes, trailer: bytes) -> None:
    if len(trailer) < 8 or struct.unpack("<II", trailer) != (zlib.crc32(data), len(data) & 0xFFFFFFFF):
        raise damaged(at, "its checksum")


def records(data: io.BufferedReader, at: int, end: int, packed: bool):
    """(offset, head, function that decodes and checks the payload) of each record; load is good until the next step."""
    while at < end:
        if not packed:
            lines = b""
            while not lines.endswith(b"\r\n\r\n"):
                line = data.readline()
                if not line:
                    if lines.strip():
                        raise damaged(at, "it ends early")
                    return
                lines += line
            head = _head(lines[:-4])
            block = _Lazy(data, head["length"] + 4)
            yield at, head, lambda at=at, head=head, block=block: _content(at, head, block.load())
            if block.load()[head["length"] :] != b"\r\n\r\n":
                raise damaged(at, "its length")
            at += len(lines) + head["length"] + 4
            continue
        fixed = data.read(10)
        if len(fixed) < 10 or fixed[:3] != FIXED[:3]:
            raise ValueError(f"no gzip member at {at}")
        flags, used, total, header_crc, body_crc = fixed[3], 10, None, None, None
        if flags & 4:
            size = data.read(2)
            extra = data.read(int.from_bytes(size, "little"))
            used += 2 + len(extra)
            if extra[:2] == b"RL" or extra[12:14] == b"HC":  # one of ours, which has one form only
                own = EXTRA.unpack(extra) if len(extra) == EXTRA.size else ()
                if fixed != FIXED or (*own[:2], *own[3:5]) != (b"RL", 8, b"HC", 8):
                    raise damaged(at, "its member's header")
                total, header_crc, body_crc = own[2], own[5], own[6]
        for bit in (8, 16):  # file name, comment
            while flags & bit:
                c = data.read(1)
                used += 1
                if c in (b"\0", b""):
                    break
        if flags & 2:
            data.read(2)
            used += 2
        unpack = zlib.decompressobj(-15)
        if total is not None:
            if total < used + 8 or total > end - at:
                raise damaged(at, "its member's length")
            body = data.read(total - used)
            if len(body) < total - used:
                raise damaged(at, "it ends early")
            got = unpack.decompress(body, 1024)
            while b"\r\n\r\n" not in got and unpack.unconsumed_tail:
                got += unpack.decompress(unpack.unconsumed_tail, 1024)
            lines, mark, rest = got.partition(b"\r\n\r\n")
            if not mark or header_crc != zlib.crc32(lines + mark):
                raise damaged(at, "its headers")
            head = _head(lines)

            def load(at=at, unpack=unpack, got=got, lines=lines, head=head, body=body, body_crc=body_crc):
                if zlib.crc32(memoryview(body)[:-8]) != body_crc:
                    raise damaged(at, "its checksum")
                whole = got + unpack.decompress(unpack.unconsumed_tail)
                if not unpack.eof:
                    raise damaged(at, "it ends early")
                _checked(at, whole, unpack.unused_data)
                return _content(at, head, whole[len(lines) + 4 :])

            yield at, head, load
            at += total
        else:  # no length given: decode to find the end
            got = bytearray()
            while not unpack.eof:
                part = data.peek(1)
                if not part:
                    raise damaged(at, "it ends early")
                got += unpack.decompress(part)
                taken = len(part) - len(unpack.unused_data)
                data.read(taken)
                used += taken
            _checked(at, got, data.read(8))
            lines, mark, rest = bytes(got).partition(b"\r\n\r\n")
            if not mark:
                raise damaged(at, "its headers")
            head = _head(lines)
            yield at, head, lambda at=at, rest=rest, head=head: _content(at, head, rest)
            at += used + 8


class _Lazy:
    def __init__(self, data: io.BufferedReader, n: int):
        self.data, self.n, self.got = data, n, None

    def load(self) -> bytes:
        if self.got is None:
            self.got = self.data.read(self.n)
        return self.got


class WarcSource(DataSource):
    """Format "warc". Options: path, payload (true), record_type (comma list), split (bytes between partition starts)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false", dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("split", SPLIT)), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def deduplicated(pages: DataFrame) -> DataFrame:
    """The columns to write: of equal payloads of at least 100 bytes the smallest page_id is the response."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").alias("target_uri"), html.alias("html"), F.sha2(html, 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    may = rows.where(f"payload_bytes >= {SMALL} AND page_id IS NOT NULL")
    # Sums to one row a digest before the join. Only pages that may be revisits move, and the join's large side may be split
    # where one payload is frequent.
    first = may.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    alone = rows.where(f"payload_bytes < {SMALL} OR page_id IS NULL").withColumn("first", F.lit(None).cast("long"))
    revisit = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    return may.join(first, "payload_digest", "left").unionByName(alone).select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", "page_id", "payload_digest", "payload_bytes",
        F.when(revisit, F.col("first")).alias("refers_to"), F.when(~revisit, F.encode("html", "UTF-8")).alias("payload"),
    )


def write(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    deduplicated(pages).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def op4(pages: DataFrame) -> DataFrame:
    """Writes the archive to the shared folder and reads it back. Digests and lengths of responses are taken of the payload read."""
    spark = pages.sparkSession
    path = shared_dir(spark)
    write(pages, path)
    got = read(spark, path)
    response = F.col("record_type") == "response"
    return got.select(
        "page_id", F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )
