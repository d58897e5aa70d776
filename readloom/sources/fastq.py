"""FASTQ files to rows and back.

A quality line may begin with '@', so a split can't find a record by looking at it. Plain files are read in two passes:
Spark tasks count the line ends of every byte range; their running sums tell each range the number of its first line, and
with it where records begin and what their place in the file is. Neighbouring ranges share a task. Gzip files can't be split and are
a task each.

Carriage returns go; line ends at a file's end are no lines; an incomplete last record is dropped. Bytes are taken as
Latin-1 (validation lets only ASCII pass), so what is rejected can be written as it was.
"""

from __future__ import annotations

import contextlib
import itertools
import logging
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.sources import files

RANGE, ROWS = 64 << 20, 20_000
SCHEMA = "input_id long, mate int, ordinal long, header string, seq string, plus string, qual string"
_RANGE = "input_id: long, mate: int, path: string, start: long, end: long, content: long, lines: long"
_FIELDS = ("input_id", "mate", "ordinal", "header", "seq", "plus", "qual")
_TYPES = (pa.int64(), pa.int32(), pa.int64(), *[pa.string()] * 4)
log = logging.getLogger(__name__)


def count_lines(f: BinaryIO, start: int, end: int) -> int:
    n = 0
    f.seek(start)
    left = end - start
    while left and (block := f.read(min(left, 1 << 20))):
        n += block.count(b"\n")
        left -= len(block)
    return n


def records(f: BinaryIO, at: int, line: int, start: int, end: int | None) -> Iterator[tuple[int, list[str]]]:
    """(ordinal, four lines) of the records that begin in [start, end). f stands at ``at``, where line ``line`` begins."""
    block: list[str] = []
    begin = at
    for raw in f:
        if not block:
            begin = at
            if end is not None and begin >= end:
                return
        at += len(raw)
        number = line
        line += 1
        if not block and number % 4:
            continue  # the end of a record that begins in an earlier range
        if begin < start:
            continue
        block.append(raw.replace(b"\r", b"").rstrip(b"\n").decode("latin-1"))
        if len(block) == 4:
            yield number // 4, block
            block = []
    if block and any(block):
        log.warning("an incomplete record at the end was dropped")


class _Until:
    """Lines of a file up to a position, so that line ends after the content are not lines."""

    def __init__(self, f: BinaryIO, left: int):
        self.f, self.left = f, left

    def __iter__(self):
        for raw in self.f:
            if self.left <= 0:
                return
            yield raw[: self.left] if len(raw) > self.left else raw
            self.left -= len(raw)


def range_records(f: BinaryIO, start: int, end: int, lines_before: int, content_end: int) -> Iterator[tuple[int, list[str]]]:
    """Records of a plain file that begin in a range; ``lines_before``: line ends before ``start``."""
    f.seek(max(0, start - 1))
    if start == 0:
        yield from records(_Until(f, content_end), 0, 0, 0, end)
        return
    skipped = f.readline()  # up to the first line that begins in the range
    at = start - 1 + len(skipped)
    first = lines_before if skipped == b"\n" else lines_before + 1
    if at < min(end, content_end):
        yield from records(_Until(f, content_end - at), at, first, start, end)


def ranges_records(ranges: list[dict]) -> Iterator[tuple[int, list[str]]]:
    """Records of several ranges of one file, which is opened once."""
    with files.open_raw(ranges[0]["path"]) as f:
        for r in ranges:
            yield from range_records(f, r["start"], r["end"], r["lines"], r["content"])


def _without_tail(f: BinaryIO) -> Iterator[bytes]:
    """Lines, without empty ones at the end."""
    held: list[bytes] = []
    for raw in f:
        if raw.strip(b"\r\n"):
            yield from held
            held = []
            yield raw
        else:
            held.append(raw)


def batches(found: Iterator[tuple[int, list[str]]], input_id: int, mate: int) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(found, ROWS)):
        columns = zip(*((input_id, mate, n, *lines) for n, lines in part), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], list(_FIELDS))


def _tasks(ranges: list[tuple], least: int, cores: int) -> list[int]:
    """The task of each range: neighbours share one up to RANGE bytes, or less if cores would idle. A packed file is a task."""
    most = max(least, min(RANGE, -(-sum(r[4] - r[3] for r in ranges if r[4] >= 0) // (2 * cores))))
    out, task, size = [], -1, 0
    for _, _, _, start, end, _ in ranges:
        if not out or end < 0 or size < 0 or size + end - start > most:
            task, size = task + 1, 0
        size = -1 if end < 0 else size + end - start
        out.append(task)
    return out


def read_fastq(spark: SparkSession, inputs: list[tuple[int, int, str]], range_bytes: int = RANGE, first: int | None = None) -> DataFrame:
    """Rows of SCHEMA from (input_id, mate, path) triples; ``ordinal`` is a record's place in its file.

    With ``first``, the records at places below it; a task a file reads up to there.
    """
    ranges = []
    for input_id, mate, path in inputs:
        if files.is_gzip(path):
            ranges.append((input_id, mate, path, 0, -1, -1))
            continue
        end = files.end_of_content(path)
        step = range_bytes if first is None else max(end, 1)
        ranges += [(input_id, mate, path, a, min(a + step, end), end) for a in range(0, end, step)]
    if not ranges:
        return spark.createDataFrame([], SCHEMA)
    tasks = _tasks(ranges, range_bytes, spark.sparkContext.defaultParallelism) if first is None else list(range(len(ranges)))

    def deal(placed: list[tuple]) -> DataFrame:
        """A row, and a partition, a task."""
        rows = [(t, [r for _, r in own]) for t, own in itertools.groupby(zip(tasks, placed, strict=True), key=lambda x: x[0])]
        return spark.createDataFrame(rows, f"task int, ranges array<struct<{_RANGE}>>").repartitionByRange(len(rows), "task")

    def of_files(parts) -> Iterator[list[dict]]:
        """A task's ranges of one file."""
        for batch in parts:
            for found in batch.column(1).to_pylist():
                for _, own in itertools.groupby(found, key=lambda r: (r["input_id"], r["mate"], r["path"])):
                    yield list(own)

    def count(parts):
        for group in of_files(parts):
            if group[0]["end"] < 0:
                continue
            with files.open_raw(group[0]["path"]) as f:
                n = [count_lines(f, r["start"], r["end"]) for r in group]
            told = [(r["input_id"], r["mate"], r["path"], r["start"], k) for r, k in zip(group, n, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*told, strict=True)], ["input_id", "mate", "path", "start", "n"])

    counted: dict[tuple, int] = {}
    if len(ranges) > len(inputs):
        told = deal([(*r, 0) for r in ranges]).mapInArrow(count, "input_id long, mate long, path string, start long, n long")
        counted = {tuple(r)[:4]: r["n"] for r in told.collect()}
    before: dict[tuple, int] = {}
    placed = []
    for r in ranges:
        placed.append((*r, before.get(r[:3], 0)))
        before[r[:3]] = before.get(r[:3], 0) + counted.get(r[:4], 0)

    def read(parts):
        for group in of_files(parts):
            r = group[0]
            with contextlib.ExitStack() as opened:
                if r["end"] < 0:
                    found = records(_without_tail(opened.enter_context(files.open_text(r["path"]))), 0, 0, 0, None)
                else:
                    found = ranges_records(group)
                yield from batches(itertools.islice(found, first), r["input_id"], r["mate"])

    return deal(placed).mapInArrow(read, SCHEMA)


class _FilePartition(InputPartition):
    def __init__(self, number: int, path: str):
        super().__init__(number)
        self.path = path


class FastqReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_FilePartition(k, p) for k, p in enumerate(self.paths)]

    def read(self, partition):
        with files.open_text(partition.path) as f:
            yield from batches(records(_without_tail(f), 0, 0, 0, None), partition.value, 0)


class FastqSource(DataSource):
    """Format "fastq": option path (several between commas), a partition a file. read_fastq() splits large files."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastqReader([p.strip() for p in self.options["path"].split(",") if p.strip()])


def head(path: str, n: int) -> list[list[str]]:
    """The first n records."""
    with files.open_text(path) as f:
        return [lines for _, lines in itertools.islice(records(_without_tail(f), 0, 0, 0, None), n)]


def phred_offset(path: str, n: int = 500, given: int | None = None) -> int:
    """33 or 64, from the quality letters of the first n records. ValueError if they fit neither."""
    if given is not None:
        return given
    letters = "".join(r[3] for r in head(path, n))
    if not letters:
        raise ValueError(f"{path}: no qualities to tell the encoding from")
    if min(letters) < "@":
        return 33
    if max(letters) <= "h":
        return 64
    raise ValueError(f"{path}: qualities fit neither Phred+33 nor Phred+64")


def read_count_estimate(path: str, sample: int = 50) -> int:
    """About how many records a file holds, at least 1: its size over the mean size of its first records."""
    found = head(path, sample)
    mean = sum(sum(map(len, r)) + 4 for r in found) / len(found) if found else 0
    if not mean:
        return 1
    total = size = files.size(path)
    if files.is_gzip(path):
        with files.open_raw(path) as f:
            packed = f.read(50 << 20)
        unpacked = len(zlib.decompressobj(31).decompress(packed))
        total = size * (unpacked / len(packed) if unpacked >= 1 << 20 else 4)
    return max(1, round(total / mean))


# --- Writing -------------------------------------------------------------------------------------------------------


def write_files(df: DataFrame, folder: str, gzip_level: int | None = None, ordered: bool = False, joined: bool = True) -> dict[str, int]:
    """Writes rows (file, ordinal, record) to one file for each ``file``; returns the records written to each.

    Tasks write parts (whole gzip members when packed) under names of their own and report them. Parts are joined by a task
    a file, which is legal for gzip members too, so no byte passes the driver; with ``joined`` off, each file is a folder of
    numbered parts instead, and nothing is copied. With ``ordered``, records come by ordinal.
    """
    fs, root = files.open_fs(folder)
    staging = f"{root}/.parts"
    fs.create_dir(staging, recursive=True)
    rows = df.select("file", F.col("ordinal").cast("long"), "record")
    if ordered:
        rows = rows.repartitionByRange("file", "ordinal").sortWithinPartitions("file", "ordinal")

    def run(parts):
        import os
        import uuid

        from pyspark import TaskContext

        store, base = files.open_fs(folder)
        number, outs, counts, lows = TaskContext.get().partitionId(), {}, {}, {}
        for batch in parts:
            by_file: dict[str, list[str]] = {}
            for name, n, record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_file.setdefault(name, []).append(record)
                lows.setdefault(name, n)
            for name, found in by_file.items():
                if name not in outs:
                    path = f"{base}/.parts/{number:06d}-{uuid.uuid4().hex}"
                    outs[name] = path, store.open_output_stream(path, compression=None)
                data = "".join(r + "\n" for r in found).encode("latin-1", "replace")
                if gzip_level is not None:
                    pack = zlib.compressobj(gzip_level, zlib.DEFLATED, 31)
                    data = pack.compress(data) + pack.flush()
                outs[name][1].write(data)
                counts[name] = counts.get(name, 0) + len(found)
        for _, f in outs.values():
            f.close()
        for name, (path, _) in outs.items():
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, os.path.basename(path), number, lows[name], counts[name])], ["file", "part", "number", "low", "n"])

    told = sorted(rows.mapInArrow(run, "file string, part string, number long, low long, n long").collect(), key=lambda r: (r["file"], r["number"]))
    written = {name: sum(r["n"] for r in own) for name, own in itertools.groupby(told, key=lambda r: r["file"])}

    def gather(parts):
        store, base = files.open_fs(folder)
        for batch in parts:
            for r in batch.to_pylist():
                if joined:
                    with store.open_output_stream(f"{base}/{r['file']}", compression=None) as out:
                        for part in r["parts"]:
                            with store.open_input_stream(f"{base}/.parts/{part}", compression=None) as f:
                                while block := f.read(1 << 20):
                                    out.write(block)
                else:
                    store.create_dir(f"{base}/{r['file']}", recursive=True)
                    for k, part in enumerate(r["parts"]):
                        store.move(f"{base}/.parts/{part}", f"{base}/{r['file']}/part-{k:06d}")
            yield batch.select(["file"])

    if written:
        lists = [(name, [r["part"] for r in told if r["file"] == name]) for name in written]
        spark = df.sparkSession
        spark.createDataFrame(lists, "file string, parts array<string>").repartition(len(lists), "file").mapInArrow(gather, "file string").collect()
    fs.delete_dir(staging)
    return written


def write_empty(path: str, packed: bool) -> None:
    """An output without records: nothing, or an empty gzip member."""
    fs, name = files.open_fs(path)
    with fs.open_output_stream(name, compression=None) as out:
        out.write(zlib.compress(b"", 1, 31) if packed else b"")
