"""Files in any store that pyarrow reads: opening, gzip by content, ends of files."""

from __future__ import annotations

import functools
import gzip
import io
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def open_fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), path
    return pyarrow.fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def size(path: str) -> int:
    fs, name = open_fs(path)
    info = fs.get_file_info(name)
    if info.type != pyarrow.fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


class _Raw(io.RawIOBase):
    """An Arrow file as a raw stream that can seek."""

    def __init__(self, f):
        self.f = f

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, at, whence=0):
        return self.f.seek(at, whence)

    def tell(self):
        return self.f.tell()

    def readinto(self, buffer):
        data = self.f.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self):
        self.f.close()
        super().close()


def open_raw(path: str) -> io.BufferedReader:
    fs, name = open_fs(path)
    return io.BufferedReader(_Raw(fs.open_input_file(name)), 1 << 20)


def is_gzip(path: str) -> bool:
    """By the first two bytes; a name tells nothing. False if it can't be read."""
    try:
        with open_raw(path) as f:
            return f.read(2) == b"\x1f\x8b"
    except OSError:
        return False


def open_text(path: str) -> io.BufferedIOBase:
    """The file's bytes, unpacked if it is gzip (of one or more members)."""
    return gzip.GzipFile(fileobj=open_raw(path)) if is_gzip(path) else open_raw(path)


def end_of_content(path: str) -> int:
    """Where a plain file ends without the line ends at its end."""
    at = size(path)
    with open_raw(path) as f:
        while at:
            start = max(0, at - (1 << 16))
            f.seek(start)
            block = f.read(at - start).rstrip(b"\r\n")
            if block:
                return start + len(block)
            at = start
    return 0


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; a local session may leave that unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/readloom-{uuid.uuid4().hex}"


@functools.cache
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="readloom-")


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a table written to a shared folder, which outlives executors; and the folder."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def write_text(path: str, text: str) -> None:
    fs, name = open_fs(path)
    with fs.open_output_stream(name, compression=None) as out:
        out.write(text.encode("utf-8"))
