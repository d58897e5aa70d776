"""Helpers that the operators share: tables, the shared folder, Arrow batches and broadcast checks."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a vectorised loop works on. Longer texts are cut into spans (textops.spans).
STEP_BYTES = 1 << 19
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Written tables are zstd without checksum files. On local disks Hadoop starts a chmod for each new file, and until that
#: runs, its process shares, and is counted with, the JVM's whole memory; checksum files would double them.
WRITTEN = {"compression": "zstd", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id: Column | str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only a local session, whose tasks run in the driver's process, may leave that setting unset: the driver's temp folder
    then serves. On a cluster executors could not see it, so there it is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _local_root()
    path = f"{root.rstrip('/')}/readloom-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


@functools.cache
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="readloom-")


def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended: nothing is left to ask
            return


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession):
    """Spark deletes the shuffle files of a job that runs meanwhile as soon as the job is done."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write a table in the shared folder and read it again: lineage ends here and survives lost executors.

    What the job shuffled is deleted with its end, as nothing but the written table is used from then on.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write.options(**WRITTEN)
    with brief_shuffles(spark):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._readloom_path = path
    return out


@contextlib.contextmanager
def bucketed(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """A table like materialize()'s in as many buckets of ``key`` as a shuffle has partitions: grouping by the key needs no
    shuffle of it. It has a name in the session's catalog meanwhile and is deleted afterwards."""
    spark = df.sparkSession
    path, name = shared_dir(spark), f"readloom_{uuid.uuid4().hex}"
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    with brief_shuffles(spark):
        df.write.options(**WRITTEN).option("path", path).format("parquet").bucketBy(buckets, key).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)


def discard(df: DataFrame | None) -> None:
    """Deletes a table that materialize() wrote and nothing reads any more."""
    if path := getattr(df, "_readloom_path", None):
        remove(df.sparkSession, path)


def in_steps(lengths: list[int], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes together, or one longer row, which spans() then cuts."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | list[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with a function that ``make`` builds once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                yield from out if isinstance(out, list) else [out]

    return df.mapInArrow(run, schema)


def strings(column: pa.Array) -> list[str]:
    """The texts; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """The texts in UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
