"""The per-read plan on a stream: every operator on single reads is a stateless map, so append mode needs no watermark.

Mates of an interleaved source that arrive in one row (a_..., b_...) run the same way; mates in different rows would need
a join of two streams, which no batch behaviour here calls for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from readloom.operators import pairs
from readloom.operators.reads import single
from readloom.plans.config import TrimConfig


def trim_stream(reads: DataFrame, cfg: TrimConfig) -> DataFrame:
    """Reads with header, seq, plus, qual and offset; adds windows, keep, route and the trimmed read."""
    return single(reads, cfg.validate())


def trim_pair_stream(rows: DataFrame, cfg: TrimConfig) -> DataFrame:
    return pairs.processed(rows, cfg.validate())


def write_stream(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet, partitioned by route; what is there is read once (available now)."""
    return df.writeStream.format("parquet").partitionBy("route").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
