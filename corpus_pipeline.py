"""The corpus pipeline: toxicity, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept. All but the last return the columns
of documents; each result is written and read again before the next stage. Null and empty texts are not toxic by
themselves, are rejected by the quality stage, and never near-duplicates. Rows with a null id pass the filters like others.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from readloom.llm import neardup, packing, quality, toxicity
from readloom.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity classifier, trained on the labelled rows of ``docs``, does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the weak-label quality scorer keeps."""
    return quality.score(docs, quality.fit(docs)).where("keep").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row, that with the smallest id. Rows without words or without an id stay."""
    return neardup.one_of_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and place."""
    return packing.op2(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", one_of_each_group),
    ("packing", pack_sequences),
]

#: Trained stages have no SQL; their operators are tested against brute force in tests/llm, the stages against their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs


__all__ = ["ORACLE_SQL", "STAGES", "run"]
