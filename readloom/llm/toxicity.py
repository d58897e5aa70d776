"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Training takes at most ``FIT_ROWS`` labelled texts outside fold 0 (those whose ids have the smallest hashes; rows that repeat an
id and its text count once, and of several texts under one id the ``PER_ID`` with the smallest hashes). Every hashed
n-gram's document counts in both classes are summed over that sample; the ``WIDTH`` n-grams with the largest likelihood
ratio statistic are the features, each scaled by its log-count ratio; a logistic regression is fitted on them. Only these
features travel to the executors. Scoring reads whole texts and nothing but texts.

Null and empty texts score by the intercept alone. Labels that are null don't count; a document labelled twice is toxic
if any of its labels says so. Without labels, or with one class only, every score is the smoothed share of toxic labels.
Extra columns pass through score() unless they clash with ``score`` and ``predicted``, which win. Texts of any length: n-grams
are made of 512 KB at a time, in spans that overlap.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold, map_batches, materialize, utf8
from .textops import char_grams, distinct, logistic

FIT_ROWS, PER_ID, WIDTH, ORDERS, BITS = 20_000, 4, 2048, (3, 4, 5, 6), 22
RANGES = 64
FOLDS, HELD_OUT = 5, 0


@dataclasses.dataclass
class Model:
    """Hash of each feature (sorted), its weight times its ratio, the intercept, and the ratios."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float
    ratios: np.ndarray = dataclasses.field(default_factory=lambda: np.zeros(0))


def _present(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) pairs, once each."""
    kept: list[np.ndarray] = []

    def once():
        both = distinct(np.concatenate(kept))
        return both >> BITS, both & ((1 << BITS) - 1)

    for value, doc in char_grams(texts, ORDERS, BITS):
        if not len(value):
            continue
        if kept and kept[0][0] >> BITS != doc[0]:  # another step: the texts before it are done
            yield once()
            kept = []
        kept.append(doc.astype(np.int64) << BITS | value)
        if sum(map(len, kept)) > 1 << BITS:  # spans of a long text
            kept = [distinct(np.concatenate(kept))]
    if kept:
        yield once()


def sample(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """toxic, text, doc_id, h of the training rows; a written table of at most ``rows`` ids with ``PER_ID`` texts each."""
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_fold("doc_id", FOLDS) != HELD_OUT))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # At most ``rows`` ids with a label: this side's size is bounded.
    found = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    own = found.groupBy("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).agg(F.first("toxic").alias("toxic"), F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("h"))
    return materialize(own.withColumn("place", place).where(F.col("place") <= PER_ID).select("toxic", "text", "doc_id", "h"))


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, width: int = WIDTH) -> Model:
    chosen = sample(documents, labels, rows)
    sizes = {r["toxic"]: r["n"] for r in chosen.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((n1 + 0.5) / (n0 + 0.5))) if n1 + n0 else -1.0)

    def counts(batches):
        total = np.zeros((2, 1 << BITS), np.int32)
        seen = False
        for batch in batches:
            toxic = np.array([x > 0 for x in batch.column(0).to_pylist()], bool)
            seen = seen or batch.num_rows > 0
            for doc, feature in _present(utf8(batch.column(1))):
                for k in (0, 1):
                    np.add.at(total[k], feature[toxic[doc] == bool(k)], 1)
        if seen:
            per = (1 << BITS) // RANGES
            for r in range(RANGES):
                part = np.ascontiguousarray(total[:, r * per : (r + 1) * per])
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["range", "counts"])

    def choose(key, t):
        """The range's counts together, and its best features."""
        q, p = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in t.column("counts").to_pylist()).reshape(2, -1)
        at = np.flatnonzero(p + q >= 3)
        p, q = p[at], q[at]

        def term(x, n, of):  # x ln(x / expected) for one cell
            return np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / (n * of)), 0.0)

        share = (p + q) / (n1 + n0)
        g2 = 2 * (term(p, n1, share) + term(q, n0, share) + term(n1 - p, n1, np.maximum(1 - share, 1e-12)) + term(n0 - q, n0, np.maximum(1 - share, 1e-12)))
        ratio = np.log((p + 0.5) / (n1 + 1)) - np.log((q + 0.5) / (n0 + 1))
        best = np.lexsort((at, -g2))[:width]
        feature = at[best] + key[0].as_py() * ((1 << BITS) // RANGES)
        return pa.table({"feature": feature.astype(np.int64), "g2": g2[best], "ratio": ratio[best]})

    found = (
        chosen.mapInArrow(counts, "range int, counts binary")
        .groupBy("range").applyInArrow(choose, "feature long, g2 double, ratio double")
        .orderBy(F.desc("g2"), "feature").limit(width).toPandas().sort_values("feature")
    )
    features, ratios = found["feature"].to_numpy(np.int64), found["ratio"].to_numpy()

    def hits(batches):
        for batch in batches:
            row, column = _hits(utf8(batch.column(1)), features)
            parts = np.split(column.astype(np.int16), np.searchsorted(row, np.arange(1, batch.num_rows)))
            toxic = pa.array([int(x > 0) for x in batch.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([toxic, pa.array([p.tobytes() for p in parts], pa.binary()), batch.column(2), batch.column(3)], ["toxic", "hits", "doc_id", "h"])

    got = chosen.mapInArrow(hits, "toxic int, hits binary, doc_id long, h long").toPandas().sort_values(["doc_id", "h"])
    columns = [np.frombuffer(x, np.int16).astype(np.int64) for x in got["hits"]]
    row = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    column = np.concatenate(columns) if columns else np.zeros(0, np.int64)
    w = logistic(row, column, ratios[column], got["toxic"].to_numpy(float), len(features), ridge=1e-4)
    used = np.abs(w[:-1] * ratios) > 1e-6
    return Model(features[used], (w[:-1] * ratios)[used], float(w[-1]), ratios[used])


def _hits(texts: list[bytes], features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, index of feature) pairs, once each, sorted."""
    known = np.zeros(1 << BITS, np.int16)
    known[features] = np.arange(1, len(features) + 1)
    found = []
    for value, doc in char_grams(texts, ORDERS, BITS):
        index = known[value]
        at = np.flatnonzero(index)
        found.append(distinct(doc[at].astype(np.int64) << 16 | index[at]))
    both = distinct(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both >> 16, (both & 0xFFFF) - 1


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted."""
    keep = [f for f in df.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in keep]
    at = names.index(text)

    def make():
        def f(batch):
            texts = utf8(batch.column(at))
            row, column = _hits(texts, model.features)
            z = np.bincount(row, model.weights[column], len(texts)) + model.intercept
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

        return f

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "score double, predicted int"])
    return map_batches(df.select(*(F.col(f"`{n}`") for n in names)), make, schema)


def op7(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", F.coalesce(crc_fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
