"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each text. Expectation-maximisation over the counts of vote
patterns (all documents; patterns are few) estimates each labeller's accuracy in both classes and the share of good
texts. The posteriors label a bounded sample, on which a linear scorer with hashed features is trained; it scores every text.
The sample is of distinct texts: those with the smallest hashes, ``FIT_ROWS`` and ``FIT_BYTES`` of them at most (one at least),
each weighing as much as the rows that have it. It doesn't depend on how the table is partitioned.

Null and empty texts are bad by the length labeller. Repeated rows count as often as they occur and get equal scores; a table
of one text only gives it the label model's posterior in essence. With no rows, nothing is learned and nothing returned.
Columns named as the results are replaced, others pass. Texts of any length: 512 KB are worked on at a time; of a longer text
8 bytes are kept for each distinct word and line besides.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_steps, map_batches, materialize, utf8
from .textops import STEP_BYTES, Words, line_spans, logistic, mix, word_spans

FIT_ROWS, FIT_BYTES, BITS = 20_000, 128 << 20, 14
GOOD, BAD, NONE = 1, 0, 2
#: Labeller: measure, votes bad from here on, votes good up to here (reversed where the first is the smaller).
LABELLERS = (
    ("symbols", "symbol_share", 0.12, 0.03),
    ("capitals", "upper_share", 0.40, 0.15),
    ("echo", "echo_share", 0.20, 0.05),
    ("separators", "lone_share", 0.20, 0.05),
    ("lines", "line_copy_share", 0.40, 0.10),
    ("length", "n_words", 5, 20),
    ("variety", "distinct_share", 0.20, 0.35),
    ("digits", "digit_share", 0.30, 0.10),
    ("suffixes", "marked_share", 0.30, 0.08),
)
#: Measures that are smaller for bad texts.
FALLING = {"n_words", "distinct_share"}

SYMBOL = np.zeros(256, bool)
SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?"]] = True
SMALL, LARGE, DIGIT = (np.array([(a <= c <= b) for c in range(256)]) for a, b in ((97, 122), (65, 90), (48, 57)))


WHITE = (32, *range(9, 14))


def _kind(c: np.ndarray) -> np.ndarray:
    return np.select([SMALL[c], LARGE[c], DIGIT[c], c >= 128, SYMBOL[c]], [1, 2, 3, 4, 5], 6).astype(np.uint64)


def _letters(table: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over counts of bytes (texts x 256)."""
    high = np.arange(256) >= 128
    used = ~np.isin(np.arange(256), WHITE)
    return {name: table[:, mask].sum(axis=1) for name, mask in (("letters", SMALL | LARGE | high), ("used", used), ("symbols", SYMBOL), ("upper", LARGE), ("digits", DIGIT))}


def _word_counts(w: Words, carry: np.uint64 | None = None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Counts by words of each text, shapes as text << BITS | feature of each word, and the words' hashes."""
    docs, h = len(w.count), w.hashes()
    size = w.ends - w.starts
    first, last, before = (w.raw[i] for i in (w.starts, w.ends - 1, np.maximum(w.ends - 2, w.starts)))
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    if carry is not None and len(h):
        echo[0] = h[0] == carry
    masks = {"echo": echo, "lone": (size == 1) & SYMBOL[first], "marked": (size > 2) & SYMBOL[last] & SYMBOL[before]}
    shape = ((_kind(first) * np.uint64(8) + _kind(before)) * np.uint64(8) + _kind(last)) * np.uint64(32) + np.minimum(size, 15).astype(np.uint64) * np.uint64(2) + echo.astype(np.uint64)
    cells = w.doc.astype(np.int64) << BITS | (mix(shape + np.uint64(1 << 32)) >> np.uint64(64 - BITS)).astype(np.int64)
    return {"n_words": w.count, **{k: np.bincount(w.doc[m], minlength=docs) for k, m in masks.items()}}, cells, h


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The text and the hash of each line that isn't empty."""
    breaks = np.flatnonzero(w.raw == 10)
    start = np.append(0, breaks[:-1] + 1)
    filled = breaks > start
    start, end = start[filled], breaks[filled]
    return np.searchsorted(w.begin, start, "right") - 1, w.span_hashes(start, end)


def _distinct(doc: np.ndarray, h: np.ndarray, docs: int) -> np.ndarray:
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    return np.bincount(doc[order][new], minlength=docs)


def counted(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """What the measures are made of, and cells (text << BITS | shape) with their numbers. A step of texts, or one long text."""
    docs = len(texts)
    if docs == 1 and len(texts[0]) > STEP_BYTES:
        return _counted_long(texts[0])
    w = Words(texts)
    found, cells, h = _word_counts(w)
    at = np.repeat(np.arange(docs), w.sizes)
    raw = np.delete(w.raw, w.begin + w.sizes)
    table = np.bincount(at << 8 | raw, minlength=docs << 8).reshape(docs, 256)
    doc, lines = _lines(w)
    n = np.bincount(doc, minlength=docs)
    found |= _letters(table) | {"distinct": _distinct(w.doc, h, docs), "lines": n, "copied": n - _distinct(doc, lines, docs)}
    return found, *np.unique(cells, return_counts=True)


def _counted_long(text: bytes) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    table, total, shapes = np.zeros((1, 256), np.int64), {}, np.zeros(1 << BITS, np.int64)
    for at in range(0, len(text), STEP_BYTES):
        table[0] += np.bincount(np.frombuffer(text, np.uint8, min(STEP_BYTES, len(text) - at), at), minlength=256)
    words, carry = [], None
    for span in word_spans(text):
        one, cells, h = _word_counts(Words([span]), carry)
        total = {k: total.get(k, 0) + x for k, x in one.items()}
        shapes += np.bincount(cells, minlength=1 << BITS)
        words.append(np.unique(h))
        carry = h[-1] if len(h) else carry
    hashes, n = [], 0
    for span in line_spans(text):
        h = _lines(Words([span]))[1]
        n += len(h)
        hashes.append(np.unique(h))
    kept = len(np.unique(np.concatenate(hashes)))
    found = total | _letters(table) | {"distinct": np.array([len(np.unique(np.concatenate(words)))]), "lines": np.array([n]), "copied": np.array([n - kept])}
    used = np.flatnonzero(shapes)
    return found, used, shapes[used]


def measures(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The labellers' measures of each text, from its counts."""
    n, used = np.maximum(c["n_words"], 1), np.maximum(c["used"], 1)
    return {
        "symbol_share": c["symbols"] / used,
        "upper_share": c["upper"] / np.maximum(c["letters"], 1),
        "digit_share": c["digits"] / used,
        "echo_share": c["echo"] / n,
        "lone_share": c["lone"] / n,
        "marked_share": c["marked"] / n,
        "line_copy_share": c["copied"] / np.maximum(c["lines"], 1),
        "n_words": c["n_words"],
        # Long texts repeat words: what counts as distinct grows with the root of the length.
        "distinct_share": c["distinct"] / np.maximum(np.minimum(n, 12 * np.sqrt(n)), 1),
    }


def votes(found: dict[str, np.ndarray]) -> np.ndarray:
    """texts x labellers: GOOD, BAD or NONE."""
    out = []
    for _, name, bad, good in LABELLERS:
        x = found[name]
        out.append(np.select([x < bad, x >= good] if name in FALLING else [x >= bad, x <= good], [BAD, GOOD], NONE))
    return np.array(out).T


def _codes(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(v.shape[1])


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed cells (text, feature, value) and the vote codes. Words enter by their shape, measures by their decile."""
    counts, cell, n = counted(texts)
    found = measures(counts)
    rows, cols = cell >> BITS, cell & ((1 << BITS) - 1)
    values = np.sqrt(n / np.maximum(counts["n_words"], 1)[rows])
    more_rows, more_cols = [], []
    for k, (_, name, bad, good) in enumerate(LABELLERS):
        x = found[name]
        step = np.clip(np.floor((x - min(bad, good)) / abs(bad - good) * 3), -3, 6).astype(np.int64) + 3
        more_rows.append(np.arange(len(texts)))
        more_cols.append((mix((np.uint64(k + 1) << np.uint64(40)) + step.astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64))
    rows, cols = np.concatenate([rows, *more_rows]), np.concatenate([cols, *more_cols])
    return rows, cols, np.concatenate([values, np.ones(len(rows) - len(values))]), _codes(votes(found))


@dataclasses.dataclass
class LabelModel:
    """prior: share of good texts. chance[class, labeller, vote]."""

    prior: float
    chance: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        at = np.arange(v.shape[1])
        good = np.log(self.prior) + np.log(self.chance[GOOD, at, v]).sum(axis=1)
        bad = np.log(1 - self.prior) + np.log(self.chance[BAD, at, v]).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """patterns: vote rows; counts: how many texts voted so. It starts from: bad if any labeller says so."""
    n = patterns.shape[1]
    q = np.where((patterns == BAD).any(axis=1), 0.1, 0.95)
    before = None
    for _ in range(rounds):
        chance = np.empty((2, n, 3))
        for c, weight in ((GOOD, q * counts), (BAD, (1 - q) * counts)):
            for vote in range(3):
                chance[c, :, vote] = ((patterns == vote) * weight[:, None]).sum(axis=0) + 0.5
            chance[c] /= chance[c].sum(axis=1, keepdims=True)
        model = LabelModel(float(np.clip((q * counts).sum() / max(counts.sum(), 1), 0.01, 0.99)), chance)
        q = model.posterior(patterns)
        if before is not None and np.abs(q - before).max(initial=0) < 1e-7:
            break
        before = q
    return model


@dataclasses.dataclass
class Scorer:
    weights: np.ndarray
    labels: LabelModel


def sample(text: DataFrame, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> DataFrame:
    """h, weight, text: the distinct texts with the smallest hashes, as a written table of bounded size."""
    content = F.coalesce("text", F.lit(""))
    hashed = F.xxhash64(content)
    distinct = materialize(text.select(hashed.alias("h"), F.octet_length(content).cast("long").alias("size")).groupBy("h").agg(F.count("*").alias("weight"), F.min("size").alias("size")))
    # More than ``rows`` hashes pass the threshold (but for a chance in 10**9); their order makes the bound exact.
    share = min(1.0, (rows + 10 * math.sqrt(rows) + 50) / max(1, distinct.count()))
    few = distinct.where(F.col("h") <= F.lit(min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64))))).orderBy("h").limit(rows)
    before = F.sum("size").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1))  # of ``rows`` rows at most
    chosen = few.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") + F.when(F.col("before") > 0, F.col("size")).otherwise(0) <= size)
    # At most ``rows`` hashes and weights: this side's size is bounded.
    found = text.select(hashed.alias("h"), content.alias("text")).join(F.broadcast(chosen.select("h", "weight")), "h")
    return materialize(found.groupBy("h").agg(F.first("weight").alias("weight"), F.first("text").alias("text")))


def fit(documents: DataFrame, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> Scorer:
    """Votes of all texts for the label model; a bounded sample for the linear scorer."""

    def make():
        def f(batch):
            texts = utf8(batch.column(0))
            found = [_codes(votes(measures(counted(texts[a:b])[0]))) for a, b in in_steps([len(t) for t in texts])]
            codes, n = np.unique(np.concatenate(found), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])

        return f

    text = documents.select("text")
    told = map_batches(text, make, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    codes = np.array([r["code"] for r in told], np.int64)
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    labels = expectation_maximisation(patterns, np.array([r["n"] for r in told], float))
    total = sum(r["n"] for r in told)
    if not total:
        return Scorer(np.zeros((1 << BITS) + 1), labels)
    picked = sample(text, rows, size)

    def cells(batch_iter):
        for batch in batch_iter:
            texts = utf8(batch.column(2))
            for a, b in in_steps([len(t) for t in texts]):
                r, c, v, code = _features(texts[a:b])
                order = np.argsort(r, kind="stable")
                cuts = np.searchsorted(r[order], np.arange(1, b - a))
                blobs = [[x.tobytes() for x in np.split(col[order].astype(t), cuts)] for col, t in ((c, np.int16), (v, np.float32))]
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(code), *(pa.array(x, pa.binary()) for x in blobs)], ["h", "weight", "code", "columns", "values"])

    got = picked.mapInArrow(cells, "h long, weight long, code long, columns binary, values binary").toPandas().sort_values("h")
    columns = [np.frombuffer(x, np.int16).astype(np.int64) for x in got["columns"]]
    row = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    values = np.concatenate([np.frombuffer(x, np.float32) for x in got["values"]]).astype(float)
    target = labels.posterior(got["code"].to_numpy(np.int64)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3)
    weight = got["weight"].to_numpy(float)
    return Scorer(logistic(row, np.concatenate(columns), values, target, 1 << BITS, ridge=1e-4, weights=weight * len(weight) / weight.sum()), labels)


def score(df: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """Adds quality (0 to 1, higher: better), posterior (the label model's) and keep (quality of at least 0.5)."""
    new = ("quality", "posterior", "keep")
    names = [n for n in df.columns if n not in new]
    at = names.index(text)

    def make():
        def f(batch):
            texts = utf8(batch.column(at))
            p, q = [], []
            for a, b in in_steps([len(t) for t in texts]):
                r, c, v, code = _features(texts[a:b])
                z = np.bincount(r, v * scorer.weights[c], b - a) + scorer.weights[-1]
                p.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
                q.append(scorer.labels.posterior(code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3))
            p = np.concatenate(p)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(np.concatenate(q)), pa.array(p >= 0.5)], [*names, *new])

        return f

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names), "quality double, posterior double, keep boolean"])
    return map_batches(df.select(*(F.col(f"`{n}`") for n in names)), make, schema)


def op1(documents: DataFrame) -> DataFrame:
    return score(documents.select("doc_id", "text"), fit(documents)).drop("text")


__all__ = ["LABELLERS", "LabelModel", "Scorer", "counted", "expectation_maximisation", "fit", "measures", "op1", "sample", "score", "votes"]
