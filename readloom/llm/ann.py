"""Nearest neighbours by inner product, from shifted space-filling curves.

1. Equal vectors are one class, known by its smallest id, with its k + 1 smallest ids: more of them no answer can hold.
2. Directions are projected on 8 seeded orthogonal axes, made uniform and shifted; a Hilbert index of 7 bits an axis orders
   them. Each of ``curves`` orderings has its own axes and shift. One shuffle range-partitions all orderings by
   (curve, key, class), so no key and no ordering crowds a partition.
3. Tasks slide over the orderings in tiles: a query class is compared with the classes of its tile and ``half`` places on
   either side, as a matrix product, and keeps its k nearest there.
4. The windows' results merge: at most curves * k pairs a query class. Classes become ids, each query's own id goes.

What a query sees is ``curves`` windows of ``tile + 2 * half`` places, however many vectors there are; work, shuffle and
memory are linear in the vectors. Recall depends on how much of the neighbourhood the windows hold; see README for measured
figures (unstructured vectors in 64 dimensions are the worst case there is). Scores are exact: doubles summed in one order for
all pairs, so equal vectors tie exactly; ties go to the smaller id.

Vectors that are null, zero, of another length than most (ties: the longer), or hold null or non-finite components take no
part; nor do null ids. Ids are taken to be unique: candidates with the query's id are its own row. With fewer candidates
than k all are returned. An empty table gives no rows. Extra columns stay out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize

K, EVERY, CURVES, AXES, BITS, SEED = 20, 20, 48, 8, 7, 11
TILE, HALF = 512, 256
#: Rows of a partition of the orderings.
ROWS = 1 << 18


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of rows of integers below 2**bits (Skilling's transposition, for all rows at once)."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | ((axis ^ t) >> b) & 1
    return key


def curve_keys(unit: np.ndarray, curve: int) -> np.ndarray:
    """Place of each direction on one curve."""
    d = unit.shape[1]
    rng = np.random.default_rng(SEED + curve)
    axes = np.linalg.qr(rng.standard_normal((d, d)))[0][:, : min(AXES, d)]
    # About standard normal on every axis; the logistic curve makes it about uniform.
    place = 1 / (1 + np.exp(-1.702 * (unit @ axes) * np.sqrt(d)))
    shifted = (place * 0.75 + rng.random(axes.shape[1]) * 0.25) * (1 << BITS)
    return hilbert(np.minimum(shifted.astype(np.int64), (1 << BITS) - 1), BITS)


def usable(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id") -> tuple[DataFrame, np.dtype]:
    """vec_id, v (the components' bytes): the vectors that take part; and the components' type."""
    single = df.schema[vector].dataType.elementType.simpleString() == "float"
    x = F.col(vector).cast(f"array<{'float' if single else 'double'}>")
    fine = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("x", lambda c: c != 0)
    )
    most = fine.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    kind = np.dtype(np.float32 if single else np.float64)

    def make():
        def f(batch):
            # Adding 0 makes a negative zero a positive one: equal vectors have equal bytes.
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)
            rows = [r.tobytes() for r in v.reshape(batch.num_rows, -1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["vec_id", "v"])

        return f

    return map_batches(fine.where(F.size("x") == (most["d"] if most else 1)), make, "vec_id long, v binary"), kind


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in one order."""
    return np.add.reduce(np.ascontiguousarray(q * v), axis=1)


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, score) of the k nearest in v, without the query's own id. Memory is a few times q @ v.T."""
    rough = q @ v.T
    rough[q_ids[:, None] == ids[None, :]] = -np.inf
    slack = 1e-11 * np.linalg.norm(q, axis=1) * max(np.linalg.norm(v, axis=1).max(initial=0), 1e-300)
    floor = np.full(len(q), -np.inf)
    if rough.shape[1] > k:
        floor = np.partition(rough, -k, axis=1)[:, -k] - slack
    row, col = np.nonzero((rough >= floor[:, None]) & (rough > -np.inf))
    score = np.empty(len(row))
    for a in range(0, len(row), 1 << 16):  # many may tie
        score[a : a + (1 << 16)] = scores(q[row[a : a + (1 << 16)]], v[col[a : a + (1 << 16)]])
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[col][keep], score[keep]


def in_curve_order(classes: DataFrame, n: int, kind: np.dtype, curves: int) -> DataFrame:
    """curve, key, cid, asked, v: every class once an ordering, partitions in order."""

    def make():
        def f(batch):
            v = np.frombuffer(b"".join(batch.column(2).to_pylist()), kind).reshape(batch.num_rows, -1).astype(np.float64)
            unit, m = v / np.linalg.norm(v, axis=1, keepdims=True), batch.num_rows
            return [
                pa.RecordBatch.from_arrays([pa.array(np.full(m, c, np.int32)), pa.array(curve_keys(unit, c)), *batch.columns], ["curve", "key", "cid", "asked", "v"])
                for c in range(curves)
            ]

        return f

    keyed = map_batches(classes.select("cid", "asked", "v"), make, "curve int, key long, cid long, asked boolean, v binary")
    return keyed.repartitionByRange(max(1, -(-n * curves // ROWS)), "curve", "key", "cid").sortWithinPartitions("curve", "key", "cid")


FOUND = "cid long, other long, score double"


def windows(ordered: DataFrame, kind: np.dtype, k: int, tile: int, half: int) -> DataFrame:
    """cid, other, score: the k nearest classes of each query class in its windows."""

    def compared(ids, asked, v, begin, end):
        """Tiles from place ``begin`` on that end by ``end``; the next tile's place."""
        out = []
        while begin < end:
            a, b = max(0, begin - half), begin + tile + half
            own = np.flatnonzero(asked[begin : begin + tile]) + begin
            if len(own):
                row, near, score = nearest(ids[own], v[own], ids[a:b], v[a:b], k)
                out.append(pa.RecordBatch.from_arrays([pa.array(ids[own][row]), pa.array(near), pa.array(score)], ["cid", "other", "score"]))
            begin += tile
        return out, begin

    def run(batches):
        at, held, place = None, None, 0  # the curve, what is held of it, the next tile's place therein
        for batch in batches:
            curve = batch.column(0).to_numpy()
            ids, asked = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            v = np.frombuffer(b"".join(batch.column(4).to_pylist()), kind).reshape(batch.num_rows, -1).astype(np.float64)
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(curve)) + 1):
                if len(part) and curve[part[0]] != at:
                    if held is not None:
                        yield from compared(*held, place, len(held[0]))[0]
                    at, held, place = curve[part[0]], None, 0
                new = (ids[part], asked[part], v[part])
                held = new if held is None else tuple(map(np.concatenate, zip(held, new, strict=True)))
                whole = len(held[0]) - half - tile  # tiles that begin by here have their right side
                if whole >= place + 8 * tile:
                    out, place = compared(*held, place, whole + 1)
                    yield from out
                    gone = max(0, place - half)
                    held, place = tuple(x[gone:] for x in held), place - gone
        if held is not None:
            yield from compared(*held, place, len(held[0]))[0]

    return ordered.mapInArrow(run, FOUND)


def search(df: DataFrame, k: int = K, every: int = EVERY, vector: str = "embedding", id_col: str = "vec_id", curves: int = CURVES, tile: int = TILE, half: int = HALF) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    vectors, kind = usable(df, vector, id_col)
    vectors = materialize(vectors)
    # The k + 1 smallest ids of equal vectors: Spark limits each task's share before it shuffles.
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = vectors.withColumn("place", place).where(F.col("place") <= k + 1)
    classes = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("cid"), "v", "ids")
    classes = materialize(classes)
    queries = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    queries = materialize(queries.join(classes.select("v", "cid"), "v").select("query_id", "cid"))
    asked = queries.select("cid").distinct().withColumn("asked", F.lit(True))
    marked = materialize(classes.select("cid", "v").join(asked, "cid", "left").select("cid", F.coalesce("asked", F.lit(False)).alias("asked"), "v"))
    found = windows(in_curve_order(marked, marked.count(), kind, curves), kind, k, tile, half)
    pairs = F.collect_set(F.struct((-F.col("score")).alias("s"), "other"))  # at most curves * k
    best = found.groupBy("cid").agg(F.slice(F.sort_array(pairs), 1, k).alias("best"))
    others = best.select("cid", F.explode("best").alias("b")).select("cid", "b.s", "b.other")

    def make():
        def f(batch):
            v = np.frombuffer(b"".join(batch.column(1).to_pylist()), kind).reshape(batch.num_rows, -1).astype(np.float64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(-scores(v, v)), batch.column(0)], ["cid", "s", "other"])

        return f

    own = map_batches(marked.where("asked").select("cid", "v"), make, "cid long, s double, other long")
    members = others.unionAll(own).join(classes.select(F.col("cid").alias("other"), "ids"), "other").select("cid", "s", F.explode("ids").alias("vec_id"))
    # At most (k + 1) * (k + 1) ids a class, of which a query needs k and perhaps its own.
    ranked = materialize(members.groupBy("cid").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "vec_id"))), 1, k + 1).alias("best")))
    answers = queries.join(ranked, "cid").select("query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return answers.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
