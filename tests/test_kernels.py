"""The vectorised passes against definitions read by read."""

import random

import numpy as np
import pyarrow as pa
import pytest

from readloom.functions import kernels
from readloom.functions.kernels import Flat


def reads(seed, n=300, letters="ACGTN", most=60):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(letters, k=rnd.randint(0, most))) for _ in range(n)]


def flat(x):
    return Flat.of(pa.array(x, pa.string()))


def slide(q, w, thr, step):
    n = len(q)
    if n < w:
        return 0, n
    bad = [False] * n
    for s in {*range(0, n - w + 1, step), n - w}:
        if sum(q[s : s + w]) < thr * w:
            bad[s : s + w] = [True] * w
    best, i = None, 0
    while i < n:
        if bad[i]:
            i += 1
            continue
        j = i
        while j < n and not bad[j]:
            j += 1
        key = (j - i, sum(q[i:j]), -i)
        if best is None or key > best[0]:
            best = key, i, j
        i = j
    return best[1:] if best else (0, 0)


@pytest.mark.parametrize(("w", "thr", "step"), [(5, 20, 1), (4, 22, 3), (1, 25, 1), (7, 18, 10)])
def test_sliding(w, thr, step):
    rnd = random.Random(w)
    quals = ["".join(chr(33 + rnd.choice((2, 15, 20, 25, 40))) for _ in range(rnd.randint(0, 40))) for _ in range(400)] + ["", "I" * w, "#" * 9]
    left, right = kernels.sliding(flat(quals), np.full(len(quals), 33), w, thr, step)
    assert [(int(a), int(b)) for a, b in zip(left, right)] == [tuple(slide([ord(c) - 33 for c in q], w, thr, step)) for q in quals]


def test_sliding_equal_runs_take_the_higher_mean_then_the_left():
    quals = ["5I5I" + "#" * 4 + "IIII", "IIII" + "####" + "IIII"]
    left, right = kernels.sliding(flat(quals), np.full(2, 33), 1, 20, 1)
    assert list(zip(left, right)) == [(8, 12), (0, 4)]


def first_place(read, a, seed, mm):
    seed = min(seed, len(a))
    for p in range(len(read) - seed + 1):
        ov = min(len(a), len(read) - p)
        if ov >= seed and sum(x != y for x, y in zip(read[p : p + ov], a)) <= ov * mm // len(a):
            return p
    return -1


@pytest.mark.parametrize(("seed", "mm"), [(6, 0), (6, 2), (3, 1), (99, 3), (1, 4)])
def test_adapters(seed, mm):
    wanted = ["AGATCGGAAG", "ACG", "GATCNG"]
    data = reads(seed * 10 + mm) + ["TTTAGATCG", "TTTAGATC", "AGATCGGAAG", "", "ACNGATCNG"]
    right, hit = kernels.adapters(flat(data), wanted, seed, mm)
    for r, h, read in zip(right, hit, data):
        places = [first_place(read, a, seed, mm) for a in wanted]
        fits = [(p, k) for k, p in enumerate(places) if p >= 0]
        assert (r, h) == (min(fits) if fits and min(fits)[0] < len(read) else (len(read), -1))


def insert(one, two, m, least, f):
    rc = two[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for size in range(min(len(one), len(two), max(len(one), len(two)) - 1), least - 1, -1):
        wrong = sum(x != y or "N" in (x, y) for x, y in zip(one[:size], rc[len(two) - size :]))
        if wrong <= m and 100 * wrong <= size * f:
            return size
    return -1


@pytest.mark.parametrize(("m", "least", "f"), [(5, 20, 10), (0, 5, 4), (2, 1, 50)])
def test_overlap(m, least, f):
    rnd = random.Random(m)
    ones, twos = [], []
    for _ in range(300):
        ins = "".join(rnd.choices("ACGT", k=rnd.randint(10, 60)))
        a, b = (ins + "".join(rnd.choices("ACGTN", k=40)))[: rnd.choice((40, 50))], (ins[::-1].translate(str.maketrans("ACGT", "TGCA")) + "".join(rnd.choices("ACGT", k=40)))[: rnd.choice((40, 50))]
        ones.append("".join(rnd.choice("ACGTN") if rnd.random() < 0.02 else c for c in a))
        twos.append(b)
    ones, twos = ones + ["N" * 30, ""], twos + ["N" * 30, "ACGT"]
    got = kernels.overlap(flat(ones), flat(twos), m, least, f)
    assert got.tolist() == [insert(a, b, m, least, f) for a, b in zip(ones, twos)]


@pytest.mark.parametrize("k", [1, 2, 4, 21])
def test_kmers(k):
    data = reads(k) + ["", "A" * 30]
    assert kernels.kmer_counts(flat(data), k).tolist() == [len({r[i : i + k] for i in range(len(r) - k + 1)}) for r in data]


def test_quality_sums_and_null_rows():
    q = Flat.of(pa.array(["IIII", None, "", "!I"]))
    assert kernels.quality_sums(q, np.full(4, 33)).tolist() == [160, 0, 0, 40]
    assert kernels.quality_sums(q, np.full(4, 33), np.array([1, 0, 0, 1]), np.array([3, 5, 2, 9])).tolist() == [80, 0, 0, 40]


def test_empty_batches():
    e = flat([])
    assert kernels.sliding(e, np.zeros(0, int), 5, 20, 1)[0].size == 0
    assert kernels.adapters(e, ["ACG"], 3, 0)[0].size == 0
    assert kernels.overlap(e, e, 1, 5, 5).size == 0
