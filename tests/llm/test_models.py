"""Trained operators: held-out accuracy on the given tables, exact sums by brute force, and edge cases."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from readloom.llm import lm, quality, textops, toxicity
from readloom.llm.common import table

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op7(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    caught = [r.predicted for r in got if r.toxic]
    assert right > 0.97 and sum(caught) / len(caught) > 0.85 and all(r.predicted == (r.score >= 0.5) for r in got)


def test_toxicity_edges(spark, docs):
    frame = docs(["you idiot", None, "", "fine words here", "fine words here", "x" * 100_000])
    labels = spark.createDataFrame([(0, 1), (None, 1), (3, 0), (4, None), (3, 0), (1, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.op7(frame, labels).collect()}
    assert len(got) == 6 and got[1] == got[2] and got[3] == got[4] and all(0 <= x <= 1 for x in got.values())
    assert toxicity.op7(frame, labels.where("false")).count() == 6
    assert toxicity.op7(frame.where("false"), labels).count() == 0
    model = toxicity.fit(frame, labels)
    assert toxicity.score(frame, model).columns == ["doc_id", "text", "n", "score", "predicted"]


def test_toxicity_equals_brute_force(docs, spark):
    """Features by counting every n-gram in Python, ratios by the formula, and scores from the model's weights."""
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["you", "Idiot", "fine\tday", "bread", "trash", "walk"]) for _ in range(rnd.randint(1, 8))) for _ in range(60)]
    flag = [int("Idiot" in t) for t in texts]
    frame = docs(texts)
    labels = spark.createDataFrame(list(enumerate(flag)), "doc_id long, toxic int")
    train = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]

    def grams(t):
        raw = re.sub(rb"[\x20\x09-\x0D]", b" ", b" " + t.encode().translate(LOWER) + b" " * 6)
        return {raw[k : k + n] for n in (3, 4, 5, 6) for k in range(len(raw) - n + 1)}

    def hashed(g):
        value = np.zeros(1, np.uint64)
        for k, c in enumerate(g):
            value = value + np.uint64(c) * textops.GRAM[k]
        return int((textops.mix(value + np.uint64(len(g))) >> np.uint64(64 - toxicity.BITS))[0])

    n = [sum(flag[i] == k for i in train) for k in (0, 1)]
    seen = collections.Counter((g, flag[i]) for i in train for g in {hashed(g) for g in grams(texts[i])})
    model = toxicity.fit(frame, labels, width=10_000)
    held = {h for h, _ in seen if seen[h, 0] + seen[h, 1] >= 3}
    assert set(model.features.tolist()) <= held and len(model.features) > 0.5 * len(held)
    ratio = {h: math.log((seen[h, 1] + 0.5) / (n[1] + 1)) - math.log((seen[h, 0] + 0.5) / (n[0] + 1)) for h in held}
    got = model.ratios
    assert all(got[k] == pytest.approx(ratio[h]) for k, h in enumerate(model.features.tolist()))
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    for r in toxicity.score(frame, model).collect():
        z = sum(weight.get(h, 0) for h in {hashed(g) for g in grams(texts[r.doc_id])}) + model.intercept
        assert float(r.asDict()["score"]) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    # The fit is the minimum of the ridge loss on scaled features: its gradient is small.
    x = np.array([[ratio[h] * (h in {hashed(g) for g in grams(texts[i])}) for h in model.features.tolist()] for i in train])
    w = np.array([weight[h] / ratio[h] for h in model.features.tolist()])
    y = np.array([flag[i] for i in train])
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))
    assert np.abs(x.T @ (p - y) / len(y) + 1e-4 * w).max() < 2e-3


def test_toxicity_sample_is_bounded(docs, spark):
    frame = docs(["you idiot"] * 40 + [f"fine day {i}" for i in range(20)], [1] * 60)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.sample(frame, labels).count() == toxicity.PER_ID


def test_quality_finds_junk_without_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.op1(table(spark, sf, "documents")).join(table(spark, sf, "labels").withColumnRenamed("quality", "label"), "doc_id").collect()
    good, bad = [r.keep for r in got if r.label == 1], [r.keep for r in got if r.label == 0]
    assert sum(good) / len(good) > 0.995 and sum(bad) / len(bad) < 0.05


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    accuracy = np.array([0.95, 0.85, 0.75, 0.9])
    v = np.array([np.where(rng.random(len(truth)) < a, truth, ~truth) for a in accuracy]).T.astype(int)
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    m = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(m.prior - 0.8) < 0.03
    assert np.abs(m.chance[quality.GOOD][:, 1] - accuracy).max() < 0.04 and np.abs(m.chance[quality.BAD][:, 0] - accuracy).max() < 0.06


def test_quality_edges(docs):
    frame = docs([None, "", "!!! $$$ %%%", "a b", *["Plain words make a sentence of a good length, which ends here; the next one begins after it, and so on."] * 3, "w " * 50_000])
    got = {r.doc_id: r for r in quality.op1(frame).collect()}
    assert len(got) == 8 and got[4].quality == got[5].quality and got[0].quality == got[1].quality and not got[0].keep
    assert quality.op1(frame.where("false")).count() == 0


def test_quality_of_repeated_rows(docs):
    same = docs(["Plain words make a sentence of a good length, which ends here; the next one begins after it."] * 300, [4] * 300)
    got = quality.score(same, quality.fit(same, rows=1)).collect()
    assert len(got) == 300 and len({r.quality for r in got}) == 1
    mixed = docs([f"word {i % 7} goes on with others like it until a line ends " * (1 + i % 3) for i in range(200)])
    assert quality.sample(mixed.select("text"), rows=5).count() == 5 and quality.sample(mixed.select("text"), size=100).count() == 1
    assert sum(r.weight for r in quality.sample(mixed.select("text")).collect()) == 200
    one = {r.doc_id: r.quality for r in quality.op1(mixed.repartition(2)).collect()}
    two = {r.doc_id: r.quality for r in quality.op1(mixed.repartition(7)).collect()}
    assert one == two


def test_quality_scorer_by_brute_force(docs):
    """Votes, posterior and score of each text from the definitions."""
    texts = ["Plain words make a sentence of a good length, which ends here; the next one begins after it, and so on again and on.", "!!! $$$ %%% ### ((( )))", "a b", "SHOUT " * 30, "12 34 56 78 " * 9, "x x x x x x x x", ""]
    frame = docs(texts)
    scorer = quality.fit(frame)
    for r in quality.score(frame, scorer).collect():
        t, found = texts[r.doc_id], {}
        w, low = t.split(), t.lower().split()
        lines = [x for x in t.split("\n") if x]
        used = max(1, sum(not c.isspace() for c in t))
        symbol = [33 <= ord(c) < 127 and not c.isalnum() and c not in ".,;:'\"-()?" for c in t]
        found["symbol_share"] = sum(symbol) / used
        found["upper_share"] = sum(c.isupper() for c in t) / max(1, sum(c.isalpha() for c in t))
        found["digit_share"] = sum(c.isdigit() for c in t) / used
        found["echo_share"] = sum(a == b for a, b in zip(low, low[1:])) / max(1, len(w))
        found["lone_share"] = sum(len(x) == 1 and bool(quality.SYMBOL[ord(x)]) for x in w) / max(1, len(w))
        found["marked_share"] = sum(len(x) > 2 and bool(quality.SYMBOL[ord(x[-1])] and quality.SYMBOL[ord(x[-2])]) for x in w) / max(1, len(w))
        found["line_copy_share"] = (len(lines) - len({x.lower() for x in lines})) / max(1, len(lines))
        found["n_words"] = len(w)
        found["distinct_share"] = len(set(low)) / max(1, min(max(1, len(w)), 12 * math.sqrt(max(1, len(w)))))
        vote = []
        for _, name, bad, good in quality.LABELLERS:
            x = found[name]
            if name in quality.FALLING:
                vote.append(0 if x < bad else 1 if x >= good else 2)
            else:
                vote.append(0 if x >= bad else 1 if x <= good else 2)
        odds = [math.log(p) + sum(math.log(scorer.labels.chance[c, k, v]) for k, v in enumerate(vote)) for c, p in ((0, 1 - scorer.labels.prior), (1, scorer.labels.prior))]
        assert r.posterior == pytest.approx(1 / (1 + math.exp(odds[0] - odds[1])), abs=1e-9)
        rows, cols, values, _ = quality._features([t.encode()])
        assert r.quality == pytest.approx(1 / (1 + math.exp(-(sum(scorer.weights[c] * v for c, v in zip(cols, values)) + scorer.weights[-1]))), abs=1e-9)


def brute(texts, order):
    """Scores by dictionaries; the model's formulas word for word, recursively."""
    tokens = {i: [*words(t), "END"] for i, t in texts.items()}
    train = [i for i in tokens if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    count = {k: collections.Counter() for k in range(1, order + 1)}
    for i in train:
        padded = ["BEGIN"] * (order - 1) + tokens[i]
        for at in range(order - 1, len(padded)):
            for k in count:
                count[k][tuple(padded[at - k + 1 : at + 1])] += 1
    n, v = sum(count[1].values()), len(count[1])
    follow = collections.defaultdict(list)
    for k in range(2, order + 1):
        for gram, c in count[k].items():
            follow[gram[:-1]].append((gram[-1], c))
    of = lambda c: np.array([0] + [sum(x == j for x in c.values()) for j in range(1, 7)])
    unigram = lm.WordModel.of(n, v, len(train), of(count[1]))
    d = {k: lm.discounts(of(count[k])) for k in range(2, order + 1)}
    memo = {}

    def after(h, w):
        if (h, w) not in memo:
            memo[h, w] = one(h, w)
        return memo[h, w]

    def one(h, w):
        if not h:
            return float(unigram.p(np.array([count[1].get((w,), 0)]))[0])
        if h not in follow:
            return after(h[1:], w)
        dd = d[len(h) + 1]
        share = lambda c: (dd[c] if c <= 5 else 1) * c
        total = sum(c for _, c in follow[h])
        scale = 1 if any(c <= 5 and dd[c] < 1 for _, c in follow[h]) else total / (total + 1)
        if c := count[len(h) + 1].get((*h, w)):
            return scale * share(c) / total
        mass = sum(after(h[1:], x) for x, _ in follow[h])
        return (1 - scale * sum(share(c) for _, c in follow[h]) / total) / (1 - mass) * after(h[1:], w)

    scores = {}
    for i, t in tokens.items():
        padded = ["BEGIN"] * (order - 1) + t
        scores[i] = sum(math.log10(after(tuple(padded[at - order + 1 : at]), padded[at])) for at in range(order - 1, len(padded)))
    return tokens, count[1], n, v, scores, after, follow


@pytest.mark.parametrize("order", [3, 2, 4])
def test_katz_equals_brute_force(spark, order):
    frame = table(spark, "/root/testdata/sf0.001", "documents")
    if order != 3:
        frame = frame.where("doc_id < 60")
    texts = {r.doc_id: r.text for r in frame.collect()}
    tokens, c1, n, v, scores, after, follow = brute(texts, order)
    for r in lm.score(frame, order).collect():
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum((w,) in c1 for w in t), n)
        assert r.asDict()["score"] == pytest.approx(scores[r.doc_id], abs=1e-8)
        assert r.base_score == pytest.approx(sum(math.log10((c1[w,] + 0.5) / (n + 0.5 * (v + 1))) for w in t), abs=1e-8)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    longest = [h for h in follow if len(h) == order - 1]
    for h in [*longest[:5], *longest[-3:], ("BEGIN",) * (order - 1), ("never seen",) * (order - 1), (*longest[0][1:], "never")]:
        assert sum(after(h, w) for (w,) in c1) + after(h, "not a word") == pytest.approx(1, abs=1e-9)


def test_katz_with_several_chunks_and_parts(spark, monkeypatch):
    """Many chunks and many parts, with contexts too frequent for one."""
    frame = table(spark, "/root/testdata/sf0.001", "documents").repartition(5)
    whole = {r.doc_id: tuple(r) for r in lm.score(frame).collect()}
    real = lm.chunks
    monkeypatch.setattr(lm, "TOKENS_PER_PART", 3000)
    monkeypatch.setattr(lm, "chunks", lambda documents, order: real(documents.repartition(17), order))
    for r in lm.score(frame).collect():
        assert tuple(r) == pytest.approx(whole[r.doc_id], abs=1e-8)


def test_katz_pieces_of_long_texts(spark, monkeypatch):
    """A text that goes on in further chunks has the contexts it has in one."""
    monkeypatch.setattr(lm, "CHUNK_BYTES", 400)
    rnd = random.Random(6)
    text = " ".join(rnd.choice("abcdefgh") for _ in range(1000))
    made = []

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            import pyarrow as pa

            batch = pa.RecordBatch.from_arrays([pa.array([5, 7], pa.int64()), pa.array([text, "x y"]), pa.array([1, 1], pa.int32())], ["doc_id", "text", "fold"])
            made.extend(r for b in f(iter([batch])) for r in [b])

    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": staticmethod(lambda: 0)}))
    lm.chunks(Frame())
    import pyarrow as pa

    found = [lm.Chunk(pa.Table.from_batches([b])) for b in made]
    own = np.concatenate([c.words[c.place][c.own] for c in found[:-1]])
    assert len(found) > 4 and len(own) == 1001 and own[-1] == lm.END
    assert {tuple(c.numbers) for c in found[:-1]} == {(0,)} and found[-1].numbers == [1]
    for one, two in zip(found[:-2], found[1:-1]):
        assert (two.words[two.place][:2] == one.words[one.place][-2:]).all() and two.own[:3].tolist() == [False, False, True]


def test_katz_lower_orders_are_not_made_or_shuffled_again(spark, monkeypatch):
    """Turns of the last order read what chunks wrote of the order below: only bigram turns and the end shuffle answers."""
    shuffled, real = [], lm.materialize

    def seen(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        if "FlatMapCoGroupsInArrow" in plan:
            shuffled.append(plan.count("Exchange hashpartitioning(chunk#"))
        return real(df)

    monkeypatch.setattr(lm, "materialize", seen)
    frame = table(spark, "/root/testdata/sf0.001", "documents").where("doc_id < 60")
    assert lm.score(frame).count() == frame.count()
    assert shuffled == [1] * lm.TURNS[2] + [0] * lm.TURNS[3] + [1]


def test_katz_written_order_reads_back():
    """Repeated n-grams, contexts that training texts have or not, a one-token text, and a text that goes on from another chunk."""
    rnd = np.random.default_rng(3)
    known = np.unique(rnd.integers(0, 1 << 63, 41).astype(np.uint64))
    sizes = np.array([[900, 1, 300, 70], [2, 0, 0, 0], [1, 1, 2, 0], [0, 1, 1, 1]], np.int32)
    place = (np.minimum(rnd.geometric(0.1, 1271), len(known)) - 1).astype(np.int32)
    row = (7, lm.CHUNK, None, None, [0, 1, 2, None, 3, 4, 5, 6], known.tobytes(), lm.pack(place), lm.pack(*sizes))
    c = lm.Chunk(lm.rows([row]))
    assert c.own.tolist() == [False] * 2 + [True] * 1269 and c.training.sum() == 899
    n = c.training_counts(c.place, len(known)).astype(np.int64)
    model = lm.Model(lm.WordModel.of(int(n.sum()), int((n > 0).sum()), 2, np.bincount(n, minlength=7)[:7]), 3)
    c.answers[lm.WORD_ANSWER, None] = [{"x": lm.pack(n)}]
    below = c.up_to(model, 1)
    grams = lm.Grams(c, below, model)
    count = np.bincount(grams.of_token[c.training], minlength=len(grams.key)).astype(np.int64)
    model.d[2] = np.array([1, 0.4, 0.6, 0.7, 0.8, 0.9])
    scale, weight = rnd.random(len(known) + 1), rnd.random(len(known) + 1)
    made = lm.Known.of(model, 2, below, grams.of_token, grams.key, count, grams.context, grams.lower, scale, weight)
    got = lm.Chunk(lm.rows([row]), lm.rows([c.write(2, made, below), (7, lm.KNOWN, 1, None, None, lm.pack(n), None, None)])).up_to(model, 2)
    assert 0 < (count == 0).sum() < len(count) < len(place) and len(got.key) == len(made.key)
    for f in ("key", "n"):
        assert (getattr(got, f)[got.of_token] == getattr(made, f)[made.of_token]).all()
    assert (got.p(got.of_token) == made.p(made.of_token)).all()


def test_katz_edges(docs):
    frame = docs([None, "", "a a a a", "A a b", "b " * 5000, "b c"], [0, 1, 2, 3, None, 9])
    got = lm.score(frame).collect()
    assert len(got) == 6 and all(math.isfinite(r.asDict()['score']) for r in got) and [r.held_out for r in got if r.doc_id is None] == [False]
    assert lm.score(frame.where("false")).count() == 0
    assert all(r.asDict()['score'] == 0 and r.train_tokens == 0 for r in lm.score(docs(["x y"], [None])).collect())
