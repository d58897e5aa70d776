"""Near-duplicates, nearest neighbours, archives and media against brute force."""

import collections
import gzip
import hashlib
import io
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest

from readloom.llm import ann, media, neardup, quality, textops, toxicity, warc
from readloom.llm.common import bucketed, materialize, shared_dir, table

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def groups(texts):
    """n_shingles and component of each id, over all pairs that share a shingle."""
    sets, holders, parent = {}, collections.defaultdict(list), {i: i for i in texts}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        for s in sets[i]:
            holders[s].append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(texts):
        for j in {j for s in sets[i] for j in holders[s] if j < i}:
            c = len(sets[i] & sets[j])
            if 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in texts}


def check(frame):
    texts = {r.doc_id: r.text for r in frame.collect()}
    want = groups(texts)
    got = neardup.near_duplicates(frame).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return want


def test_near_duplicates_on_the_tables(spark):
    check(table(spark, "/root/testdata/sf0.01", "documents"))


def edited(rnd, base, share):
    return " ".join(rnd.choice("abcdefgh") * 3 + str(rnd.randint(0, 999)) if rnd.random() < share else w for w in base)


@pytest.mark.parametrize(("short", "block"), [(32, 512), (3, 8)])
def test_near_duplicate_families(docs, monkeypatch, short, block):
    """Chains, near misses around 0.75, copies, and a passage that most texts share; long lists in blocks."""
    monkeypatch.setattr(neardup, "SHORT", short)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rnd, texts = random.Random(block), []
    passage = [f"p{i}" for i in range(60)]
    for _ in range(6):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.choice((30, 70, 120, 400)))] + passage
        texts += [edited(rnd, base, s) for s in (0, 0, 0.005, 0.01, 0.02, 0.02, 0.03, 0.03, 0.04, 0.05, 0.06) for _ in range(4)]
    texts += [None, "", "one", "ONE", "one two", "a b c d", "a b c d e", "a  b\tc d e", "x " * 20_000]
    check(docs(texts))


def test_near_duplicate_edges(docs):
    assert neardup.near_duplicates(docs(["a b c d e f"]).where("false")).count() == 0
    got = neardup.near_duplicates(docs(["a b c d e f"] * 3, [None, 7, 5])).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got) == [(-1, None, None), (5, 5, True), (7, 5, False)]


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(rnd.randint(300, 600), rnd.randint(300, 600)) for _ in range(200)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    import sys

    sys.setrecursionlimit(5000)
    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.comp for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b}
    assert all(got[x] == root(x) for x in parent if x in got) and set(parent) - set(got) <= loops


def test_written_tables_have_no_checksum_files(spark):
    """Each file that is made on a local disk starts a process the JVM's size."""
    rows = spark.range(100, numPartitions=4).selectExpr("id", "id % 7 AS k")
    with bucketed(rows, "k") as told:
        for out in (materialize(rows), told):
            files = [f.removeprefix("file://") for f in out.inputFiles()]
            assert files and not [f for path in files for f in os.listdir(os.path.dirname(path)) if f.endswith(".parquet.crc")]
            assert sorted(r.id for r in out.collect()) == list(range(100))


def test_near_duplicates_with_repeated_ids(docs):
    """Rows that share an id and not a text are different nodes; rows that repeat all are kept once by one_of_each."""
    base = [f"w{i}" for i in range(80)]
    near, far = [*base[:-1], "other"], " ".join(f"u{i}" for i in range(50))
    frame = docs([" ".join(base), " ".join(near), far, far, None, "", " ".join(near)], [3, 5, 5, 9, 5, 5, None])
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in neardup.near_duplicates(frame).collect())
    assert got == [(-1, 76, -1, None), (3, 76, 3, True), (5, 0, 5, True), (5, 0, 5, True), (5, 46, 5, True), (5, 76, 3, False), (9, 46, 5, False)]
    kept = sorted((r.doc_id or -1, r.text or "") for r in neardup.one_of_each(frame).collect())
    assert kept == sorted([(-1, " ".join(near)), (3, " ".join(base)), (5, ""), (5, ""), (5, far)])
    same = docs([far] * 50, [7] * 50)
    assert all(r.component_id == 7 and r.kept for r in neardup.near_duplicates(same).collect())
    assert neardup.one_of_each(same).count() == 1


def test_long_texts_come_in_spans(monkeypatch):
    """The same results whether a text is one step or many spans; words longer than a span stand as digests."""
    rnd = random.Random(4)
    text = "".join(rnd.choice(["alpha", "Beta", "$$!!", "99", "the the", "é", "z" * 30]) + rnd.choice([" ", "\n", "  "]) for _ in range(4000)).encode()
    whole = [list(textops.shingle_sets([text], 5)), quality.counted([text]), quality._features([text]), list(toxicity._present([text]))]
    for module in (textops, quality):
        monkeypatch.setattr(module, "STEP_BYTES", 4096)
    for f in (textops.in_steps, textops.word_spans, textops.line_spans):
        monkeypatch.setattr(f, "__defaults__", (4096,))
    spans = [list(textops.shingle_sets([text], 5)), quality.counted([text]), quality._features([text]), list(toxicity._present([text]))]
    assert len(list(textops.word_spans(text))) > 5 and b"".join(textops.word_spans(text)) == text == b"".join(textops.line_spans(text))
    assert (whole[0][0] == spans[0][0]).all() and all((whole[1][0][k] == spans[1][0][k]).all() for k in whole[1][0])
    assert all(np.allclose(a, b) for a, b in zip(whole[2], spans[2])) and set(whole[3][0][1]) == set(spans[3][0][1])
    long = b"a " + b"x" * 200_000 + b" b c d e " + b"X" * 200_000 + b" f"
    assert len(next(textops.shingle_sets([long], 5))) == 4


def nearest(ids, v, every, k):
    out = []
    for i in np.flatnonzero(ids % every == 0):
        s = np.add.reduce(v[i] * v, axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), r + 1, int(ids[j])) for r, j in enumerate(order)]
    return sorted(out)


def test_neighbours(spark):
    """With windows that hold all, exact: ties, 150 equal vectors, rows that take no part. With small ones, recall."""
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.standard_normal((400, 16)), np.repeat(rng.standard_normal((1, 16)), 150, 0), rng.standard_normal((5, 16)).repeat(40, 0) + 0.01 * rng.standard_normal((200, 16))])
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    bad = [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] + [1.0] * 15, 1), (2060, [None] + [1.0] * 15, 1), (2080, [float("inf")] * 16, 1), (2100, [1.0], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score int").repartition(4)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(df, k=7, every=20, curves=2).collect())
    want = nearest(np.arange(len(v)), v, 20, 7)
    assert got == want
    small = {(r.query_id, r.vec_id) for r in ann.search(df, k=7, every=20, tile=32, half=16).collect()}
    assert len(small & {(q, x) for q, _, x in want}) >= 0.9 * len(want)


@pytest.mark.parametrize(("sf", "sizes"), [("sf0.1", {"tile": 64, "half": 32})])
def test_recall_on_the_tables(spark, sf, sizes):
    """2,000 vectors without structure, windows of 128 places."""
    df = table(spark, f"/root/testdata/{sf}", "embeddings")
    rows = df.select("vec_id", "embedding").toPandas().sort_values("vec_id")
    want = {(q, x) for q, _, x in nearest(rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), float), 20, 20)}
    got = {(r.query_id, r.vec_id) for r in ann.search(df, **sizes).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)


def test_many_equal_vectors(spark):
    """4,096 copies are one class, so nothing is compared with all of them."""
    rows = [(i, [0.5, -0.5, 0.25, 0.0]) for i in range(4096)] + [(5000, [1.0, 0.0, 0.0, 0.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=1024).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted((q, k + 1, x) for q in (0, 1024, 2048, 3072) for k, x in enumerate([i for i in range(21) if i != q][:20]))


def test_neighbours_edges(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(few).collect())
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 3, 0.5)]
    assert ann.search(few.where("false")).count() == 0


def test_hilbert_visits_neighbours():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = ann.hilbert(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def pages(spark):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(5, "u5", big), (3, "u\r\n3", big), (9, None, big), (4, "u4", "short"), (6, "u6", "short"), (7, "u7", None), (None, "u", big), (8, "u8", ""), (10, "u10", "é" * 60), (11, "u", "é" * 60), (12, "u", "y" * 300_000)]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string").repartition(3), rows


def test_archive_round_trip(spark):
    df, rows = pages(spark)
    got = {r.page_id: r for r in warc.op4(df).collect()}
    first = {}
    for i, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (html or "").encode()
        want = "revisit" if len(data) >= 100 and data in first else "response"
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), want, first.get(data) if want == "revisit" else None)
        first.setdefault(data, i)
    assert got[None].record_type == "response" and len(got) == len(rows)
    assert warc.op4(df.where("false")).count() == 0


def test_archive_filters_and_splits(spark):
    df, rows = pages(spark)
    path = shared_dir(spark)
    warc.register(spark)
    warc.deduplicated(df).coalesce(1).write.format("warc").mode("append").option("split", "100").save(path)
    read = warc.read(spark, path)
    assert read.count() == len(rows) and len(warc.WarcReader(path, True, {}).partitions()) > 3
    some = read.where("record_type = 'revisit' AND page_id IN (5, 9, 11)")
    assert "Filter" not in some._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    assert sorted(r.page_id for r in some.collect()) == [5, 9, 11]
    assert read.where("page_id > 9 AND page_id <= 11").count() == 2
    assert {r.payload for r in warc.read(spark, path, payload=False).collect()} == {None}
    assert read.where("page_id = 3").first().target_uri == "u%0D%0A3"


def test_every_flipped_bit_is_found():
    data = b"hello world" * 20
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:1>"), ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(data).hexdigest()), ("X-Payload-Length", str(len(data)))]
    good = warc.member(warc.record(headers, data))

    def read(archive, load=True):
        return [payload() if load else head["page_id"] for _, head, payload in warc.records(io.BufferedReader(io.BytesIO(archive)), 0, len(archive), True)]

    assert read(good + good) == [data] * 2
    for bit in range(8 * len(good)):
        bad = bytearray(good)
        bad[bit // 8] ^= 1 << bit % 8
        with pytest.raises((ValueError, zlib.error)):
            read(bytes(bad) + good)
    assert read(good + good, load=False) == [1, 1]
    wrong = warc.member(warc.record([*headers[:2], ("WARC-Payload-Digest", "sha256:" + "0" * 64), headers[3]], data))
    with pytest.raises(ValueError, match="digest"):
        read(wrong)
    foreign = bytearray(gzip.compress(warc.record(headers, data)))
    foreign[-6] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        read(bytes(foreign))


def test_foreign_archives(tmp_path):
    one = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:1>")], b"hello")
    two = warc.record([("WARC-Type", "request"), ("warc-record-id", "<urn:x>")], b"a" * 5000)
    for data, name in ((one + two, "a.warc"), (gzip.compress(one) + gzip.compress(two), "a.warc.gz")):
        (tmp_path / name).write_bytes(data)
        r = warc.WarcReader(str(tmp_path / name), True, {})
        found = [row for p in r.partitions() for b in r.read(p) for row in b.to_pylist()]
        assert [(x["record_type"], x["payload"]) for x in found] == [("response", b"hello"), ("request", b"a" * 5000)]
    assert zlib.decompress(warc.member(b"abc"), 31) == b"abc"
    (tmp_path / "a.warc.gz").write_bytes(warc.member(one)[:-3])
    r = warc.WarcReader(str(tmp_path / "a.warc.gz"), True, {})
    with pytest.raises(ValueError):
        list(r.read(r.partitions()[0]))


def slow_resize(image, height, width):
    h, w = image.shape
    big = np.repeat(np.repeat(image, height, 0), width, 1).astype(float)  # each cell is h x w of these
    return big.reshape(height, h, width, w).mean(axis=(1, 3))


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (16, 16), (40, 24), (3, 90)])
def test_area_resize(shape, monkeypatch):
    image = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    assert np.allclose(media.area_resize(image, 16, 9), slow_resize(image, 16, 9))
    monkeypatch.setattr(media, "BAND", 10)
    assert np.allclose(media.area_resize(image, 16, 9), slow_resize(image, 16, 9))


def test_formats():
    a = np.arange(24, dtype=np.uint8).reshape(4, 6)
    assert (media.decode(media.encode_pgm(a, 6)) == a).all()
    assert (media.decode(b"P2 # note\n6 4\n255\n" + " ".join(map(str, a.ravel())).encode()) == a).all()
    assert media.decode(b"P3\n1 1\n15\n15 0 5").tolist() == [[[255, 0, 85]]]
    assert media.decode(b"P1\n3 1\n1 0\n1").tolist() == [[0, 255, 0]] and media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P5\n1 1\n65535\n\xff\xff").tolist() == [[255]] and media.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, 54, 40, 2, 2, 1, 24, 0, 0, 0, 0, 0, 0)
    bmp = head + bytes([1, 2, 3, 4, 5, 6, 0, 0, 7, 8, 9, 10, 11, 12, 0, 0])
    assert media.decode(bmp).tolist() == [[[9, 8, 7], [12, 11, 10]], [[3, 2, 1], [6, 5, 4]]]
    for bad in (b"", b"P5", b"P5\n0 1\n255\n", b"P5\n9 9\n255\nxx", b"BMxx", b"GIF89a", b"P5\nx 1\n255\n"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_media_round_trip(docs, spark):
    data = ["", None, "a" * 576, "é" * 400, "x", "x"]
    got = {r.doc_id: r for r in media.op10(docs(data)).collect()}
    for i, t in enumerate(data):
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.encode_pgm(payload, 24)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert got[4].feature == got[5].feature != got[2].feature
    odd = spark.createDataFrame([(1, None, "k"), (2, bytearray(b"zz"), "k")], "doc_id long, media binary, tile string")
    assert [r.error is None for r in media.decode_media(odd).collect()] == [False, False]
    assert media.op10(docs(data).where("false")).count() == 0
