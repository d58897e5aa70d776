"""BPE, token counts and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from readloom.llm import bpe, packing, tokencount

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
LIBRARY = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
ODD = [
    "", "  a  b\n\n c", "don't 's 'sabc  's\t's !!'s a'll 'lx 'rex 're'", "<|endoftext|> hi <|startoftext|>x<|endoftext|>", "ΑΣ ΣΑΣ İstanbul ﬁ Å é é 中文字 🎉🎉 x\x00y \x1c\x1d\x85  a",
    "a" * 3000, "ab" * 300 + "!" * 77, "12345 ½ ² Ⅳ", "힣ㄱ각 Ǆ ẞß", "'r", "a 'll", "  '", "\n\n 'rx", "\n \n ", "'v1", "a  b",
]


def texts(n=300, seed=1):
    rnd = random.Random(seed)
    return ODD + ["".join(rnd.choice("abcdeth '\n\tréß12!<|>ingsvl") for _ in range(rnd.randint(0, 200))) for _ in range(n)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encode_and_decode(path):
    model, library = bpe.model(path), LIBRARY[path]
    for x in texts():
        ids = library.encode(x, add_special_tokens=False).ids
        assert model.encode(x) == ids
        if path == WORD:
            assert model.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(x):
    assert bpe.model(WORD).encode(x) == LIBRARY[WORD].encode(x, add_special_tokens=False).ids
    assert tokencount.count_texts([x], BYTE) == [len(LIBRARY[BYTE].encode(x, add_special_tokens=False).ids)]


def test_counts_and_cuts():
    data = texts(500, 2) + ["x " * 5000 + "don't" * 50, "word " * 70]
    assert tokencount.count_texts(data, BYTE) == [len(LIBRARY[BYTE].encode(x, add_special_tokens=False).ids) for x in data]


@pytest.mark.parametrize("chunk", [1, 4, 64])
def test_composed_maps(monkeypatch, chunk):
    """Texts of many chunks, pieces longer than chunks, and maps whose start state is not the fresh one."""
    monkeypatch.setattr(tokencount, "CHUNK", chunk)
    data = ["", "'r", "a'", "it's  \t 're", "x" * 300, " " * 200, "'" * 150, *texts(150, 5)]
    assert tokencount.count_texts(data, BYTE) == [len(LIBRARY[BYTE].encode(x, add_special_tokens=False).ids) for x in data]
    pieces = bpe.Memo(lambda piece: 1 if piece else 0)  # one token a piece: what the maps then add up to are the pattern's pieces
    pattern = bpe.model(BYTE).pattern
    assert tokencount.Chunks(data).counts(pieces).tolist() == [len(pattern.findall(x)) for x in data]


def test_stretches(monkeypatch):
    monkeypatch.setattr(tokencount, "STEP", 50)
    x = "it's a text's 12 words  go on " * 30 + "x" * 500
    parts = tokencount.stretches(x)
    assert "".join(parts) == x and len(parts) > 5
    assert tokencount.count_texts([x], BYTE) == [len(LIBRARY[BYTE].encode(x, add_special_tokens=False).ids)]


def test_machine_survives_full_tables(monkeypatch):
    monkeypatch.setattr(tokencount, "STATES", 20)
    machine = tokencount.CountingBpe(BYTE)
    for x in ("abcdefghij" * 40, "internationalisation" * 9, "zz" * 100):
        assert machine.count(x) == len(bpe.model(BYTE).encode_word(x))


def test_queries_on_frames(docs):
    data = [*texts(40, 3), None]
    frame = docs(data)
    library = LIBRARY[WORD]
    for r in bpe.round_trip_digests(frame, WORD).collect():
        ids = library.encode(data[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode_column(frame, WORD)
    assert {r.doc_id: r.text for r in bpe.decode_column(encoded, WORD).collect()} == {i: bpe.model(WORD).decode(bpe.model(WORD).encode(x or "")) for i, x in enumerate(data)}
    for r in tokencount.count_column(frame, BYTE, limit=50).collect():
        n = len(LIBRARY[BYTE].encode(data[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((data[r.doc_id] or "").encode()), n > 50)


def test_packing(docs):
    data = [*texts(60, 4), None, "the cat " * 3000, "dog " * 4095, "dog " * 4096, "dog " * 4095]
    rows = packing.op2(docs(data), WORD).collect()
    where = {}
    for r in rows:
        where.setdefault(r.sequence_id, []).append(r)
    for members in where.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    by_doc = {(r.doc_id, r.piece): r for r in rows}
    n = 0
    for i, x in enumerate(data):
        ids = np.array([*LIBRARY[WORD].encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            r = by_doc[i, k]
            assert (r.start, r.length, r.ids_crc32) == (a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes()))
            n += 1
    assert n == len(rows)
    assert len(where) <= sum(r.length for r in rows) / 4096 * 1.1 + 1


@pytest.mark.parametrize("length", ["1 + pmod(xxhash64(id), 4095)", "least(4095, 200 + pmod(xxhash64(id), 2400) + IF(id % 5 = 0, 1400, 0))"])
def test_packing_fills_full_packers(spark, length):
    found = spark.range(100_000).selectExpr("id doc_id", "0 piece", f"cast({length} AS long) length").localCheckpoint()
    n, total = packing.pack(found).selectExpr("count(distinct sequence_id)", "sum(length)").first()
    assert n <= total / 4096 * 1.02


def test_best_fit_bins():
    bins = packing.BestFit(10, 2)
    assert [bins.add(n) for n in (6, 7, 3, 4, 9, 9, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (3, 9)]
    bins = packing.BestFit(10, 1)
    assert [bins.add(n)[0] for n in (6, 6, 4)] == [0, 1, 1]


def test_empty_tables(docs):
    none = docs(["a"]).where("false")
    assert bpe.round_trip_digests(none, WORD).count() == tokencount.count_column(none, BYTE).count() == packing.op2(none, WORD).count() == 0
