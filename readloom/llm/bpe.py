"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word exactly one token can end its encoding: the token that matches there and is compatible with
the last token of the prefix before it. A suffix automaton of the vocabulary (Aho-Corasick) lists the matches; the
compatibility of two tokens is decided from the merges alone; back-pointers then give the ids from the end.
Time is linear in a word's length, so very long words need no limit.

Null and empty texts give no ids. Repeated rows keep their number. Columns of the input with the results' names are
replaced, others stay out (the id column and the results are returned).
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .common import map_batches, strings

#: Entries of a worker's word memo, and the longest word that enters it.
MEMO, MEMO_WORD = 250_000, 64
LONG = 1 << 20

END = "\x00"
#: No letter is newer to our tables than to the library's below this code point.
LEAST_RARE = 0x500
FIRST_MARK = 0x300


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies (a public convention)."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


LETTERS = dict(enumerate(byte_letters()))


@functools.cache
def newer() -> str:
    """Letters and numbers to our pattern engine but not to the library, whose Unicode tables are older."""
    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    doubtful = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    return "".join(c for c in doubtful if len(split(f"b{c}b")) > 1 and len(split(f"1{c}1")) > 1)


@functools.cache
def rare() -> regex.Pattern | None:
    """Finds a letter of newer()."""
    ranges: list[list[int]] = []
    for i in map(ord, newer()):
        if ranges and ranges[-1][1] == i - 1:
            ranges[-1][1] = i
        else:
            ranges.append([i, i])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]") if ranges else None


def largest_unit(text: str) -> int:
    """The largest UTF-16 code unit, which settles for nearly all texts that no table is needed."""
    return 0 if text.isascii() else int(np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).max())


class Bpe:
    """A vocabulary file of the tokenizers library with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        parts = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        own = next((p["pattern"]["Regex"] for p in parts if p["type"] == "Split"), None)
        if own is None and not parts[0].get("use_regex"):
            raise ValueError("only split patterns and the byte-level pattern are supported")
        #: White space by Unicode's property, as in the library's pattern engine.
        self.pattern = regex.compile((own or r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").replace("[^\\s", "[^\\p{White_Space}").replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}"))
        steps = spec["normalizer"]["normalizers"] if spec["normalizer"] else []
        self.nfc, self.lower = (any(s["type"] == k for s in steps) for k in ("NFC", "Lowercase"))
        self.normalizer = Tokenizer.from_file(path).normalizer
        self._order(model["merges"])
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            word = token[: -len(self.suffix)] + END if self.suffix and token.endswith(self.suffix) else token
            if self.order[i] >= 0:
                self.automaton.add_word(word, (len(word), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}

    def _order(self, merges: list) -> None:
        """order: base tokens first, then by merge; halves: the two tokens that a merge joins; joined: their merge."""
        self.order = [-1] * (max(self.names) + 1)
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(self.order))]
        self.joined: dict[tuple[int, int], int] = {}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        made = [a + b for a, b in pairs]
        known = set(made)
        base = [t for t in self.vocab if t not in known]
        for n, t in enumerate(base):
            self.order[self.vocab[t]] = n
        for n, ((a, b), t) in enumerate(zip(pairs, made, strict=True)):
            i, left, right = self.vocab[t], self.vocab[a], self.vocab[b]
            self.joined.setdefault((left, right), i)
            if self.order[i] < 0:
                self.order[i] = len(base) + n
                self.halves[i] = (left, right)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' joined text is these two tokens.

        The merges across the border that could come before the ones inside are tried from the outside in: the later
        made of the two tokens is opened, and its half at the border stands there up to that merge.
        """
        order, halves, joined = self.order, self.halves, self.joined
        limit = 1 << 60
        while True:
            both = joined.get((left, right))
            if both is not None and order[both] < limit:
                return False
            a, b = order[left], order[right]
            if a > b:
                inner = halves[left][1]
                limit = a
                if inner == left:  # a base token: open the other side
                    if halves[right][0] == right:
                        return True
                    limit, right = b + 1, halves[right][0]
                else:
                    left = inner
            else:
                inner = halves[right][0]
                limit = b + 1
                if inner == right:
                    if halves[left][1] == left:
                        return True
                    limit, left = a, halves[left][1]
                else:
                    right = inner

    def letters(self, word: str) -> str:
        """The word in byte letters, with the end mark if the vocabulary has one."""
        return self.mapped(word) + END if self.suffix else self.mapped(word)

    @staticmethod
    def mapped(word: str) -> str:
        """A letter for each byte of the word."""
        return word if word.isascii() and word.isprintable() and " " not in word else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(LETTERS)

    def encode_word(self, word: str) -> list[int]:
        """Ids of one piece that the pattern cut."""
        text = self.letters(word)
        n = len(text)
        last, back, fits = [-1] * (n + 1), [0] * (n + 1), self.fits
        for end, (length, token) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                key = before << 20 | token
                ok = fits.get(key)
                if ok is None:
                    if len(fits) > 2_000_000:
                        fits.clear()
                    ok = fits[key] = self.compatible(before, token)
                if not ok:
                    continue
            last[end], back[end] = token, start
        ids = []
        while n:
            ids.append(last[n])
            n = back[n]
        return ids[::-1]

    def normal(self, text: str) -> str:
        """Below the combining marks a text is composed as it stands; above, the library's own tables decide."""
        if not (self.nfc or self.lower):
            return text
        if largest_unit(text) >= FIRST_MARK:
            return self.normalizer.normalize_str(text)
        return text.lower() if self.lower else text

    def cut(self, text: str) -> Iterable[str]:
        """The pattern's pieces of a normal text; those of a very long one are not held at once."""
        if rare() and largest_unit(text) >= LEAST_RARE and rare().search(text):
            like = text.translate(dict.fromkeys(map(ord, newer()), "\uffff"))  # neither letter nor number
            return (text[m.start() : m.end()] for m in self.pattern.finditer(like))
        return self.pattern.findall(text) if len(text) <= LONG else (m.group() for m in self.pattern.finditer(text))

    def pieces(self, text: str) -> Iterable[str | int]:
        """The text's words in order; added tokens as their ids."""
        if self.added and "<" in text and self.split_added.search(text):
            out: list[str | int] = []
            for part in self.split_added.split(text):
                if part in self.added:
                    out.append(self.added[part])
                elif part:
                    out += self.cut(self.normal(part))
            return out
        return self.cut(self.normal(text))

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in ([p] if isinstance(p, int) else self.encode_word(p))]

    def decode(self, ids: Iterable[int]) -> str:
        """As the library without a decoder: the tokens' names, joined by spaces; unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


_models: dict[str, Bpe] = {}


def model(path: str) -> Bpe:
    """A worker loads each file once."""
    if path not in _models:
        _models[path] = Bpe(path)
    return _models[path]


class Memo(dict):
    """What ``make`` gives for a word, kept for short words up to a number of entries."""

    def __init__(self, make, most: int = MEMO):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        value = self.make(word)
        if isinstance(word, int) or len(word) <= MEMO_WORD:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


_memos: dict[tuple, Memo] = {}


def memo(kind: str, path: str, make, most: int = MEMO) -> Memo:
    return _memos.setdefault((kind, path), Memo(make, most))


def encode_column(df: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, ids array<int>: the texts' ids."""

    def make():
        bpe = model(path)
        words = memo("ids", path, lambda p: [p] if isinstance(p, int) else bpe.encode_word(p))

        def f(batch):
            ids = [[i for w in map(words.__getitem__, bpe.pieces(x)) for i in w] for x in strings(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

        return f

    return map_batches(df.select(F.col(id_col).alias("id"), text), make, f"id {df.schema[id_col].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode_column(df: DataFrame, path: str, ids: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """id, text: the ids as text; null ids give an empty text."""

    def make():
        bpe = model(path)

        def f(batch):
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

        return f

    return map_batches(df.select(F.col(id_col).alias("id"), ids), make, f"id {df.schema[id_col].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trip_digests(df: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encodes each text and decodes its ids, and returns digests of both instead of the long columns.

    Decoding joins the names of tokens, so a word's decoded part is kept beside its ids.
    """

    def make():
        bpe = model(path)

        def entry(piece):
            ids = [piece] if isinstance(piece, int) else bpe.encode_word(piece)
            return len(ids), " ".join(map(str, ids)), bpe.decode(ids)

        words = memo("digests", path, entry)

        def f(batch):
            counts, ids_sha, text_sha = [], [], []
            for x in strings(batch.column(1)):
                found = list(map(words.__getitem__, bpe.pieces(x)))
                counts.append(sum([w[0] for w in found]))
                ids_sha.append(hashlib.sha256(" ".join([w[1] for w in found]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(" ".join([w[2] for w in found]).encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return f

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), text), make, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
