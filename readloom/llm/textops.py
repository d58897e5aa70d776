"""Vectorised text passes: words, hashes of spans, character n-grams, and a logistic regression on sparse rows.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D; only A to Z are lowered.

A vectorised step takes some 50 bytes of memory a byte of text, so it sees at most STEP_BYTES at once: longer texts come in
spans, cut at white space (word_spans), at line ends (line_spans) or anywhere with an overlap (char_grams). A word or line
that is itself longer stands there as a digest. Memory is then a few times the text's own size, however long it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np

from .common import STEP_BYTES, in_steps

WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            column = np.full(n + 1, base, np.uint64)
            column[0] = 1
            _powers[k] = np.cumprod(column, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """The values once each, rising. (np.unique hashes whole numbers, which is some ten times slower than sorting them.)"""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


class Words:
    """The words of some texts (UTF-8). doc: each word's text; first, count: each text's words."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.begin = np.append(0, np.cumsum(sizes + 1))[:-1]
        self.sizes = sizes
        white = WHITE[self.raw]
        edge = np.flatnonzero(np.diff(white.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.begin)
        self.count = np.diff(np.append(self.first, len(self.starts)))
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self._sums: np.ndarray | None = None

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of lowered spans."""
        power, inverse = powers(len(self.raw))
        if self._sums is None:
            self._sums = np.zeros(len(self.raw) + 1, np.uint64)
            np.cumsum((LOWER[self.raw].astype(np.uint64) + np.uint64(1)) * power[: len(self.raw)], out=self._sums[1:])
        size = (ends - starts).astype(np.uint64)
        return mix((self._sums[ends] - self._sums[starts]) * inverse[starts] + size * np.uint64(0xD6E8FEB86659FD93))

    def hashes(self) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n words in a row, and the text of each; of a text with fewer words, the whole sequence."""
        h = self.hashes()
        out, docs = [], []
        if (self.count >= n).any():
            place = np.arange(len(h)) - self.first[self.doc]
            at = np.flatnonzero(place <= self.count[self.doc] - n)
            out.append(chained(h, at, n))
            docs.append(self.doc[at])
        for d in np.flatnonzero((self.count > 0) & (self.count < n)):
            out.append(chained(h, self.first[d : d + 1], self.count[d]))
            docs.append(np.array([d]))
        if not out:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        docs_, values = np.concatenate(docs), np.concatenate(out)
        order = np.argsort(docs_, kind="stable")
        return values[order], docs_[order]


def chained(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """One hash of the n word hashes from each place on."""
    value = np.full(len(at), 0x5851F42D4C957F2D + n, np.uint64)
    for k in range(n):
        value = mix(value * np.uint64(0x2545F4914F6CDD1D) + h[at + k])
    return value


LONG = 1 << 16
_long_word = re.compile(rb"[^\x20\x09-\x0D]{%d,}" % LONG)


def _digest(found: re.Match) -> bytes:
    """Stands for a long word: its first byte, a digest of its lowered bytes, its last two bytes."""
    word = found[0]
    return word[:1] + hashlib.blake2b(word.lower(), digest_size=16).hexdigest().encode() + word[-2:]


def without_long_words(texts: list[bytes]) -> list[bytes]:
    """The texts with digests for words of 64 KB or more, so that such a word is the same in texts of any length."""
    return [t if len(t) < LONG else _long_word.sub(_digest, t) for t in texts]


def word_spans(text: bytes, limit: int = STEP_BYTES) -> Iterator[bytes]:
    """The text in spans of at most ``limit`` bytes that cut no word; words of 64 KB or more are replaced by a digest."""
    if len(text) <= limit:
        yield text
        return
    text, at = _long_word.sub(_digest, text), 0
    while len(text) - at > limit:
        end = max(text.rfind(c, at, at + limit) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) + 1
        yield text[at:end]
        at = end
    yield text[at:]


def line_spans(text: bytes, limit: int = STEP_BYTES) -> Iterator[bytes]:
    """The text in spans of whole lines of at most ``limit`` bytes; a longer line is replaced by a digest."""
    at = 0
    while len(text) - at > limit:
        end = text.rfind(b"\n", at, at + limit) + 1
        if end:
            yield text[at:end]
        else:
            end = text.find(b"\n", at + limit) + 1 or len(text)
            yield hashlib.blake2b(memoryview(text)[at:end]).hexdigest().encode()
        at = end
    yield text[at:]


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, rising."""
    for a, b in in_steps([len(t) for t in texts]):
        if len(texts[a]) > STEP_BYTES:  # alone in its step
            yield _long_shingles(texts[a], n)
            continue
        values, docs = Words(without_long_words(texts[a:b])).shingles(n)
        order = np.lexsort((values, docs))
        values, docs = values[order], docs[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
        values, docs = values[new], docs[new]
        edge = np.searchsorted(docs, np.arange(b - a + 1))
        for i in range(b - a):
            yield values[edge[i] : edge[i + 1]]


def _long_shingles(text: bytes, n: int) -> np.ndarray:
    found, carry = [], np.zeros(0, np.uint64)
    for span in word_spans(text):
        h = np.concatenate([carry, Words([span]).hashes()])
        if len(h) >= n:
            found.append(distinct(chained(h, np.arange(len(h) - n + 1), n)))
            h = h[len(h) - n + 1 :]
        carry = h
    if not found and len(carry):
        return chained(carry, np.zeros(1, np.int64), len(carry))
    return distinct(np.concatenate(found)) if found else carry


GRAM = np.random.default_rng(7).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_space = LOWER.copy()
_space[WHITE] = 32
_to_space = _space.tobytes()


def char_grams(texts: list[bytes], orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes (``bits`` bits) of the n-grams of bytes at every position, and the text of each, in steps of bounded size.

    A-Z are lowered and white space is a space; each text is put between spaces, so no n-gram meets another text. A long
    text comes in spans which overlap by all but one letter of the longest n-gram, so an n-gram may come twice.
    """
    most = max(orders)
    for a, b in in_steps([len(t) for t in texts]):
        if len(texts[a]) <= STEP_BYTES:
            joined = [x for t in texts[a:b] for x in (b" ", t.translate(_to_space), b" " * most)]
            sizes = np.array([len(t) + 1 + most for t in texts[a:b]])
            owner, ends = np.repeat(np.arange(a, b), sizes), np.cumsum(sizes)
            for n, (value, doc) in zip(sorted(orders), _grams(b"".join(joined), owner, orders, bits), strict=True):
                # What begins so late that it reaches the next text becomes the text's first n-gram once more.
                late = (ends[:, None] - np.arange(1, n)).ravel()
                inside = late < len(value)
                value[late[inside]] = np.repeat(value[ends - sizes], n - 1)[inside]
                yield value, doc
            continue
        whole = b" " + texts[a].translate(_to_space) + b" " * most
        for at in range(0, len(whole), STEP_BYTES):
            span = whole[at : at + STEP_BYTES + most - 1]
            yield from _grams(span, np.full(len(span), a), orders, bits)


def _grams(data: bytes, owner: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    value = np.zeros(len(raw), np.uint64)
    for n in range(1, min(max(orders), len(raw)) + 1):
        value[: len(raw) - n + 1] += raw[n - 1 :] * GRAM[n - 1]
        if n in orders:
            whole = len(raw) - n + 1
            yield (mix(value[:whole] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64), owner[:whole]


def logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, targets: np.ndarray, width: int, ridge: float, steps: int = 150, weights: np.ndarray | None = None) -> np.ndarray:
    """Weights, then the intercept, of a logistic regression on sparse rows with targets from 0 to 1 (L-BFGS).

    rows, columns, values: the non-zero cells. Targets all alike, or no cells, are no trouble: ridge keeps it finite.
    """
    n = len(targets)
    w8 = np.ones(n) if weights is None else weights

    def loss(w):
        z = np.bincount(rows, values * w[columns], n) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        g = (p - targets) * w8
        gradient = np.append(np.bincount(columns, values * g[rows], width), g.sum()) / n
        gradient[:-1] += ridge * w[:-1]
        return float((w8 * (np.logaddexp(0, z) - targets * z)).sum() / n + ridge / 2 * (w[:-1] @ w[:-1])), gradient

    w = np.zeros(width + 1)
    f, g = loss(w)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, stack = -g, []
        for s, y in reversed(memory):
            a = (s @ d) / (s @ y)
            stack.append(a)
            d = d - a * y
        if memory:
            s, y = memory[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(memory, reversed(stack), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        slope, t = float(g @ d), 1.0
        if slope > -1e-12:
            break
        while True:
            f2, g2 = loss(w + t * d)
            if f2 <= f + 1e-4 * t * slope or t < 1e-8:
                break
            t /= 2
        s, y = t * d, g2 - g
        if s @ y > 1e-14:
            memory = [*memory[-9:], (s, y)]
        done = abs(f - f2) < 1e-9
        w, f, g = w + s, f2, g2
        if done:
            break
    return w
