"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers run one after the other.

* The pattern that cuts a text into pieces is a machine of 11 states over 12 classes of letters (the text's end is one). A
  transition tells how many cuts it finds and where (before this letter, before the one before it). Texts are laid out in
  chunks, and every chunk's map is computed for all chunks at once: for each start state the end state and the number of
  tokens of the pieces that begin in the chunk. The maps of a text's chunks are composed by a parallel prefix scan
  (end states follow each other, numbers add up), and the composed map's number for a fresh start is the text's.
* BPE inside a piece is a machine over bytes. Its state is what later bytes can still depend on: the longest suffix of
  the piece that begins a token, and the last token at each border inside it. Transitions carry the change of the
  count (a longer token may replace shorter ones, so it can be negative); they are compiled when first met and kept up
  to a bound. Pieces seen often are kept as one composed transition.

Null and empty texts have no tokens. Repeated rows keep their number. Very long texts are more chunks, very long pieces
more steps of the machine; neither needs a limit. Other columns stay out.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo, model, newer
from .common import in_steps, map_batches, strings

LIMIT = 1024
#: Letters in a chunk; letters worked on at once; compiled states and composed pieces that a worker keeps at once.
CHUNK, STEP, STATES, COMPOSED = 256, 1 << 20, 300_000, 1_000_000

# Classes of letters.
(SPACE, WHITE, LETTER, ONE, ER, E, ELL, NUMBER, QUOTE, OTHER, LAST, PAD) = range(12)
# States of the cutter.
(FRESH, LET, NUM, OTH, SP, SPS, WH, WHS, APO, RV, EL) = range(11)
N = 11


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, k in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", WHITE)):
        out[[ord(c) for c in regex.findall(pattern, every)]] = k
    for text, k in ((newer(), OTHER), (" ", SPACE), ("stmd", ONE), ("rv", ER), ("e", E), ("l", ELL), ("'", QUOTE)):
        out[[ord(c) for c in text] or slice(0)] = k
    return out


@functools.cache
def cutter() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and cuts[class, state]: 1 before this letter, 2 before the one before it."""
    nxt, cut = np.zeros((12, N), np.uint8), np.zeros((12, N), np.uint8)
    letters = (LETTER, ONE, ER, E, ELL)
    begin = {SPACE: SP, WHITE: WH, **dict.fromkeys(letters, LET), NUMBER: NUM, QUOTE: APO, OTHER: OTH}
    for c, first in begin.items():
        for s in range(N):
            nxt[c, s], cut[c, s] = first, 1  # a new piece, unless a rule below says otherwise

        def rule(s, to, cuts):
            nxt[c, s], cut[c, s] = to, cuts  # noqa: B023

        if c in letters:
            rule(LET, LET, 0)
        if c == NUMBER:
            rule(NUM, NUM, 0)
        if c in (OTHER, QUOTE):
            rule(OTH, OTH, 0)
            rule(APO, OTH, 0)
        if c in (SPACE, WHITE):
            for s in (SP, SPS, WH, WHS):  # white space runs on
                rule(s, SPS if c == SPACE else WHS, 0)
        else:
            joined = OTH if c == QUOTE else first
            rule(SP, joined, 0)  # one space goes with the piece that follows
            rule(SPS, joined, 2)  # of several, the last
            rule(WHS, first, 3)  # other white space: the last alone
        if c == ONE:
            rule(APO, FRESH, 0)  # 's 't 'm 'd
        if c == ER:
            rule(APO, RV, 0)
        if c == ELL:
            rule(APO, EL, 0)
        for s, last in ((RV, E), (EL, ELL)):
            if c == last:
                rule(s, FRESH, 0)  # 're 've 'll
            else:
                rule(s, first, 2 if c in letters else 3)  # no contraction: the quote stood alone
    cut[LAST] = 1
    cut[LAST, [RV, EL]] = 3  # the text ends in 'r, 'v or 'l: the quote stood alone
    nxt[PAD] = np.arange(N)
    return nxt, cut


class Chunks:
    """Chunks of some texts and what the cutter does in them.

    Letters are places in ``joined``, where each text has one more place at its end. ends[chunk, s]: the end state;
    heads: (chunk, s, place) of cuts found while start states still differ; common: (chunk, place) of those found after.
    """

    def __init__(self, texts: list[str]):
        sizes = np.array([len(x) + 1 for x in texts], np.int64)
        total = int(sizes.sum())
        self.joined = "\n".join(texts) + "\n"
        self.begin = np.cumsum(sizes) - sizes
        kind = classes()[np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        kind[self.begin + sizes - 1] = LAST
        per = -(-sizes // CHUNK)
        self.last = np.cumsum(per) - 1
        first, n = self.last + 1 - per, int(per.sum())
        self.owner = np.repeat(np.arange(len(texts)), per)
        self.inside = np.arange(n) - first[self.owner]
        self.at = self.begin[self.owner] + self.inside * CHUNK
        self.length = np.minimum(sizes[self.owner] - self.inside * CHUNK, CHUNK)
        grid = np.full((CHUNK, n), PAD, np.uint8)
        where = np.arange(total) - np.repeat(self.begin, sizes)
        grid[where % CHUNK, np.repeat(first, sizes) + where // CHUNK] = kind
        self._run(grid, n)

    def _run(self, grid: np.ndarray, n: int) -> None:
        nxt, cut = cutter()
        states, heads, k = np.tile(np.arange(N, dtype=np.uint8), (n, 1)), [], 0
        while k < CHUNK and (states[self.length > k] != states[self.length > k][:, :1]).any():
            row = grid[k][:, None]
            c = cut[row, states]
            states = nxt[row, states]
            for bit, back in ((2, 1), (1, 0)):
                chunk, s = np.nonzero(c & bit)
                heads.append((chunk, s, self.at[chunk] + k - back))
            k += 1
        state, common = states[:, 0], []
        for row in grid[k:]:
            c = cut[row, state]
            state = nxt[row, state]
            for bit, back in ((2, 1), (1, 0)):
                chunk = np.flatnonzero(c & bit)
                common.append((chunk, self.at[chunk] + k - back))
            k += 1
        self.ends = np.where((self.length > k - len(common) // 2)[:, None], state[:, None], states)
        chunk, s, place = (np.concatenate(x) for x in zip(*heads, strict=True)) if heads else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((place, s, chunk))
        self.heads = chunk[order], s[order], place[order]
        chunk, place = (np.concatenate(x) for x in zip(*common, strict=True)) if common else (np.zeros(0, np.int64),) * 2
        order = np.lexsort((place, chunk))
        self.common = chunk[order], place[order]

    def counts(self, words: Memo) -> np.ndarray:
        """Tokens of each text: the chunks' maps, composed."""
        n, joined = len(self.owner), self.joined
        (hc, hs, hp), (cc, cp) = self.heads, self.common
        # The first cut that a chunk finds, for each start state.
        none = -2  # a cut may be found one place before the chunk
        after = np.full(n, none, np.int64)
        new = np.append(True, cc[1:] != cc[:-1])[: len(cc)]
        after[cc[new]] = cp[new]
        first = np.repeat(after[:, None], N, axis=1)
        head = hc * N + hs
        new = np.append(True, head[1:] != head[:-1])[: len(head)]
        first.reshape(-1)[head[new]] = hp[new]
        for i in np.flatnonzero((first == none).any(axis=1))[::-1]:  # pieces longer than a chunk
            first[i] = np.where(first[i] == none, first[i + 1][self.ends[i]], first[i])
        # Where the piece ends that a chunk's last cut begins: the first cut from the next chunk on, or the text's end.
        stop = np.append(self.begin, len(joined))[self.owner + 1] - 1
        following = np.repeat(stop[:, None], N, axis=1)
        inner = np.flatnonzero(self.owner[1:] == self.owner[:-1])
        following[inner] = np.take_along_axis(first[inner + 1], self.ends[inner], axis=1)

        def tokens(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.fromiter(map(words.__getitem__, map(joined.__getitem__, map(slice, a.tolist(), b.tolist()))), np.int64, len(a))

        end = np.append(cp[1:], 0)[: len(cp)]
        edge = np.append(cc[1:] != cc[:-1], True)[: len(cc)]
        end[edge] = following[cc[edge], 0]  # after a common cut all start states have one end state
        numbers = np.repeat(np.rint(np.bincount(cc, tokens(cp, end), n)).astype(np.int64)[:, None], N, axis=1)
        end = np.append(hp[1:], 0)[: len(hp)]
        edge = np.append(head[1:] != head[:-1], True)[: len(head)]
        end[edge] = np.where(after[hc[edge]] != none, after[hc[edge]], following[hc[edge], hs[edge]])
        piece, back = np.unique(hp << 31 | (end - hp), return_inverse=True)  # start states mostly share them
        found = tokens(piece >> 31, (piece >> 31) + (piece & ((1 << 31) - 1)))
        numbers += np.rint(np.bincount(head, found[back], n * N)).astype(np.int64).reshape(n, N)
        return self.composed(numbers)[self.last]

    def composed(self, numbers: np.ndarray) -> np.ndarray:
        """For each chunk the tokens from its text's begin, by a scan in doubling steps over (end state, number) maps."""
        ends, numbers = self.ends.copy(), numbers.copy()
        many = np.flatnonzero(np.bincount(self.owner, minlength=len(self.begin))[self.owner] > 1)
        step, most = 1, int(self.inside.max(initial=0))
        while step <= most:
            late = many[self.inside[many] >= step]  # compose with the map that ends where this one begins
            before = ends[late - step]
            numbers[late] = numbers[late - step] + np.take_along_axis(numbers[late], before, axis=1)
            ends[late] = np.take_along_axis(ends[late], before, axis=1)
            step *= 2
        return numbers[:, FRESH]


class CountingBpe:
    """The byte machine, compiled as it is used."""

    def __init__(self, path: str):
        self.bpe = model(path)
        if self.bpe.suffix or self.bpe.nfc or self.bpe.lower:
            raise ValueError("made for vocabularies without word ends or a normalizer")
        self.tokens = {t: i for t, i in self.bpe.vocab.items() if self.bpe.order[i] >= 0}
        self.longest = max(map(len, self.tokens))
        self.heads = {t[:k] for t in self.tokens for k in range(1, len(t))}  # what begins a longer token
        self.reset()

    def reset(self) -> None:
        #: A state: suffix, and for each border in it the last token and the count, from its end. State 0: nothing read.
        self.states: list[tuple[str, tuple[int, ...], tuple[int, ...]]] = [("", (-1,), (0,))]
        self.ids = {self.states[0]: 0}
        self.steps: list[dict[str, tuple[int, int]]] = [{}]

    def compile(self, state: int, letter: str) -> tuple[int, int]:
        suffix, lasts, counts = self.states[state]
        text = suffix + letter
        n = len(text)
        fits, compatible = self.bpe.fits, self.bpe.compatible
        for size in range(min(n, self.longest), 0, -1):
            token = self.tokens.get(text[n - size :])
            if token is None:
                continue
            before = lasts[n - size]
            if before >= 0:
                key = before << 20 | token
                ok = fits.get(key)
                if ok is None:
                    ok = fits[key] = compatible(before, token)
                if not ok:
                    continue
            break
        count = counts[n - size] + 1
        at = next((k for k in range(n) if text[k:] in self.heads), n)
        new = (text[at:], (*lasts, token)[at:], tuple(c - count for c in (*counts, count)[at:]))
        to = self.ids.get(new)
        if to is None:
            to = self.ids[new] = len(self.states)
            self.states.append(new)
            self.steps.append({})
        # Counts in a state are relative to its end, which is 0.
        self.steps[state][letter] = to, count
        return to, count

    def count(self, piece: str | int) -> int:
        if isinstance(piece, int):
            return 1
        if len(self.states) > STATES:
            self.reset()
        steps, state, total = self.steps, 0, 0
        for letter in self.bpe.mapped(piece):
            step = steps[state].get(letter)
            if step is None:
                if len(self.states) > 2 * STATES:  # within one very long piece: keep the present state only
                    now = self.states[state]
                    self.reset()
                    steps, state = self.steps, self.ids.setdefault(now, len(self.states))
                    if state:
                        self.states.append(now)
                        self.steps.append({})
                step = self.compile(state, letter)
            state, change = step
            total += change
        return total


_memos: dict[str, Memo] = {}


#: A space after a letter begins a piece, whatever the cutter's state.
_sure = re.compile("(?<=[A-Za-z]) ")


def stretches(text: str) -> list[str]:
    """A very long text in parts of about STEP letters that have no piece in common; few texts have no such place."""
    out, at = [], 0
    while len(text) - at > 2 * STEP and (found := _sure.search(text, at + STEP)):
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


def count_texts(texts: list[str], path: str) -> list[int]:
    bpe = model(path)
    if path not in _memos:
        _memos[path] = Memo(CountingBpe(path).count, COMPOSED)
    words = _memos[path]
    whole: list[int] = []
    parts: list[str] = []
    added = [0] * len(texts)
    owner: list[int] = []
    for i, x in enumerate(texts):
        for part in bpe.split_added.split(x) if bpe.added and "<" in x and bpe.split_added.search(x) else [x]:
            if part in bpe.added:
                added[i] += 1
            else:
                found = stretches(part)
                parts += found
                owner += [i] * len(found)
    for a, b in in_steps([len(x) + 1 for x in parts], STEP):
        whole += Chunks(parts[a:b]).counts(words).tolist()
    for i, n in zip(owner, whole, strict=True):
        added[i] += n
    return added


def count_column(df: DataFrame, path: str, limit: int = LIMIT, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit."""

    def make():
        def f(batch):
            texts = strings(batch.column(1))
            n = count_texts(texts, path)
            size = [len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass")) for x in texts]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n])], ["id", "n_bytes", "n_tokens", "over_limit"])

        return f

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), text), make, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
