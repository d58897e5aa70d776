"""Katz backoff trigram model: counts from a training fold of the corpus, and the score of every text.

Words are runs of bytes other than white space, A-Z lowered; each text ends with one end token, counted as a token, and
begins after as many begin tokens as a context has. ``ORDER`` is the longest n-gram; the model is the same at any order.

Counts of 1 to 5 are discounted by Good-Turing (Katz's formula; where an order's counts of counts don't allow it, by the
absolute discount n1 / (n1 + 2 n2)). Words never seen share one class, which has what the word discounts set free. After
a context that was seen, an n-gram that was seen has its discounted share; others have the backoff weight times the word's
probability after the context without its first word, and so on down to the word alone. Weights are normalised exactly:
what is left over the lower probability of all words not seen there. A context whose n-grams are all frequent gives
1 / (its count + 1) away. A context never seen leaves the decision to the shorter one.

Tables are partitioned and grow with the corpus; only sums go to the driver.

* Chunks (about 6 MB of text): the distinct words' 64-bit hashes and each token's place among them. A text longer than a
  chunk goes on in the next, which begins with the words that its first contexts need.
* Word table: every chunk deals its distinct words and their training counts to parts by hash; a part adds them up and
  answers each chunk.
* Order by order, n-grams (64-bit hashes) with their training counts and the word's probability one order below go to the
  context's part, which adds up, and answers with counts and what the contexts' weights need. N-grams of a frequent
  context (more than 1 / (4 * parts) of all tokens) go by their own hash, so no context crowds a part; what parts know of it is
  added up and joined to the chunks that have it. A chunk sends at most one row a part and one an n-gram.
* Chunks are written once, in buckets; what parts answer is shuffled to them, they are not shuffled themselves. A turn makes only
  its own n-grams. Once an order below the last is answered, each chunk writes what it knows of it in the same buckets, and the
  answers are deleted: the turns of the next order read that, and neither make nor shuffle lower orders again.
* Every chunk then evaluates its tokens; what a text has in several chunks is added up.

Null and empty texts consist of the end token. Rows with a null id are scored, not learned from. Repeated rows are each
learned from and scored. Without training rows every token is of the unseen class and scores are 0. Texts of any length:
hashing sees 512 KB at a time, and a step of the model one chunk.
"""

from __future__ import annotations

import contextlib
import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, crc_fold, discard, in_steps, materialize, utf8
from .textops import Words, mix, without_long_words, word_spans

FOLDS, HELD_OUT, ORDER = 5, 1, 3
CHUNK_BYTES, TOKENS_PER_PART, KATZ = 6 << 20, 1_000_000, 5
#: N-grams whose probabilities are computed at a time.
STEP = 1 << 16
#: An order's n-grams are dealt in so many turns, each with its share of the parts: that much less of them moves at a time.
TURNS = {2: 2, 3: 5}
BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x52DCE729DA3C2B1B)
#: Kinds of rows. Chunks; their words for the parts; answers; n-grams of ordinary and frequent contexts; answers; what a part
#: knows of a frequent context; frequent contexts of a chunk; a frequent context's numbers; sums; an order that a chunk has.
CHUNK, WORDS, WORD_ANSWER, GRAMS, FREQUENT, ANSWER, FREQUENT_ANSWER, CONTEXT, WANTED, NUMBERS, SUMS, KNOWN = range(12)
ROW = "chunk long, kind int, level int, part int, ids array<long>, x binary, y binary, z binary"
SCHEMA = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("level", pa.int32()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one type as one compressed value."""
    return zstandard.compress(np.concatenate([np.array([len(a) for a in arrays], np.int64).view(np.uint8), *(np.ascontiguousarray(a).view(np.uint8) for a in arrays)]).tobytes(), 1)


def unpack(data: bytes, dtype, n: int = 1) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    sizes = np.frombuffer(raw, np.int64, n)
    values = np.frombuffer(raw, dtype, offset=8 * n)
    return np.split(values, np.cumsum(sizes)[:-1])


def rows(found: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 8, SCHEMA.types, strict=True)], schema=SCHEMA)


def listed(table: pa.Table) -> list[dict]:
    """The rows; binary values are not copied."""
    columns = [[v.as_buffer() for v in c] if pa.types.is_binary(c.type) else c.to_pylist() for c in table.columns]
    return [dict(zip(table.column_names, r, strict=True)) for r in zip(*columns, strict=True)]


def freed(out: pa.Table) -> pa.Table:
    """A group's result, once memory that Arrow keeps for later went back: two workers share an executor with its JVM."""
    pa.default_memory_pool().release_unused()
    return out


def discounts(n: np.ndarray) -> np.ndarray:
    """d[c] for c of 0 to KATZ (d[0] unused), from counts of counts n[1..KATZ + 1]."""
    d, n = np.ones(KATZ + 1), n.astype(float)
    if n[1] <= 0:
        return d
    c = np.arange(1, KATZ + 1)
    if (n[1 : KATZ + 1] > 0).all():
        tail = (KATZ + 1) * n[KATZ + 1] / n[1]
        if tail < 1:
            d[1:] = ((c + 1) * n[2 : KATZ + 2] / (c * n[1 : KATZ + 1]) - tail) / (1 - tail)
            if (d[1:] > 0).all() and (d[1:] < 1).all():
                return d
    off = n[1] / (n[1] + 2 * n[2])
    d[1:] = (c - np.where(off < 1, off, 0.5)) / c
    return d


@dataclasses.dataclass
class WordModel:
    """N tokens, V words, training texts, and the discounts of word counts."""

    n: int
    v: int
    texts: int
    d: np.ndarray
    unseen: float
    scale: float

    @classmethod
    def of(cls, n: int, v: int, texts: int, counts: np.ndarray) -> WordModel:
        d = discounts(counts)
        c = np.arange(KATZ + 1)
        free = float(((1 - d) * c * counts[: KATZ + 1])[1:].sum()) / n if n else 1.0
        scale = 1.0 if free > 0 else n / (n + 1)  # no rare words: give 1 / (N + 1) away
        return cls(n, v, texts, d, free if free > 0 else 1 / (n + 1), scale)

    def p(self, c: np.ndarray) -> np.ndarray:
        """Probability of words with these training counts."""
        return np.where(c > 0, self.scale * self.d[np.where(c <= KATZ, c, 0)] * c / max(self.n, 1), self.unseen)


def chunks(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """Chunk rows. ids: doc_ids and, after them, numbers of the rows; x: hashes of the distinct words; y: tokens' places;
    z: for each piece of a text its tokens, how many of them are context only, its fold (1: training, 2: held out), whether it
    begins the text."""
    fold = crc_fold("doc_id", FOLDS)
    source = documents.select(F.col("doc_id").cast("long"), "text", F.when(fold.isNull(), 0).when(fold == HELD_OUT, 2).otherwise(1).cast("int").alias("fold"))

    def hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
        """The words of each text."""
        for a, b in in_steps([len(t) for t in texts]):
            if b - a == 1:
                yield np.concatenate([Words([span]).hashes() for span in word_spans(texts[a])])
                continue
            w = Words(texts[a:b])
            yield from np.split(w.hashes(), w.first[1:])

    def run(batches):
        from pyspark import TaskContext

        base, k, number = TaskContext.get().partitionId() << 33, 0, 0
        for batch in batches:
            ids, texts, fold = batch.column(0).to_pylist(), without_long_words(utf8(batch.column(1))), batch.column(2).to_pylist()
            for a, b in in_steps([len(t) for t in texts], CHUNK_BYTES):
                # One chunk, or the chunks of one long text.
                parts = [list(hashes(texts[a:b]))] if len(texts[a]) <= CHUNK_BYTES else [list(hashes([span])) for span in word_spans(texts[a], CHUNK_BYTES)]
                lead = np.zeros(0, np.uint64)
                for j, words in enumerate(parts):
                    last = j == len(parts) - 1
                    lists = [np.concatenate([lead, h, np.full(int(last), END)]) for h in words]
                    known, place = np.unique(np.concatenate(lists), return_inverse=True)
                    sizes = np.array([[len(x) for x in lists], [len(lead)] * len(lists), fold[a:b], [int(j == 0)] * len(lists)], np.int32)
                    out = (base + k, CHUNK, None, None, [*ids[a:b], *(base + number + i for i in range(b - a))], known.tobytes(), pack(place.astype(np.int32)), pack(*sizes))
                    k += 1
                    lead = lists[0][max(0, len(lists[0]) - order + 1) :]
                    yield from rows([out]).to_batches()
                number += b - a

    return source.mapInArrow(run, ROW)


@dataclasses.dataclass
class Model:
    """The word model and the discounts of each order from 2 on."""

    words: WordModel
    parts: int
    d: dict[int, np.ndarray] = dataclasses.field(default_factory=dict)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the values, and where in it each distinct value begins."""
    order = np.argsort(values)
    values = values[order]
    return order, np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])


def numbered(order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each value's number among the distinct ones."""
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    return out


@dataclasses.dataclass
class Known:
    """An order that is answered: each token's n-gram, the n-grams' hashes and training counts, and probabilities of those asked
    for. From order 2 on also the contexts' scales and backoff weights (the order below's numbers, then BEGIN)."""

    of_token: np.ndarray
    key: np.ndarray
    n: np.ndarray
    p: Callable[[np.ndarray], np.ndarray]
    scale: np.ndarray | None = None
    weight: np.ndarray | None = None

    @classmethod
    def of(cls, model: Model, order: int, below: Known, of_token: np.ndarray, key: np.ndarray, n: np.ndarray, context: np.ndarray, lower: np.ndarray, scale: np.ndarray, weight: np.ndarray) -> Known:
        """context, lower: the n-grams' numbers one order below, without their last and first words."""
        d, seen = model.d[order], np.append(below.n, model.words.texts)

        def p(at: np.ndarray) -> np.ndarray:
            c, m = context[at], n[at]
            out = scale[c] * d[np.where(m <= KATZ, m, 0)] * m / np.maximum(seen[c], 1)
            off = np.flatnonzero(m == 0)
            out[off] = weight[c[off]] * below.p(lower[at[off]])
            return out

        return cls(of_token, key, n, p, scale, weight)


class Grams:
    """The distinct n-grams of a chunk, in the order in which parts see them, or those of a turn's parts.

    tokens: the tokens whose n-grams these are; of_token: each one's n-gram; context, word: what it is made of; lower: the
    n-gram without its first word; key: its hash; seen: the context's training count; runs: where the next context begins;
    wanted: hashes of all frequent contexts (first turn only).
    """

    def __init__(self, chunk: Chunk, below: Known, model: Model, turn: int | None = None, turns: int = 1):
        place, of_token, width = chunk.place, below.of_token, len(chunk.words)
        before = chunk.before(below)
        hashes, count = np.append(below.key, BEGIN), np.append(below.n, model.words.texts)
        often = count * 4 * model.parts > model.words.n
        place_of = mix(hashes) % np.uint64(model.parts)
        parts = np.uint64(model.parts)
        self.tokens, self.wanted = np.arange(len(place)), np.zeros(0, np.uint64)
        if turn is not None:
            after = np.flatnonzero(often[before])
            if turn == 0:
                self.wanted = np.unique(hashes[np.unique(before[after])])
            if turns > 1:
                mine = (place_of % np.uint64(turns) == turn)[before]
                mine[after] = self.hashed(hashes[before[after]], chunk.words[place[after]]) % parts % np.uint64(turns) == turn
                self.tokens = np.flatnonzero(mine)
        order, first = distinct(before[self.tokens] * width + place[self.tokens])
        at = self.tokens[order[first]]
        inverse = numbered(order, first)
        context, word, lower = before[at], place[at], of_token[at]
        key = self.hashed(hashes[context], chunk.words[word])
        frequent = often[context]
        part = np.where(frequent, key % parts, place_of[context]).astype(np.int64)
        # Contexts ascend already; a stable sort of small numbers takes linear time.
        order = np.argsort((frequent * model.parts + part).astype(np.min_scalar_type(2 * model.parts)), kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.context, self.word, self.lower, self.key, self.seen, self.frequent, self.part, self.of_token = context[order], word[order], lower[order], key[order], count[context][order], frequent[order], part[order], back[inverse]
        self.head = hashes[self.context]
        self.runs = np.flatnonzero(np.append(True, (self.context[1:] != self.context[:-1]) | (self.frequent[1:] != self.frequent[:-1]) | (self.frequent[1:] & (self.part[1:] != self.part[:-1])))[: len(self.context)])

    @staticmethod
    def hashed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return mix(context * np.uint64(0x9E3779B97F4A7C15) + word)


class Chunk:
    """A chunk row and, if given, the answers to it."""

    def __init__(self, table: pa.Table, answers: pa.Table | None = None):
        (row,) = listed(table)
        self.id = row["chunk"]
        self.words = np.frombuffer(row["x"], np.uint64)
        (self.place,) = unpack(row["y"], np.int32)
        self.sizes, lead, fold, begins = unpack(row["z"], np.int32, 4)
        self.ids, self.numbers = row["ids"][: len(self.sizes)], row["ids"][len(self.sizes) :]
        self.fold = fold
        self.begins = np.cumsum(self.sizes) - self.sizes
        #: Tokens that count; the others are there as context.
        self.own = np.ones(len(self.place), bool)
        for i in np.flatnonzero(lead):
            self.own[self.begins[i] : self.begins[i] + lead[i]] = False
        self.training = self.own & np.repeat(fold == 1, self.sizes)
        self.answers: dict[tuple[int, int | None], list[dict]] = {}
        for r in sorted(listed(answers) if answers else [], key=lambda r: r["part"] or 0):
            self.answers.setdefault((r["kind"], r["level"]), []).append(r)

    def training_counts(self, codes: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(codes[self.training], minlength=width)

    def before(self, below: Known) -> np.ndarray:
        """Each token's context; each text begins after BEGIN."""
        out = np.empty(len(self.place), np.int64)
        out[1:] = below.of_token[:-1]
        out[self.begins] = len(below.key)
        return out

    def up_to(self, model: Model, order: int) -> Known:
        """The n-grams of an order, recursively from the words."""
        if order == 1:
            n = np.concatenate([unpack(r["x"], np.int64)[0] for r in self.answers.get((KNOWN, 1)) or self.answers[WORD_ANSWER, None]])
            return Known(self.place, self.words, n, lambda at: model.words.p(n[at]))
        below = self.up_to(model, order - 1)
        return self.read(model, order, below) if (KNOWN, order) in self.answers else self.answered(model, order, below)

    def answered(self, model: Model, order: int, below: Known) -> Known:
        """An order's n-grams from what parts answer."""
        grams = Grams(self, below, model)
        n = np.concatenate([unpack(r["x"], np.int64)[0] for kind in (ANSWER, FREQUENT_ANSWER) for r in self.answers.get((kind, order), [])])
        few, more, mass = np.zeros((KATZ, len(grams.runs))), np.zeros(len(grams.runs)), np.zeros(len(grams.runs))
        plain = ~grams.frequent[grams.runs]
        if plain.any():
            got = [(unpack(r["y"], np.int64, KATZ + 1), unpack(r["z"], np.float64)[0]) for r in self.answers[ANSWER, order]]
            for j in range(KATZ):
                few[j, plain] = np.concatenate([g[j] for g, _ in got])
            more[plain] = np.concatenate([g[KATZ] for g, _ in got])
            mass[plain] = np.concatenate([m for _, m in got])
        numbers = {r["ids"][0]: (np.frombuffer(r["x"], np.int64), np.frombuffer(r["y"], np.float64)[0]) for r in self.answers.get((NUMBERS, order), [])}
        for i in np.flatnonzero(~plain):
            f, m = numbers[int(grams.head[grams.runs[i]].view(np.int64))]
            few[:, i], more[i], mass[i] = f[:KATZ], f[KATZ], m
        scale, weight = np.ones(len(below.key) + 1), np.zeros(len(below.key) + 1)
        heads = grams.context[grams.runs]
        scale[heads], weight[heads] = weights(model.d[order], grams.seen[grams.runs], few, more, mass)
        return Known.of(model, order, below, grams.of_token, grams.key, n, grams.context, grams.lower, scale, weight)

    def write(self, order: int, known: Known, below: Known) -> tuple:
        """The row of an order. x: which tokens have an n-gram for the first time, and the n-grams of the others; y: counts;
        z: scales and weights. N-grams are numbered as they come."""
        at = np.empty(len(known.key), np.int64)
        at[known.of_token[::-1]] = np.arange(len(self.place))[::-1]  # the first one is written last
        new = np.zeros(-(-len(self.place) // 32) * 32, bool)
        new[at] = True
        number = np.cumsum(new, dtype=np.int32) - np.int32(1)
        old = np.flatnonzero(~new[: len(self.place)])
        n = np.empty(len(at), np.int64)
        n[number[at]] = known.n
        backs_off = np.zeros(len(known.weight), bool)
        backs_off[self.before(below)[at[known.n == 0]]] = True
        return (self.id, KNOWN, order, None, None, pack(np.packbits(new).view(np.int32), number[at[known.of_token[old]]]), pack(n), pack(known.scale, np.where(backs_off, known.weight, 0.0)))

    def read(self, model: Model, order: int, below: Known) -> Known:
        """What ``write`` wrote."""
        (row,) = self.answers[KNOWN, order]
        bits, old = unpack(row["x"], np.int32, 2)
        scale, weight = unpack(row["z"], np.float64, 2)
        new = np.unpackbits(bits.view(np.uint8), count=len(self.place)).view(bool)
        at, of_token = np.flatnonzero(new), np.cumsum(new) - 1
        of_token[~new] = old
        context, (n,) = self.before(below)[at], unpack(row["y"], np.int64)
        key = Grams.hashed(np.append(below.key, BEGIN)[context], self.words[self.place[at]])
        return Known.of(model, order, below, of_token, key, n, context, below.of_token[at], scale, weight)


def weights(d: np.ndarray, seen: np.ndarray, few: np.ndarray, more: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts: the scale of seen n-grams and the backoff weight of others."""
    kept, rare = np.zeros(len(seen)), np.zeros(len(seen), bool)
    for c in range(1, KATZ + 1):
        kept += d[c] * c * few[c - 1]
        if d[c] < 1:
            rare |= few[c - 1] > 0
    kept += more
    scale = np.where(rare, 1.0, seen / (seen + 1.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        left = 1 - scale * kept / seen
        weight = np.where(seen > 0, left / np.maximum(1 - mass, 1e-300), 1.0)
    return scale, weight


def deal_words(table: DataFrame, parts: int) -> DataFrame:
    bounds = np.array([-(-(i << 64) // parts) for i in range(1, parts)], dtype=np.uint64)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                c = Chunk(pa.Table.from_batches([batch.slice(i, 1)]))
                n = c.training_counts(c.place, len(c.words)).astype(np.int64)
                at = np.concatenate([[0], np.searchsorted(c.words, bounds), [len(c.words)]])
                out = [(c.id, WORDS, None, p, None, c.words[a:b].tobytes(), pack(n[a:b]), None) for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
                yield from rows(out).to_batches()

    return table.mapInArrow(run, ROW)


def add_words(table: pa.Table) -> pa.Table:
    """A part's words added up; an answer for each chunk; the part's sums."""
    found = listed(table)
    keys = [np.frombuffer(r["x"], np.uint64) for r in found]
    known, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.rint(np.bincount(inverse, np.concatenate([unpack(r["y"], np.int64)[0] for r in found]), len(known))).astype(np.int64)
    answers = np.split(total[inverse], np.cumsum([len(k) for k in keys])[:-1])
    out = [(r["chunk"], WORD_ANSWER, None, r["part"], None, pack(a), None, None) for r, a in zip(found, answers, strict=True)]
    sums = [total.sum(), (total > 0).sum(), *((total == j).sum() for j in range(1, KATZ + 2))]
    return rows([*out, (None, SUMS, None, found[0]["part"], None, np.array(sums, np.int64).tobytes(), None, None)])


def deal_grams(model: Model, order: int, turn: int):
    """A chunk's n-grams for every ``TURNS``-th part: x: hashes; y: training counts and the contexts' run lengths; z: the words'
    probabilities one order below (0 where this chunk has not trained on the n-gram) and the contexts' hashes."""
    turns = TURNS.get(order, 6)

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(table, answers)
        below = c.up_to(model, order - 1)
        g = Grams(c, below, model, turn, turns)
        n = np.bincount(g.of_token[c.training[g.tokens]], minlength=len(g.key)).astype(np.int64)
        lower, trained = np.zeros(len(n)), np.flatnonzero(n)
        lower[trained] = below.p(g.lower[trained])
        out = []
        starts = np.flatnonzero(np.append(True, (g.part[1:] != g.part[:-1]) | (g.frequent[1:] != g.frequent[:-1]))[: len(g.key)])
        for a, b in zip(starts, np.append(starts, len(g.key))[1:], strict=True):
            begin = g.runs[np.searchsorted(g.runs, a) : np.searchsorted(g.runs, b)]
            heads, lengths = g.head[begin], np.diff(np.append(begin, b))
            out.append((c.id, FREQUENT if g.frequent[a] else GRAMS, order, int(g.part[a]), None, g.key[a:b].tobytes(), pack(n[a:b], lengths), pack(lower[a:b].view(np.uint64), heads)))
        if len(g.wanted):
            out.append((c.id, WANTED, order, 0, g.wanted.view(np.int64).tolist(), None, None, None))
        return rows(out)

    return run


def add_grams(order: int):
    """A part's n-grams added up; answers; what the weights of its contexts need."""

    def of_kind(found: list[dict], frequent: bool) -> tuple[list[tuple], np.ndarray]:
        keys = [np.frombuffer(r["x"], np.uint64) for r in found]
        numbers = [unpack(r["y"], np.int64, 2) for r in found]
        others = [unpack(r["z"], np.uint64, 2) for r in found]
        heads, head_of = np.unique(np.concatenate([h for _, h in others]), return_inverse=True)
        head_of_gram = np.repeat(head_of, np.concatenate([lengths for _, lengths in numbers]))
        order_, first = distinct(np.concatenate(keys))
        total = np.add.reduceat(np.concatenate([n for n, _ in numbers])[order_], first)
        lower = np.maximum.reduceat(np.concatenate([p for p, _ in others]).view(np.float64)[order_], first)  # the same in all chunks that have it
        seen = np.flatnonzero(total)
        head, c = head_of_gram[order_[first[seen]]], total[seen]
        few = [np.bincount(head[c == j], minlength=len(heads)) for j in range(1, KATZ + 1)]
        more = np.rint(np.bincount(head, np.where(c > KATZ, c, 0), len(heads))).astype(np.int64)
        mass = np.bincount(head, lower[seen], len(heads))
        out, at, at_head, answer = [], 0, 0, total[numbered(order_, first)]
        for r, k, (_, lengths), (_, x) in zip(found, keys, numbers, others, strict=True):
            own, n = head_of[at_head : at_head + len(x)], answer[at : at + len(k)]
            if frequent:
                out.append((r["chunk"], FREQUENT_ANSWER, order, r["part"], None, pack(n), None, None))
            else:
                # Only what backs off needs the mass.
                unseen = np.minimum.reduceat(n, np.cumsum(lengths) - lengths) == 0
                out.append((r["chunk"], ANSWER, order, r["part"], None, pack(n), pack(*(f[own] for f in few), more[own]), pack(np.where(unseen, mass[own], 0.0))))
            at, at_head = at + len(k), at_head + len(x)
        if frequent:
            for i, h in enumerate(heads.view(np.int64).tolist()):
                out.append((None, CONTEXT, order, None, [h], np.array([*(f[i] for f in few), more[i]], np.int64).tobytes(), np.array([mass[i]]).tobytes(), None))
        return out, np.array([(total == j).sum() for j in range(1, KATZ + 2)], np.int64)

    def run(table: pa.Table) -> pa.Table:
        found, sums = listed(table), np.zeros(KATZ + 1, np.int64)
        out = [tuple(r[k] for k in SCHEMA.names) for r in found if r["kind"] == WANTED]
        for kind in (GRAMS, FREQUENT):
            if own := [r for r in found if r["kind"] == kind]:
                more, n = of_kind(own, kind == FREQUENT)
                out, sums = out + more, sums + n
        return rows([*out, (None, SUMS, order, found[0]["part"], None, sums.tobytes(), None, None)])

    return run


def numbers_of_contexts(made: DataFrame) -> DataFrame:
    """Rows NUMBERS: for each chunk the sums of its frequent contexts."""

    def together(key, table):
        x = sum(np.frombuffer(v, np.int64) for v in table.column("x").to_pylist())
        y = sum(sorted(np.frombuffer(v, np.float64)[0] for v in table.column("y").to_pylist()))
        return pa.table({"h": pa.array([key[0].as_py()]), "x": pa.array([x.tobytes()], pa.binary()), "y": pa.array([np.array([y]).tobytes()], pa.binary())})

    found = made.where(f"kind = {CONTEXT}").select(F.col("ids")[0].alias("h"), "x", "y").groupBy("h").applyInArrow(together, "h long, x binary, y binary")
    wanted = made.where(f"kind = {WANTED}").select("chunk", "level", F.explode("ids").alias("h"))
    return wanted.join(found, "h").select("chunk", F.lit(NUMBERS).alias("kind"), "level", F.lit(None).cast("int").alias("part"), F.array("h").alias("ids"), "x", "y", F.lit(None).cast("binary").alias("z"))


def write_order(model: Model, order: int):
    """What a chunk knows of the orders up to the one that was answered: a row for each."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(table, answers)
        below = c.up_to(model, order - 1)
        lower = [tuple(v.to_pybytes() if isinstance(v := r[k], pa.Buffer) else v for k in SCHEMA.names) for level in range(1, order) for r in c.answers.get((KNOWN, level), [])]
        return rows([*(lower or [(c.id, KNOWN, 1, None, None, pack(below.n), None, None)]), c.write(order, c.answered(model, order, below), below)])

    return run


RESULT = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def evaluate(model: Model, order: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(table, answers)
        found, docs, own = c.up_to(model, order), len(c.sizes), c.own
        doc, n = np.repeat(np.arange(docs), c.sizes)[own], c.up_to(model, 1).n[c.place][own]
        log_p = np.concatenate([np.log10(found.p(np.arange(a, min(a + STEP, len(found.key))))) for a in range(0, len(found.key), STEP)])
        return pa.table({
            "row": pa.array(c.numbers, pa.int64()), "doc_id": pa.array(c.ids, pa.int64()), "held_out": pa.array(c.fold == 2), "n_tokens": np.bincount(doc, minlength=docs),
            "n_known": np.bincount(doc[n > 0], minlength=docs), "base_score": np.bincount(doc, np.log10((n + 0.5) / (model.words.n + 0.5 * (model.words.v + 1))), docs),
            "score": np.bincount(doc, log_p[found.of_token][own], docs),
        })

    return run


def score(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    with contextlib.ExitStack() as tables:
        return _score(documents, order, tables)


def _score(documents: DataFrame, order: int, tables: contextlib.ExitStack) -> DataFrame:
    spark = documents.sparkSession
    told = tables.enter_context(bucketed(chunks(documents, order), "chunk"))
    sizes = told.select(F.count("*").alias("chunks"), F.sum(F.octet_length("x")).alias("bytes")).first()
    if not sizes["chunks"]:
        return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    texts = documents.where(crc_fold("doc_id", FOLDS) != HELD_OUT).count()
    # Distinct words of all chunks are about a quarter of the tokens.
    parts = max(16, -(-(sizes["bytes"] // 2) // TOKENS_PER_PART))
    words = materialize(deal_words(told, parts).groupBy("part").applyInArrow(lambda part: freed(add_words(part)), ROW))
    sums = _sums(words, KATZ + 3)
    model = Model(WordModel.of(int(sums[0]), int(sums[1]), texts, np.append(0, sums[2:])), parts)
    answers = words.where(f"kind = {WORD_ANSWER}")

    def added(level: int):
        add = add_grams(level)
        return lambda part: freed(add(part))

    def of_chunks(f, schema: str) -> DataFrame:
        """``f`` of each chunk and its answers. The chunks lie in buckets, so only answers are shuffled."""
        return told.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda chunk, got: freed(f(chunk, got)), schema)

    for level in range(2, order + 1):
        turns, sums = [], np.zeros(KATZ + 1, np.int64)
        for turn in range(TURNS.get(level, 6)):
            dealt = of_chunks(deal_grams(model, level, turn), ROW)
            turns.append(materialize(dealt.groupBy("part").applyInArrow(added(level), ROW)))
            sums = sums + _sums(turns[-1])
        model.d[level] = discounts(np.append(0, sums))
        made = turns[0]
        for t in turns[1:]:
            made = made.unionAll(t)
        numbers = materialize(numbers_of_contexts(made))
        answers = answers.unionAll(made.where(F.col("kind").isin(ANSWER, FREQUENT_ANSWER))).unionAll(numbers)
        if level < order:
            answers = tables.enter_context(bucketed(of_chunks(write_order(model, level), ROW), "chunk"))
            for t in (words, *turns, numbers):
                discard(t)
            words = None
    pieces = materialize(of_chunks(evaluate(model, order), RESULT))
    return pieces.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(model.words.n).cast("long").alias("train_tokens"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"),
    ).drop("row")


def _sums(made: DataFrame, n: int = KATZ + 1) -> np.ndarray:
    """Over all parts; each is n numbers, which Spark adds up. Zeros if there is no part."""
    rows_ = made.where(f"kind = {SUMS}").select("x")

    def add(batches):
        total = None
        for batch in batches:
            for v in batch.column(0).to_pylist():
                x = np.frombuffer(v, np.int64)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["x"])

    found = rows_.mapInArrow(add, "x array<long>").select(F.posexplode("x").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").collect()
    return np.array([r["n"] for r in found] or [0] * n, np.int64)


__all__ = ["Chunk", "Grams", "Known", "Model", "WordModel", "chunks", "discounts", "score", "weights"]
