"""Vectorised passes over a batch of reads, for what Spark's expressions do slowly or not at all.

A batch's strings are taken as one flat array of bytes with offsets, so reads of any lengths mix without padding.
Rows that are null or invalid give nulls; they may hold anything.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa

#: Cells that a padded comparison of mates holds at once.
CELLS = 1 << 24


@dataclasses.dataclass
class Flat:
    """Bytes of all rows; row i is data[at[i]:at[i + 1]]."""

    data: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Flat:
        column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        if not len(at):
            at = np.zeros(1, np.int64)
        flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        return cls(flat[at[0] : at[-1]], at - at[0])

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.at)

    def row_of_byte(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.size)


def quality_sums(qual: Flat, offset: np.ndarray, left: np.ndarray | None = None, right: np.ndarray | None = None) -> np.ndarray:
    """Sum of the qualities of each row, or of its window."""
    total = np.append(0, np.cumsum(qual.data, dtype=np.int64))
    a = qual.at[:-1] + (0 if left is None else np.clip(left, 0, qual.size))
    b = qual.at[:-1] + (qual.size if right is None else np.clip(right, 0, qual.size))
    b = np.maximum(a, b)
    return total[b] - total[a] - (b - a) * offset


def sliding(qual: Flat, offset: np.ndarray, window: int, threshold: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest stretch under no failing window; of equal ones that with the higher sum, then the leftmost.

    Windows begin at every step-th place, and one ends at the read's end. Reads shorter than a window stay whole.
    """
    n, size = len(qual.at) - 1, qual.size
    total = np.append(0, np.cumsum(qual.data, dtype=np.int64))
    long = np.flatnonzero(size >= window)
    room = size[long] - window
    per = room // step + 1
    row = np.repeat(long, per)
    begin = qual.at[row] + (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * step
    extra = long[room % step != 0]
    row, begin = np.append(row, extra), np.append(begin, qual.at[extra] + size[extra] - window)
    failing = total[begin + window] - total[begin] < (threshold + offset[row]) * window
    begin = begin[failing]
    cover = np.bincount(begin, minlength=len(qual.data) + 1) - np.bincount(begin + window, minlength=len(qual.data) + 1)
    good = np.cumsum(cover)[: len(qual.data)] == 0
    edge = np.zeros(len(qual.data) + 1, bool)
    edge[qual.at[:-1]] = True
    opens = np.flatnonzero(good & (edge[:-1] | np.append(True, ~good[:-1])[: len(good)]))
    closes = np.flatnonzero(good & (np.append(edge[1:-1], True)[: len(good)] | np.append(~good[1:], True)[: len(good)])) + 1
    owner = np.searchsorted(qual.at, opens, "right") - 1
    order = np.lexsort((opens, -(total[closes] - total[opens]), -(closes - opens), owner))
    first = order[np.append(True, owner[order][1:] != owner[order][:-1])] if len(order) else order
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left[owner[first]] = opens[first] - qual.at[owner[first]]
    right[owner[first]] = closes[first] - qual.at[owner[first]]
    short = size < window
    left[short], right[short] = 0, size[short]
    return left, right


def adapter_start(seq: Flat, adapter: bytes, seed: int, mismatches: int) -> np.ndarray:
    """First place where the adapter, or its beginning at the read's end, fits; -1 if none.

    At least min(seed, adapter) letters overlap, with at most floor(overlap * mismatches / adapter) different ones.
    """
    n, a, least = len(seq.at) - 1, len(adapter), min(seed, len(adapter))
    out = np.full(n, -1, np.int64)
    total = len(seq.data)
    padded = np.append(seq.data, np.zeros(a, np.uint8))
    # At least ``least`` letters overlap wherever a hit may begin, so these are compared in passes over all bytes.
    head = min(least, 24)
    wrong8 = np.zeros(total, np.uint8)
    for j in range(head):
        wrong8 += padded[j : j + total] != adapter[j]
    live = np.flatnonzero(wrong8 <= min(mismatches, 255))
    owner = np.searchsorted(seq.at, live, "right") - 1
    overlap = np.minimum(a, seq.at[owner + 1] - live)
    budget = overlap * mismatches // a
    wrong = wrong8[live].astype(np.int64)
    keep = (overlap >= least) & (wrong <= budget)
    for j in range(head, a + 1):
        if not keep.all():
            live, owner, overlap, budget, wrong = (x[keep] for x in (live, owner, overlap, budget, wrong))
        if j == a or not len(live):
            break
        wrong += (padded[live + j] != adapter[j]) & (j < overlap)
        keep = wrong <= budget if j % 4 == 3 or j == a - 1 else np.ones(len(live), bool)
    first = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
    out[owner[first]] = live[first] - seq.at[owner[first]]
    return out


def adapters(seq: Flat, wanted: list[str], seed: int, mismatches: int) -> tuple[np.ndarray, np.ndarray]:
    """Right end and the index of the adapter that sets it (-1: none); of equal places the adapter listed first."""
    right, hit = seq.size.copy(), np.full(len(seq.at) - 1, -1, np.int64)
    for k, adapter in enumerate(wanted):
        at = adapter_start(seq, adapter.encode(), seed, mismatches)
        better = (at >= 0) & (at < right)
        right[better], hit[better] = at[better], k
    return right, hit


def kmer_counts(seq: Flat, k: int) -> np.ndarray:
    """Distinct k-mers of each row (letters A, C, G, T and N)."""
    n, total = len(seq.at) - 1, len(seq.data)
    letters = np.zeros(256, np.int64)
    for code, letter in enumerate(b"CGTN", 1):
        letters[letter] = code
    whole = max(total - k + 1, 0)
    codes, value = letters[seq.data], np.zeros(whole, np.int64)
    for j in range(k):
        value = value * 5 + codes[j : j + whole]
    # A k-mer begins wherever its last letter is in the same row.
    row = seq.row_of_byte()
    begins = np.flatnonzero(row[:whole] == row[k - 1 : k - 1 + whole]) if whole else np.zeros(0, np.int64)
    row, value = row[begins], value[begins]
    if n * 5**k <= CELLS:
        seen = np.zeros((n, 5**k), bool)
        seen[row, value] = True
        return seen.sum(axis=1)
    out = np.zeros(n, np.int64)
    # Rows in parts whose (row, value) fit one number.
    per = max(1, (1 << 62) // 5**k)
    for a in range(0, n, per):
        part = slice(*np.searchsorted(row, (a, a + per)))
        keys = np.sort((row[part] - a) * 5**k + value[part])
        new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        out += np.bincount(keys[new] // 5**k + a, minlength=n)
    return out


_COMPLEMENT = np.zeros(256, np.uint8)
for _a, _b in zip(b"ACGT", b"TGCA", strict=True):
    _COMPLEMENT[_a] = _b


def overlap(one: Flat, two: Flat, mismatches: int, least: int, portion: int) -> np.ndarray:
    """Largest insert size at which read 1's beginning fits the end of read 2's reverse complement; -1 if none.

    Sizes go from ``least`` to the shorter read, below the longer. N fits nothing. At most ``mismatches`` letters, and
    ``portion`` percent of the size, may differ.
    """
    out = np.full(len(one.at) - 1, -1, np.int64)
    l1, l2 = one.size, two.size
    top = np.minimum(np.minimum(l1, l2), np.maximum(l1, l2) - 1)
    todo = np.flatnonzero(top >= least)
    width = int(max(l1.max(initial=0), l2.max(initial=0), 1))
    for part in np.array_split(todo, max(1, -(-len(todo) * width // CELLS))):
        if not len(part):
            continue
        a = np.zeros((len(part), width), np.uint8)
        b = np.full((len(part), width), 1, np.uint8)  # the reverse complement, aligned at the right
        for flat, matrix in ((one, a), (two, b)):
            size = flat.size[part]
            row = np.repeat(np.arange(len(part)), size)
            col = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            data = flat.data[np.repeat(flat.at[part], size) + col]
            if flat is one:
                matrix[row, col] = np.where(data == ord("N"), 0, data)
            else:
                matrix[row, width - 1 - col] = np.where(data == ord("N"), 1, _COMPLEMENT[data])
        open_, most = np.arange(len(part)), top[part]
        for size in range(int(most.max()), max(least, 1) - 1, -1):
            now = open_[most[open_] >= size]
            if not len(now):
                continue
            head = min(size, 2 * mismatches + 8)
            near = (a[now, :head] != b[now, width - size : width - size + head]).sum(axis=1) <= mismatches
            now = now[near]
            wrong = (a[now, :size] != b[now, width - size :]).sum(axis=1)
            fits = now[(wrong <= mismatches) & (100 * wrong <= size * portion)]
            if len(fits):
                out[part[fits]] = size
                open_ = np.setdiff1d(open_, fits, assume_unique=True)
    return out
