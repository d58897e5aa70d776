"""Best-fit packing of token sequences.

Bounded-space online best-fit: a packer keeps a fixed number of open bins. Which free spaces occur among them is kept in
one bitset, so the tightest bin that fits is found by a shift and the lowest set bit. When no bin fits and all are open,
the fullest one closes. Only documents longer than a sequence are cut, into full pieces and a last one.

Only the pieces' sizes move: they are dealt by a hash of their document into packers of at most ``per_packer`` pieces on
average. A packer takes them in runs, dealt by a hash, of twice as many pieces on average as bins can be open, and each run
largest first: bins of a run's large pieces are then still open when its small ones come. (Were all of a full packer's pieces
taken largest first, most bins would close before any piece that fills them.) Full pieces are sequences of their own.

Null texts are empty; an empty text is one piece with the end id alone. Repeated rows are packed each for itself.
A null id is packed like any other. Extra columns stay out.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import memo, model
from .common import map_batches, materialize, strings

SIZE, END_ID, OPEN_BINS, PER_PACKER = 4096, 1, 1024, 100_000
#: Words whose ids a worker keeps.
WORDS_KEPT = 600_000


class BestFit:
    """Open bins by free space. add() gives the bin and the place there of a piece."""

    def __init__(self, size: int, open_bins: int, first: int = 0):
        self.size, self.most, self.next = size, open_bins, first
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]
        self.spaces = 0  # bit s: a bin with s free exists
        self.count = 0

    def add(self, n: int) -> tuple[int, int]:
        fitting = self.spaces >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.count == self.most:
                self._take((self.spaces & -self.spaces).bit_length() - 1)  # the fullest closes
            space, bin_ = self.size, self.next
            self.next += 1
        left = space - n
        if left:
            self.bins[left].append(bin_)
            self.spaces |= 1 << left
            self.count += 1
        return bin_, self.size - space

    def _take(self, space: int) -> int:
        bin_ = self.bins[space].pop()
        if not self.bins[space]:
            self.spaces &= ~(1 << space)
        self.count -= 1
        return bin_


def pieces(df: DataFrame, path: str, size: int = SIZE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids, then END_ID, cut after every ``size`` ids."""

    def make():
        bpe, end = model(path), struct.pack("<I", END_ID)
        library = Tokenizer.from_file(path).model  # the library's own model gives a word's ids

        def entry(piece):
            ids = [piece] if isinstance(piece, int) else [t.id for t in library.tokenize(bpe.mapped(piece))]
            return struct.pack(f"<{len(ids)}I", *ids)

        words = memo("bytes", path, entry, WORDS_KEPT)

        def f(batch):
            doc, piece, start, length, crc = [], [], [], [], []
            for i, x in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                ids = memoryview(b"".join([*map(words.__getitem__, bpe.pieces(x)), end]))
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    doc.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((doc, piece, start, length, crc), types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

        return f

    return map_batches(df.select(F.col(id_col).cast("long"), text), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(found: DataFrame, size: int = SIZE, open_bins: int = OPEN_BINS, per_packer: int = PER_PACKER) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (1 to ``size``).

    ``found`` should be a written table: its rows are counted once to choose the number of packers.
    """
    n = found.count()
    packers = max(1, round(n / per_packer))
    runs = max(1, round(n / packers / (2 * open_bins)))
    key = F.coalesce(F.xxhash64("doc_id"), F.lit(0))
    # Largest first within a run; ids are (packer, bin), so packers don't meet.
    run_of = F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(runs))
    dealt = found.repartition(packers, key).sortWithinPartitions(run_of, F.desc("length"), "doc_id", "piece")

    def run(batches):
        from pyspark import TaskContext

        bins, base = BestFit(size, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.add(n) for n in batch.column("length").to_pylist()]
            ids = np.array([p[0] for p in placed], np.int64) + base
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids), pa.array([p[1] for p in placed], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields), "sequence_id long, `offset` long"])
    return dealt.mapInArrow(run, schema)


def op2(df: DataFrame, path: str) -> DataFrame:
    return pack(materialize(pieces(df, path)))
