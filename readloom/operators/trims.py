"""Window operators: each looks at the raw read and returns [l, r).

What Spark's expressions do well stays in them; the rest of a read's modules share one Arrow function, so a batch crosses
to Python once. ``NATIVE`` and ``KERNEL`` are the registries: a new module is one entry in either.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions import kernels
from readloom.functions.sequences import below
from readloom.plans.config import TrimConfig


def window(left: Column, right: Column) -> Column:
    return F.struct(left.cast("int").alias("l"), right.cast("int").alias("r"))


def cut_ends(cfg: TrimConfig, seq: Column, qual: Column, offset: Column) -> Column:
    """Fixed numbers of letters off both ends; empty where they meet."""
    start, end = cfg.of_end("cut", "start") or 0, cfg.of_end("cut", "end") or 0
    n = F.length(seq)
    return window(F.least(F.lit(max(start, 0)), n), F.greatest(n - max(end, 0), F.lit(0)))


def end_quality(cfg: TrimConfig, seq: Column, qual: Column, offset: Column) -> Column:
    """From the first letter that reaches the start's threshold to the last that reaches the end's; none: (length, 0)."""
    first, last = cfg.of_end("endqual_min", "start"), cfg.of_end("endqual_min", "end")

    def run(text: Column, threshold: int) -> Column:
        return F.when(offset == 64, below(text, 64, threshold)).otherwise(below(text, 33, threshold))

    return window(run(qual, first), F.length(qual) - run(F.reverse(qual), last))


def homopolymer(cfg: TrimConfig, seq: Column, qual: Column, offset: Column) -> Column:
    """The longest run of one of the bases at each end, if it is long enough."""

    def run(text: Column, end: str) -> Column:
        least = cfg.of_end("poly_length", end) or 0
        bases = [b.strip().upper() for b in (cfg.of_end("poly_bases", end) or "").split(",") if b.strip()]
        if least <= 0 or not bases:
            return F.lit(0)
        runs = [F.length(F.regexp_extract(text, rf"\A{b}+", 0)) for b in bases]
        longest = F.greatest(*runs) if len(runs) > 1 else runs[0]
        return F.when(longest >= least, longest).otherwise(0)

    return window(run(seq, "start"), F.length(seq) - run(F.reverse(seq), "end"))


NATIVE: dict[str, Callable[[TrimConfig, Column, Column, Column], Column]] = {"cut": cut_ends, "endqual": end_quality, "poly": homopolymer}


def _slider(cfg, seq, qual, offset, wanted):
    return *kernels.sliding(qual, offset, cfg.slider_window, cfg.slider_quality, cfg.slider_step), None


def _adapter(cfg, seq, qual, offset, wanted):
    right, hit = kernels.adapters(seq, wanted, cfg.adapter_seed, cfg.adapter_mismatch)
    return np.zeros_like(right), right, hit


def _kmer(cfg, seq, qual, offset, wanted):
    """All of a read, or nothing if for some k too few of its k-mers differ. Reads shorter than k have none."""
    letters, ok = 4 if cfg.n_filter else 5, np.ones(len(offset), bool)
    for k in cfg.kmer_sizes:
        most = np.minimum(np.maximum(seq.size - k + 1, 0), letters**k)
        ok &= np.where(most > 0, 100 * kernels.kmer_counts(seq, k) >= cfg.kmer_cutoff * most, cfg.kmer_cutoff <= 0)
    return np.zeros(len(ok), np.int64), np.where(ok, seq.size, 0), None


def _avgqual_pre(cfg, seq, qual, offset, wanted):
    ok = np.where(qual.size > 0, kernels.quality_sums(qual, offset) >= cfg.min_average_qual_pre * qual.size, cfg.min_average_qual_pre <= 0)
    return np.zeros(len(ok), np.int64), np.where(ok, qual.size, 0), None


KERNEL: dict[str, Callable] = {"kmer": _kmer, "adapter": _adapter, "avgqual_pre": _avgqual_pre, "slider": _slider}


def _once(udf):
    """Keeps Catalyst from copying the function into a filter on its result, which would run it twice on every batch.

    The price: filters on other columns stay above it as well, so apply those to the reads beforehand.
    """
    return udf.asNondeterministic()


def kernel_windows(cfg: TrimConfig, modules: list[str], wanted: list[str], sums: bool = False) -> Callable[..., Column]:
    """An Arrow function (seq, qual, offset, valid) -> struct with <module>_l, <module>_r, and hit and qsum where asked for."""
    modules = [m for m in modules if m in KERNEL]
    names = [f"{m}_{x}" for m in modules for x in "lr"] + ["hit"] * ("adapter" in modules) + ["qsum"] * sums

    def run(seq: pa.Array, qual: pa.Array, offset: pa.Array, valid: pa.Array) -> pa.Array:
        good = valid.fill_null(False)
        null = pa.scalar(None, pa.string())
        import pyarrow.compute as pc

        s, q = (kernels.Flat.of(pc.if_else(good, x, null)) for x in (seq, qual))
        base = offset.fill_null(33).to_numpy(zero_copy_only=False).astype(np.int64)
        bad = ~good.to_numpy(zero_copy_only=False)
        columns, hit = [], None
        for m in modules:
            left, right, own = KERNEL[m](cfg, s, q, base, wanted)
            hit = own if own is not None else hit
            columns += [pa.array(left.astype(np.int32), mask=bad), pa.array(right.astype(np.int32), mask=bad)]
        if hit is not None:
            columns.append(pa.array(hit.astype(np.int32), mask=bad))
        if sums:
            columns.append(pa.array(kernels.quality_sums(q, base), mask=bad))
        return pa.StructArray.from_arrays(columns, names=names)

    return _once(F.arrow_udf(run, ", ".join(f"{n} {'long' if n == 'qsum' else 'int'}" for n in names)))


def window_sums() -> Callable[..., Column]:
    """An Arrow function (qual, offset, l, r, valid) -> the sum of the window's qualities; null where not valid."""

    def run(qual: pa.Array, offset: pa.Array, left: pa.Array, right: pa.Array, valid: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        good = valid.fill_null(False)
        q = kernels.Flat.of(pc.if_else(good, qual, pa.scalar(None, pa.string())))
        base, a, b = (x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (offset, left, right))
        return pa.array(kernels.quality_sums(q, base, a, b), mask=~good.to_numpy(zero_copy_only=False))

    return _once(F.arrow_udf(run, "long"))


def overlap_size(cfg: TrimConfig) -> Callable[..., Column]:
    """An Arrow function (seq 1, seq 2, both valid) -> insert size, or null if none is accepted."""

    def run(one: pa.Array, two: pa.Array, both: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        good = both.fill_null(False)
        a, b = (kernels.Flat.of(pc.if_else(good, x, pa.scalar(None, pa.string()))) for x in (one, two))
        size = kernels.overlap(a, b, cfg.overlap_mismatches, cfg.overlap_min_length, cfg.overlap_portion_mismatch)
        return pa.array(size.astype(np.int32), mask=(size < 0) | ~good.to_numpy(zero_copy_only=False))

    return _once(F.arrow_udf(run, "int"))
