"""Whole-read predicates, as Spark expressions over header, seq, plus and qual."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.plans.config import TrimConfig


def well_formed(header: Column, seq: Column, plus: Column, qual: Column) -> Column:
    """A FASTQ record: '@' and more, '+', equal lengths, letters A, C, G, T, N only, printable qualities. Empty reads pass."""
    return F.coalesce(
        (F.length(header) > 1) & F.startswith(header, F.lit("@")) & F.startswith(plus, F.lit("+")) & (F.length(seq) == F.length(qual))
        & (F.translate(seq, "ACGTN", "") == "") & F.rlike(qual, F.lit(r"\A[!-~]*\z")), F.lit(False),
    )


def valid(cfg: TrimConfig, header: Column, seq: Column, plus: Column, qual: Column) -> Column:
    """Well formed, and within the input's bounds; reads with N count as invalid under the N filter."""
    out = well_formed(header, seq, plus, qual)
    if cfg.n_filter:
        out = out & ~F.contains(seq, F.lit("N"))
    if cfg.min_length_input is not None:
        out = out & (F.length(seq) >= cfg.min_length_input)
    if cfg.max_length_input is not None:
        out = out & (F.length(seq) <= cfg.max_length_input)
    return out


def output_length(cfg: TrimConfig, length: Column, raw: Column) -> Column:
    """Not empty, and within the output's bounds; for each bound the absolute option wins over the percentage."""
    out = length > 0
    for side, name in ((lambda a, b: a >= b, "min"), (lambda a, b: a <= b, "max")):
        absolute, share = getattr(cfg, f"{name}_length_output"), getattr(cfg, f"{name}_length_output_perc")
        if absolute is not None:
            out = out & side(length, F.lit(absolute))
        elif share is not None:
            out = out & side(length, F.floor(raw * share / 100))
    return out


def mean_at_least(total: Column, length: Column, threshold: int) -> Column:
    """Mean quality of at least the threshold, in whole numbers; an empty read's mean is 0."""
    return F.when(length > 0, total >= threshold * length).otherwise(F.lit(threshold <= 0))
