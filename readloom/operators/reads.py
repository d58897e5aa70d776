"""The per-read plan: validate, evaluate modules, merge their windows, decide what is kept.

A mate's columns may carry a prefix, so both mates of a pair can stand in one row. Added columns: valid, offset, w_<module>
(struct l, r), hit, l, r, keep, qsum_in, qsum_out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import adapters
from readloom.functions.sequences import cut_out, mgi_header, phred_convert
from readloom.operators import filters, trims
from readloom.plans.config import TrimConfig


def searched(cfg: TrimConfig, mate: int) -> list[str]:
    """Adapters searched for in a mate."""
    if not cfg.adapter:
        return []
    if cfg.adapter_read_1 or cfg.adapter_read_2:
        return adapters.for_mate([], mate, None, cfg.adapter_read_1, cfg.adapter_read_2)
    entries = adapters.resolve(list(cfg.adapter_group), cfg.adapter_add, cfg.adapter_excl)
    return adapters.for_mate(entries, mate, None if cfg.adapter_excl else list(cfg.adapter_group))


def evaluated(df: DataFrame, cfg: TrimConfig, mate: int, p: str = "", sums: bool = False) -> DataFrame:
    """Adds valid, converted headers, and each module's window (null for invalid reads)."""
    c = {x: F.col(p + x) for x in ("header", "seq", "plus", "qual", "offset")}
    df = df.withColumn(p + "valid", filters.valid(cfg, c["header"], c["seq"], c["plus"], c["qual"]))
    ok = F.col(p + "valid")
    if cfg.mgi_convert:
        made = mgi_header(c["header"], cfg.mgi_bc5, cfg.mgi_bc7, cfg.mgi_instrument, cfg.mgi_run, ok)
        df = df.withColumns({p + "header": F.when(ok, made).otherwise(c["header"]), p + "plus": F.when(ok, "+").otherwise(c["plus"])})
    modules = cfg.modules(mate)
    added: dict[str, Column] = {p + f"w_{m}": F.when(ok, trims.NATIVE[m](cfg, c["seq"], c["qual"], c["offset"])) for m in modules if m in trims.NATIVE}
    kernel = [m for m in modules if m in trims.KERNEL]
    if kernel or sums:
        df = df.withColumn(p + "kernel", trims.kernel_windows(cfg, kernel, searched(cfg, mate), sums)(c["seq"], c["qual"], c["offset"], ok))
        k = F.col(p + "kernel")
        added |= {p + f"w_{m}": F.when(ok, F.struct(k[f"{m}_l"].alias("l"), k[f"{m}_r"].alias("r"))) for m in kernel}
        if "adapter" in kernel:
            added[p + "hit"] = k["hit"]
        if sums:
            added[p + "qsum_in"] = k["qsum"]
    return df.withColumns(added).drop(p + "kernel")


def merged(df: DataFrame, cfg: TrimConfig, mate: int, p: str = "", sums: bool = False) -> DataFrame:
    """Adds l, r (the strictest of all windows; null ones have no say) and keep."""
    n, ok = F.length(p + "seq"), F.col(p + "valid")
    windows = [F.col(p + f"w_{m}") for m in cfg.modules(mate)]
    df = df.withColumns({
        p + "l": F.when(ok, F.greatest(F.lit(0), F.lit(0), *(w["l"] for w in windows))),
        p + "r": F.when(ok, F.least(n, n, *(w["r"] for w in windows))),
    })
    left, right = F.col(p + "l"), F.col(p + "r")
    keep = ok & filters.output_length(cfg, right - left, n)
    if cfg.min_average_qual_post > 0 or sums:
        df = df.withColumn(p + "qsum_out", trims.window_sums()(F.col(p + "qual"), F.col(p + "offset"), left, right, ok))
        if cfg.min_average_qual_post > 0:
            keep = keep & filters.mean_at_least(F.col(p + "qsum_out"), right - left, cfg.min_average_qual_post)
    return df.withColumn(p + "keep", F.coalesce(keep, F.lit(False)))


def trimmed(df: DataFrame, cfg: TrimConfig, p: str = "") -> DataFrame:
    """Adds out_seq and out_qual: the window, in the encoding asked for; whole and untouched for what is not kept."""
    keep, seq, qual = F.col(p + "keep"), F.col(p + "seq"), F.col(p + "qual")
    left, right = F.col(p + "l"), F.col(p + "r")
    own = cut_out(qual, left, right)
    if cfg.phred_out:
        own = phred_convert(own, F.col(p + "offset"), cfg.phred_out)
    return df.withColumns({p + "out_seq": F.when(keep, cut_out(seq, left, right)).otherwise(seq), p + "out_qual": F.when(keep, own).otherwise(qual)})


def single(df: DataFrame, cfg: TrimConfig, mate: int = 0, sums: bool = False) -> DataFrame:
    """The whole plan for reads without mates. ``route``: unpaired, rejected_invalid or rejected_filtered."""
    df = merged(evaluated(df, cfg, mate, sums=sums), cfg, mate, sums=sums)
    route = F.when(F.col("keep"), "unpaired").when(F.col("valid"), "rejected_filtered").otherwise("rejected_invalid")
    return trimmed(df, cfg).withColumn("route", route)
