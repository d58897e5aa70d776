"""Mates in one row: alignment by position, overlap, reconciliation of what survives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators import trims
from readloom.operators.reads import evaluated, merged, trimmed
from readloom.plans.config import TrimConfig

READ = ("header", "seq", "plus", "qual", "offset")
#: Columns that a processed mate has beside its modules'.
DONE = (*READ, "valid", "l", "r", "keep", "out_seq", "out_qual")


def aligned(reads: DataFrame) -> DataFrame:
    """One row a pair (input_id, ordinal, a_..., b_...) from rows with mate 1 and 2. A mate without partner raises an error."""
    side = {p: reads.where(F.col("mate") == m).select("input_id", "ordinal", *(F.col(c).alias(p + c) for c in READ), F.lit(True).alias(p + "here")) for p, m in (("a_", 1), ("b_", 2))}
    pairs = side["a_"].join(side["b_"], ["input_id", "ordinal"], "full")
    lonely = F.raise_error(F.concat(F.lit("mates don't match in input "), F.col("input_id").cast("string"), F.lit(" at "), F.col("ordinal").cast("string")))
    checked = F.when(F.col("a_here") & F.col("b_here"), F.col("ordinal")).otherwise(lonely.cast("long"))
    return pairs.withColumn("ordinal", checked).drop("a_here", "b_here")


def interleaved(reads: DataFrame) -> DataFrame:
    """Records of an interleaved file as mates: even places are read 1, odd ones read 2; ordinal counts pairs."""
    return reads.withColumn("mate", (F.col("ordinal") % 2 + 1).cast("int")).withColumn("ordinal", F.floor(F.col("ordinal") / 2).cast("long"))


def processed(pairs: DataFrame, cfg: TrimConfig, sums: bool = False) -> DataFrame:
    """Both mates' plans and the pair's route: paired, single_r1, single_r2 or rejected."""
    df = evaluated(evaluated(pairs, cfg, 1, "a_", sums), cfg, 2, "b_", sums)
    if cfg.overlap:
        both = F.col("a_valid") & F.col("b_valid")
        df = df.withColumn("insert", trims.overlap_size(cfg)(F.col("a_seq"), F.col("b_seq"), both))
        # Both mates end where the insert does; without one they have no say.
        df = df.withColumns({p + "w_overlap": F.when(F.col(p + "valid"), trims.window(F.lit(0), F.coalesce(F.col("insert"), F.length(p + "seq")))) for p in ("a_", "b_")})
    for p, mate in (("a_", 1), ("b_", 2)):
        df = trimmed(merged(df, cfg, mate, p, sums), cfg, p)
    a, b = F.col("a_keep"), F.col("b_keep")
    return df.withColumn("route", F.when(a & b, "paired").when(a, "single_r1").when(b, "single_r2").otherwise("rejected"))


def as_reads(df: DataFrame, cfg: TrimConfig, sums: bool = False) -> DataFrame:
    """One row a mate again, with its own route: paired, single_r1, single_r2, rejected_invalid, rejected_filtered."""
    own = [*DONE, *(f"w_{m}" for m in cfg.modules(1)), *(["hit"] if cfg.adapter else []), *(["qsum_in", "qsum_out"] if sums else [])]

    def mate(p: str, k: int):
        route = F.when(F.col(p + "keep"), F.col("route")).when(F.col(p + "valid"), "rejected_filtered").otherwise("rejected_invalid")
        return F.struct(F.lit(k).alias("mate"), *(F.col(p + c).alias(c) for c in own), route.alias("route"))

    return df.select("input_id", "ordinal", F.explode(F.array(mate("a_", 1), mate("b_", 2))).alias("x")).select("input_id", "ordinal", "x.*")
