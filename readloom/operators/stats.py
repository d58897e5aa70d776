"""Statistics of processed reads: totals, histograms, medians, counters of modules and adapters, and the summary grid.

All take rows with one read each: input_id, mate, seq, valid, keep, l, r, w_<module>, and hit, qsum_in, qsum_out where used.
Every number is an aggregate that Spark adds up partially before it shuffles; keys are inputs and mates, so results are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.reads import searched
from readloom.plans.config import TrimConfig

KEYS = ("input_id", "mate")
#: The grid's columns in their order, and those of each module.
BASE = (
    "input", "type", "mate", "input_files", "output_files", "reads_pre", "invalid_reads", "rejected_after_trimming", "reads_lost", "reads_post",
    "reads_kept_percent", "kept_in_pairs", "kept_as_singletons", "bases_pre", "bases_post", "bases_kept_percent", "mean_length_pre", "mean_length_post",
    "median_length_pre", "median_length_post", "mean_base_qual_pre", "mean_base_qual_post", "mean_read_qual_pre", "mean_read_qual_post",
    "median_read_qual_pre", "median_read_qual_post",
)
MODULE_COLUMNS = ("reads_trimmed", "reads_trimmed_percent", "bases_trimmed", "bases_trimmed_percent", "decisive_reads")


def _n() -> Column:
    return F.length("seq").cast("long")


def _out() -> Column:
    return (F.col("r") - F.col("l")).cast("long")


def totals(df: DataFrame) -> DataFrame:
    """Counts and sums of valid reads as read, and of kept reads within their windows."""
    ok, keep = F.col("valid"), F.col("keep")
    return df.groupBy(*KEYS).agg(
        F.count_if(~ok).alias("invalid"), F.count_if(ok).alias("reads_in"), F.count_if(keep).alias("reads_out"), F.count_if(ok & ~keep).alias("rejected_after_trim"),
        F.coalesce(F.sum(F.when(ok, _n())), F.lit(0)).alias("bases_in"), F.coalesce(F.sum(F.when(keep, _out())), F.lit(0)).alias("bases_out"),
        F.coalesce(F.sum(F.when(ok, F.col("qsum_in"))), F.lit(0)).alias("qual_sum_in"), F.coalesce(F.sum(F.when(keep, F.col("qsum_out"))), F.lit(0)).alias("qual_sum_out"),
        F.coalesce(F.sum(F.when(ok, F.col("qsum_in") / F.greatest(_n(), F.lit(1)))), F.lit(0.0)).alias("read_qual_sum_in"),
        F.coalesce(F.sum(F.when(keep, F.col("qsum_out") / _out())), F.lit(0.0)).alias("read_qual_sum_out"),
    )


def quality_bin(total: Column, length: Column) -> Column:
    """Tenths of the mean quality."""
    return F.floor(total / F.greatest(length, F.lit(1)) * 10 + 1e-9).cast("long")


def histograms(df: DataFrame) -> DataFrame:
    """kind (len_in, len_out, rq_in, rq_out), bin, n for every input and mate."""
    ok, keep = F.col("valid"), F.col("keep")
    kinds = F.array(
        F.struct(F.lit("len_in").alias("kind"), F.when(ok, _n()).alias("bin")), F.struct(F.lit("len_out").alias("kind"), F.when(keep, _out()).alias("bin")),
        F.struct(F.lit("rq_in").alias("kind"), F.when(ok, quality_bin(F.col("qsum_in"), _n())).alias("bin")),
        F.struct(F.lit("rq_out").alias("kind"), F.when(keep, quality_bin(F.col("qsum_out"), _out())).alias("bin")),
    )
    return df.select(*KEYS, F.explode(kinds).alias("x")).select(*KEYS, "x.*").where("bin IS NOT NULL").groupBy(*KEYS, "kind", "bin").agg(F.count("*").alias("n"))


def medians(histogram: DataFrame) -> DataFrame:
    """The upper median of each histogram: the first bin at which half of n + 1 is reached."""
    by = Window.partitionBy(*KEYS, "kind")
    run = F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return histogram.withColumns({"c": run, "t": F.sum("n").over(by)}).where(2 * F.col("c") >= F.col("t") + 1).groupBy(*KEYS, "kind").agg(F.min("bin").alias("median"))


def module_counters(df: DataFrame, modules: list[str]) -> DataFrame:
    """module, reads, bases, decisive_reads: what each module would cut by itself, and how often it sets the final cut."""
    if not modules:
        return df.sparkSession.createDataFrame([], "input_id long, mate int, module string, reads long, bases long, decisive_reads long")
    n = F.length("seq")

    def clip(c: Column) -> Column:
        return F.least(F.greatest(c, F.lit(0)), n)

    fl, fr = clip(F.col("l")), clip(F.col("r"))

    def one(m: str) -> Column:
        left, right = clip(F.col(f"w_{m}.l")), clip(F.col(f"w_{m}.r"))
        bases = F.least(left + (n - right), n)
        sets = ((left > 0) & (left == fl)) | ((right < n) & (right == fr))
        return F.struct(F.lit(m).alias("module"), bases.cast("long").alias("b"), sets.alias("sets"))

    rows = df.where("valid").select(*KEYS, F.explode(F.array(*map(one, modules))).alias("x")).select(*KEYS, "x.*")
    return rows.groupBy(*KEYS, "module").agg(F.count_if(F.col("b") > 0).alias("reads"), F.sum("b").alias("bases"), F.count_if(F.col("sets") & (F.col("b") > 0)).alias("decisive_reads"))


def adapter_hits(df: DataFrame, cfg: TrimConfig) -> DataFrame:
    """adapter, reads: how often each adapter searched for set the cut; 0 where it never did."""
    wanted = {m: searched(cfg, m) for m in (0, 1, 2)}
    names = F.create_map(*(x for m, w in wanted.items() for x in (F.lit(m), F.array(*map(F.lit, w)).cast("array<string>"))))
    hits = df.where("valid").select(*KEYS, F.posexplode(names[F.col("mate")]).alias("k", "adapter"), "hit")
    return hits.groupBy(*KEYS, "adapter").agg(F.count_if(F.col("hit") == F.col("k")).alias("reads"))


def kept_counts(pairs: DataFrame) -> DataFrame:
    """Per input: pairs kept, singletons and rejected mates (from rows with one pair each)."""
    a, b = F.col("a_keep"), F.col("b_keep")
    return pairs.groupBy("input_id").agg(
        F.count_if(a & b).alias("kept_pairs"), F.count_if(a & ~b).alias("kept_r1_singletons"), F.count_if(b & ~a).alias("kept_r2_singletons"),
        F.count_if(~a).alias("rejected_r1"), F.count_if(~b).alias("rejected_r2"),
    )


def summary_grid(df: DataFrame, cfg: TrimConfig, modules: list[str]) -> DataFrame:
    """One row an input and mate: totals, ratios (unrounded; null where the divisor is 0), medians, modules and adapters."""

    def ratio(a: Column | str, b: str, times: int = 1) -> Column:
        top = F.col(a) if isinstance(a, str) else a
        return F.when(F.col(b) != 0, times * top / F.col(b))

    paired = df.groupBy(*KEYS).agg(F.count_if(F.col("route") == "paired").alias("kept_in_pairs"), F.count_if(F.col("route").isin("single_r1", "single_r2")).alias("kept_as_singletons"))
    kinds = {"len_in": "median_length_pre", "len_out": "median_length_post", "rq_in": "median_read_qual_pre", "rq_out": "median_read_qual_post"}
    middle = medians(histograms(df)).groupBy(*KEYS).pivot("kind", list(kinds)).agg(F.first("median"))
    out = totals(df).join(paired, [*KEYS]).join(middle, [*KEYS], "left").select(
        *KEYS, (F.col("invalid") + F.col("reads_in")).alias("reads_pre"), F.col("invalid").alias("invalid_reads"), F.col("rejected_after_trim").alias("rejected_after_trimming"),
        (F.col("invalid") + F.col("rejected_after_trim")).alias("reads_lost"), F.col("reads_out").alias("reads_post"), "kept_in_pairs", "kept_as_singletons",
        F.col("bases_in").alias("bases_pre"), F.col("bases_out").alias("bases_post"),
        (100 * F.col("reads_out") / (F.col("invalid") + F.col("reads_in"))).alias("reads_kept_percent"), ratio("bases_out", "bases_in", 100).alias("bases_kept_percent"),
        ratio("bases_in", "reads_in").alias("mean_length_pre"), ratio("bases_out", "reads_out").alias("mean_length_post"),
        *(F.col(a).alias(b) if a.startswith("len") else (F.col(a) / 10).alias(b) for a, b in kinds.items()),
        ratio("qual_sum_in", "bases_in").alias("mean_base_qual_pre"), ratio("qual_sum_out", "bases_out").alias("mean_base_qual_post"),
        ratio("read_qual_sum_in", "reads_in").alias("mean_read_qual_pre"), ratio("read_qual_sum_out", "reads_out").alias("mean_read_qual_post"), F.col("reads_in").alias("valid_reads"),
    )
    if modules:
        own = module_counters(df, modules).groupBy(*KEYS).pivot("module", modules).agg(F.first("reads").alias("reads_trimmed"), F.first("bases").alias("bases_trimmed"), F.first("decisive_reads").alias("decisive_reads"))
        out = out.join(own, [*KEYS], "left")
        for m in modules:
            out = out.withColumns({f"{m}_reads_trimmed_percent": ratio(f"{m}_reads_trimmed", "valid_reads", 100), f"{m}_bases_trimmed_percent": ratio(f"{m}_bases_trimmed", "bases_pre", 100)})
    if cfg.adapter:
        every = list(dict.fromkeys(a for m in (0, 1, 2) for a in searched(cfg, m)))
        hits = adapter_hits(df, cfg).withColumn("name", F.concat(F.lit("adapter_"), "adapter", F.lit("_reads")))
        out = out.join(hits.groupBy(*KEYS).pivot("name", [f"adapter_{a}_reads" for a in every]).agg(F.first("reads")), [*KEYS], "left")
    known = [c for c in BASE if c in out.columns and c not in KEYS] + [f"{m}_{x}" for m in modules for x in MODULE_COLUMNS]
    return out.select(*KEYS, *known, *(c for c in out.columns if c not in (*known, *KEYS, "valid_reads")))


def rendered(rows: list[dict]) -> tuple[list[str], list[list[str]]]:
    """Rows of the grid as texts: means and percentages with two digits, kept bases with four, NA for null."""
    if not rows:
        return [], []

    def text(name: str, x: object) -> str:
        if x is None:
            return "NA"
        if isinstance(x, float):
            digits = 4 if name == "bases_kept_percent" else 1 if name.startswith("median_read_qual") else 2
            return str(round(x, digits))
        return str(x)

    names = list(rows[0])
    return names, [[text(n, r[n]) for n in names] for r in rows]
