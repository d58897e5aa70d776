"""A run over files: read, process, route, write once, and sum up."""

from __future__ import annotations

import dataclasses
import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.sequences import fastq_record
from readloom.operators import pairs, stats
from readloom.operators.reads import searched, single
from readloom.plans.config import TrimConfig
from readloom.sources import discover, fastq, files


@dataclasses.dataclass
class Inputs:
    unpaired: list[str] = dataclasses.field(default_factory=list)
    paired: list[tuple[str, str]] = dataclasses.field(default_factory=list)
    interleaved: list[str] = dataclasses.field(default_factory=list)


@dataclasses.dataclass
class Item:
    """One input: its number, kind, files, the stem of its outputs, and each mate's Phred offset."""

    number: int
    kind: str
    files: tuple[str, ...]
    stem: str
    offsets: dict[int, int]

    @property
    def label(self) -> str:
        return ", ".join(map(os.path.basename, self.files))


def plan_items(inputs: Inputs, cfg: TrimConfig) -> list[Item]:
    """Numbers, names and offsets, on the driver: a few records of each file are read."""
    items: list[Item] = []
    taken = {discover.base_name(f) for f in inputs.unpaired}
    if len(taken) < len(inputs.unpaired):
        raise FileExistsError("two unpaired inputs have the same name")

    def offset(path: str) -> int:
        return fastq.phred_offset(path, cfg.reads_for_phred_offset, cfg.phred_offset)

    for f in inputs.unpaired:
        items.append(Item(len(items), "unpaired", (f,), discover.base_name(f), {0: offset(f)}))
    for f in inputs.interleaved:
        items.append(Item(len(items), "interleaved", (f,), discover.unique_prefix(discover.base_name(f), taken), dict.fromkeys((1, 2), offset(f))))
    for a, b in inputs.paired:
        items.append(Item(len(items), "paired", (a, b), discover.unique_prefix(discover.common_name(a, b), taken), {1: offset(a), 2: offset(b)}))
    return items


def _offset_column(items: list[Item]) -> Column:
    known = F.create_map(*(x for i in items for m, o in i.offsets.items() for x in (F.lit(f"{i.number}/{m}"), F.lit(o))))
    return known[F.concat_ws("/", F.col("input_id").cast("string"), F.col("mate").cast("string"))]


def load(spark: SparkSession, items: list[Item], range_bytes: int = fastq.RANGE, first: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Unpaired reads, and pairs in one row; with ``first``, those at places below it."""
    alone = [i for i in items if i.kind == "unpaired"]
    mixed = [i for i in items if i.kind == "interleaved"]
    double = [i for i in items if i.kind == "paired"]
    unpaired = couples = None
    if alone:
        unpaired = fastq.read_fastq(spark, [(i.number, 0, i.files[0]) for i in alone], range_bytes, first).withColumn("offset", _offset_column(alone))
    mates = []
    if mixed:
        mates.append(pairs.interleaved(fastq.read_fastq(spark, [(i.number, 0, i.files[0]) for i in mixed], range_bytes, None if first is None else 2 * first)))
    if double:
        mates.append(fastq.read_fastq(spark, [(i.number, m, f) for i in double for m, f in enumerate(i.files, 1)], range_bytes, first))
    if mates:
        rows = mates[0] if len(mates) == 1 else mates[0].unionByName(mates[1])
        couples = pairs.aligned(rows.withColumn("offset", _offset_column(mixed + double)))
    return unpaired, couples


def first_of(cfg: TrimConfig, threads: int) -> int | None:
    """A test run takes the first chunks of each input, by place."""
    return threads * cfg.chunk_size if cfg.testrun else None


def outputs(items: list[Item], cfg: TrimConfig) -> dict[int, list[str]]:
    """Files that each input writes."""
    end = ".fastq.gz" if cfg.gzip else ".fastq"
    found: dict[int, list[str]] = {}
    for i in items:
        if i.kind == "unpaired":
            names = [f"{i.stem}_filtered"] + [f"{i.stem}_rejected"] * cfg.write_rejected
        else:
            names = [f"{i.stem}_interleaved_filtered"] if cfg.interleaved_out else [f"{i.stem}_R1_paired_filtered", f"{i.stem}_R2_paired_filtered"]
            names += [] if cfg.discard_singles else [f"{i.stem}_R1_unpaired_filtered", f"{i.stem}_R2_unpaired_filtered"]
            if cfg.write_rejected:
                names += [f"{i.stem}_rejected"] if cfg.interleaved_out else [f"{i.stem}_R1_rejected", f"{i.stem}_R2_rejected"]
        found[i.number] = [n + end for n in names]
    return found


def _stem(items: list[Item]) -> Column:
    return F.create_map(*(x for i in items for x in (F.lit(i.number).cast("long"), F.lit(i.stem))))[F.col("input_id")]


def routed(items: list[Item], cfg: TrimConfig, reads: DataFrame | None, couples: DataFrame | None) -> DataFrame:
    """file, ordinal, record for every record that is written; each row of the inputs is looked at once."""
    end, parts = ".fastq.gz" if cfg.gzip else ".fastq", []

    def text(p: str = "") -> Column:
        return fastq_record(F.col(p + "header"), F.col(p + "out_seq"), F.col(p + "plus"), F.col(p + "out_qual"))

    def out(test: Column, name: str, record: Column) -> Column:
        return F.when(test, F.struct(F.lit(name + end).alias("name"), record.alias("record")))

    def add(df: DataFrame, places: list[Column]) -> None:
        found = df.select(_stem(items).alias("stem"), "ordinal", F.explode(F.array_compact(F.array(*places))).alias("x"))
        parts.append(found.select(F.concat("stem", "x.name").alias("file"), "ordinal", "x.record"))

    if reads is not None:
        add(reads, [out(F.col("keep"), "_filtered", text()), *([out(~F.col("keep"), "_rejected", text())] if cfg.write_rejected else [])])
    if couples is not None:
        both = F.col("route") == "paired"
        places = [out(both, "_interleaved_filtered", F.concat_ws("\n", text("a_"), text("b_")))] if cfg.interleaved_out else []
        for mate, p in ((1, "a_"), (2, "b_")):
            if not cfg.interleaved_out:
                places.append(out(both, f"_R{mate}_paired_filtered", text(p)))
            if not cfg.discard_singles:
                places.append(out(F.col("route") == f"single_r{mate}", f"_R{mate}_unpaired_filtered", text(p)))
            if cfg.write_rejected:
                places.append(out(~F.col(p + "keep"), "_rejected" if cfg.interleaved_out else f"_R{mate}_rejected", text(p)))
        add(couples, places)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def summary_text(items: list[Item], cfg: TrimConfig, alone: dict[int, tuple[int, int]], double: dict[int, dict]) -> str:
    """The plain summary: a block of tab-separated rows for pairs and one for unpaired inputs. Rows end with CR LF, titles with LF."""
    names, text = outputs(items, cfg), ""

    def rows(found: list[tuple]) -> str:
        return "".join("\t".join(map(str, r)) + "\r\n" for r in found)

    if couples := [i for i in items if i.kind != "unpaired"]:
        table = [("Input File(s)", "Output File(s)", "Kept_Pairs", "Kept_R1_Singletons", "Kept_R2_Singletons", "Rejected_R1", "Rejected_R2")]
        for i in couples:
            c = double.get(i.number, {})
            table.append((i.label, ", ".join(names[i.number]), *(c.get(k, 0) for k in ("kept_pairs", "kept_r1_singletons", "kept_r2_singletons", "rejected_r1", "rejected_r2"))))
        text += "[Paired Reads]\n" + rows(table) + "\n"
    if single_files := [i for i in items if i.kind == "unpaired"]:
        table = [("Input File", "Output File", "Kept", "Rejected")]
        table += [(i.label, names[i.number][0], *alone.get(i.number, (0, 0))) for i in single_files]
        text += "[Unpaired Reads]\n" + rows(table)
    return text


def grid_text(items: list[Item], cfg: TrimConfig, reads: DataFrame | None, couples: DataFrame | None) -> str:
    """The statistics as one tab-separated table: fixed columns, then each module's, then each adapter's."""
    names, rows = outputs(items, cfg), []
    modules, adapters = [], []
    found: dict[tuple[int, int], dict] = {}
    for df, used, mates in ((reads, cfg.modules(0), (0,)), (None if couples is None else pairs.as_reads(couples, cfg, True), cfg.modules(1), (1, 2))):
        if df is None:
            continue
        modules += [m for m in used if m not in modules]
        adapters += [a for m in mates for a in searched(cfg, m) if a not in adapters]
        found |= {(r["input_id"], r["mate"]): r.asDict() for r in stats.summary_grid(df, cfg, used).collect()}
    columns = [*stats.BASE, *(f"{m}_{x}" for m in modules for x in stats.MODULE_COLUMNS), *(f"adapter_{a}_reads" for a in adapters)]
    for item in items:
        for mate in item.offsets:
            start = {"input": item.stem, "type": item.kind, "mate": f"R{mate}" if mate else "all", "input_files": item.label, "output_files": ", ".join(names[item.number] if mate else names[item.number][:1])}
            own = found.get((item.number, mate), dict.fromkeys(("reads_pre", "reads_lost", "reads_post", "invalid_reads", "rejected_after_trimming", "bases_pre", "bases_post", "kept_in_pairs", "kept_as_singletons"), 0))
            if not mate:
                own["kept_in_pairs"] = own["kept_as_singletons"] = None
            rows.append({c: (own | start).get(c) for c in columns})
    head, cells = stats.rendered(rows)
    return "".join("\t".join(r) + "\n" for r in [head, *cells])


def run(spark: SparkSession, cfg: TrimConfig, inputs: Inputs, folder: str | None, range_bytes: int = fastq.RANGE, threads: int = 1) -> list[str]:
    """Processes the inputs into ``folder`` (None: kept reads to standard output) and returns the summary's lines."""
    cfg = cfg.validate()
    items = plan_items(inputs, cfg)
    if not items:
        raise ValueError("no input")
    unpaired, couples = load(spark, items, range_bytes, first_of(cfg, threads))
    # Read by the writer and the statistics: written once, so files are parsed and modules evaluated once, whatever executor goes.
    kept: list[str] = []

    def once(df: DataFrame | None) -> DataFrame | None:
        if df is None:
            return None
        df, path = files.stored(df)
        kept.append(path)
        return df

    try:
        reads = once(None if unpaired is None else single(unpaired, cfg, 0, cfg.stats))
        done = once(None if couples is None else pairs.processed(couples, cfg, cfg.stats))
        if folder is None:
            for row in routed(items, cfg, reads, done).orderBy("file", "ordinal").toLocalIterator():
                sys.stdout.write(row["record"] + "\n")
        elif not cfg.testrun:
            written = fastq.write_files(routed(items, cfg, reads, done), folder, cfg.gzip_level if cfg.gzip else None, cfg.ordered_output)
            for name in (n for names in outputs(items, cfg).values() for n in names if n not in written):
                fastq.write_empty(f"{folder}/{name}", cfg.gzip)
        if cfg.stats:
            text = grid_text(items, cfg, reads, done)
        else:
            alone = {r["input_id"]: (r["kept"], r["rejected"]) for r in reads.groupBy("input_id").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("rejected")).collect()} if reads is not None else {}
            double = {r["input_id"]: r.asDict() for r in stats.kept_counts(done).collect()} if done is not None else {}
            text = summary_text(items, cfg, alone, double)
    finally:
        for path in kept:
            files.remove(spark, path)
    if folder is not None and not cfg.testrun:
        files.write_text(f"{folder}/results_summary.txt", text)
    return text.splitlines()
