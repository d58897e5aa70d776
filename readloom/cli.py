"""Command line: python -m readloom."""

from __future__ import annotations

import argparse
import contextlib
import dataclasses
import datetime
import io
import itertools
import logging
import os
import pathlib
import re
import sys
import tempfile
import threading
import time

import pyarrow.fs

from readloom import __version__
from readloom.functions.adapters import GROUPS
from readloom.plans.config import TrimConfig
from readloom.sources import discover, fastq, files

DEFAULTS = {f.name: f.default for f in dataclasses.fields(TrimConfig)}
#: Options that set a field: long name, short name or None, field, kind, help.
OPTIONS: dict[str, list[tuple]] = {
    "Output": [
        ("--gzip", None, "gzip", bool, "pack the outputs"), ("--gzip-level", None, "gzip_level", int, "0 to 3"), ("--stdout", None, "stdout", bool, "kept reads to standard output, pairs interleaved"),
        ("--interleaved-out", None, "interleaved_out", bool, "pairs in one file"), ("--write-rejected", None, "write_rejected", bool, "files for rejected reads"),
        ("--discard-singles", None, "discard_singles", bool, "no files for reads whose mate is rejected"), ("--stats", None, "stats", bool, "statistics of inputs, mates, modules and adapters"),
    ],
    "Length and quality of reads": [
        *((f"--{a}-length-{b}", None, f"{a}_length_{b}", int, f"{a}imum length, {b}") for b in ("input", "output") for a in ("min", "max")),
        *((f"--{a}-length-output-perc", None, f"{a}_length_output_perc", int, "percent of the raw length") for a in ("min", "max")),
        ("--min-average-qual-pre", None, "min_average_qual_pre", int, "mean quality of the raw read"), ("--min-average-qual-post", None, "min_average_qual_post", int, "mean quality of what is left"),
        ("--n-filter", None, "n_filter", bool, "reject reads with N"),
    ],
    "Fixed cuts": [("--cut-flag", "-cf", "cut", bool, "on"), ("--cut-start", "-cs", "cut_start", int, ""), ("--cut-end", "-ce", "cut_end", int, ""), ("--cut-both", "-cb", "cut_both", int, "")],
    "Quality at the ends": [("--endqual-filter-flag", "-ef", "endqual", bool, "on"), ("--endqual-min-start", "-ems", "endqual_min_start", int, ""), ("--endqual-min-end", "-eme", "endqual_min_end", int, ""), ("--endqual-min-both", "-emb", "endqual_min_both", int, "")],
    "Sliding window": [("--slider-filter-flag", "-sf", "slider", bool, "on"), ("--slider-window", "-sw", "slider_window", int, ""), ("--slider-quality", "-sq", "slider_quality", int, ""), ("--slider-step", "-ss", "slider_step", int, "")],
    "Homopolymers": [
        ("--poly-filter-flag", "-pf", "poly", bool, "on"),
        *((f"--poly-{a}-{b}", f"-p{a[0]}{b[0]}", f"poly_{a}_{b}", str if a == "bases" else int, "") for a in ("bases", "length") for b in ("start", "end", "both")),
    ],
    "Adapters": [
        ("--adapter-filter-flag", "-af", "adapter", bool, "on"), ("--adapter-seed", "-as", "adapter_seed", int, "letters that must overlap"), ("--adapter-group", "-ag", "adapter_group", list, "built-in groups, or all"),
        ("--adapter-mismatch", "-am", "adapter_mismatch", int, "different letters in a whole adapter"), ("--adapter-add", "-ad", "adapter_add", str, "FASTA file or sequences"), ("--adapter-excl", "-ax", "adapter_excl", str, "these only"),
        ("--adapter-read-1", "-a1", "adapter_read_1", str, "for read 1"), ("--adapter-read-2", "-a2", "adapter_read_2", str, "for read 2"),
    ],
    "Overlap of mates": [("--overlap-filter-flag", "-of", "overlap", bool, "on"), ("--overlap-mismatches", "-om", "overlap_mismatches", int, ""), ("--overlap-min-length", "-ol", "overlap_min_length", int, ""), ("--overlap-portion-mismatch", "-op", "overlap_portion_mismatch", int, "percent")],
    "Low complexity": [("--kmer-filter-flag", "-kf", "kmer", bool, "on"), ("--kmer-size", "-ks", "kmer_size", str, "k, or several between commas"), ("--kmer-cutoff", "-kc", "kmer_cutoff", int, "percent")],
    "MGI headers": [("--mgi-convert-flag", "-mf", "mgi_convert", bool, "on"), ("--mgi-bc5", "-m5", "mgi_bc5", str, ""), ("--mgi-bc7", "-m7", "mgi_bc7", str, ""), ("--mgi-instrument", "-mi", "mgi_instrument", str, ""), ("--mgi-run", "-mr", "mgi_run", str, "")],
    "Running": [
        ("--threads", "-t", "threads", int, "cores; else from the scheduler's variables, else all but one"), ("--reads-for-phred-offset", None, "reads_for_phred_offset", int, ""), ("--chunk-size", None, "chunk_size", int, "reads a thread in a test run"),
        ("--phred-offset", None, "phred_offset", int, "33 or 64"), ("--phred-out", None, "phred_out", int, "33 or 64"), ("--testrun", None, "testrun", bool, "the first reads only, nothing written"), ("--ordered-output", None, "ordered_output", bool, "outputs in the inputs' order"),
    ],
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("readloom", description="Quality control of short reads on Spark.", allow_abbrev=False)
    p.add_argument("--version", "-v", action="version", version=__version__)
    p.add_argument("--list-adapters", action="store_true")
    p.add_argument("--full-auto", "-GO", action="store_true", help="a preset; keeps the inputs only")
    p.add_argument("--progress", action="store_true")
    p.add_argument("--verbose", action="store_true")
    g = p.add_argument_group("Input")
    for name, short, text in (("files", "-i", "kinds are told from the headers; - is standard input"), ("paired", "-ip", "R1 R2 R1 R2 ..."), ("interleaved", "-ii", ""), ("unpaired", "-iu", "")):
        g.add_argument(f"--input-{name}", short, nargs="+", default=[], help=text)
    p.add_argument("--output", "-o", default=".")
    for title, options in OPTIONS.items():
        g = p.add_argument_group(title)
        for name, short, field, kind, text in options:
            names = [name] + [short] * bool(short)
            if kind is bool:
                g.add_argument(*names, dest=field, action="store_true", help=text)
            else:
                g.add_argument(*names, dest=field, type=str if kind is list else kind, default=list(DEFAULTS[field]) if kind is list else DEFAULTS[field], nargs="+" if kind is list else None, help=text)
    return p


def config(args: argparse.Namespace) -> TrimConfig:
    if args.full_auto:
        return TrimConfig.full_auto()
    values = {f: getattr(args, f) for options in OPTIONS.values() for _, _, f, _, _ in options}
    values["adapter_group"] = tuple(values["adapter_group"])
    if values["gzip"]:
        values["stdout"] = False
    if values["stdout"]:
        values |= {"interleaved_out": True, "discard_singles": True, "write_rejected": False}
    return TrimConfig(**values)


#: Variables in which job schedulers tell a job's cores.
SCHEDULERS = ("SLURM_CPUS_PER_TASK", "PBS_NCPUS", "NCPUS", "NSLOTS", "LSB_DJOB_NUMPROC")


def thread_count(given: int | None) -> int:
    """The number asked for, else what a scheduler grants, else all cores but one; at least 1."""
    told = [given, *(os.environ.get(v) for v in SCHEDULERS)]
    numbers = [int(x) for x in told if x is not None and re.fullmatch(r"\s*[+-]?\d+\s*", str(x))]
    return max(1, numbers[0] if numbers else (os.cpu_count() or 2) - 1)


def new_folder(parent: str) -> str:
    """A folder for this run's results, in any store, named by the time; runs of one second are numbered from 2 on."""
    fs, root = files.open_fs(parent)
    stamp = datetime.datetime.now().strftime("%Y-%m-%d_%H-%M-%S")
    fs.create_dir(root, recursive=True)
    for k in itertools.count(1):
        name = f"readloom_results_{stamp}" + (f"_{k}" if k > 1 else "")
        if fs.get_file_info(f"{root}/{name}").type != pyarrow.fs.FileType.NotFound:
            continue
        if isinstance(fs, pyarrow.fs.LocalFileSystem):
            with contextlib.suppress(FileExistsError):
                pathlib.Path(root, name).mkdir()
                return str(pathlib.Path(root, name).resolve())
            continue
        fs.create_dir(f"{root}/{name}")
        return f"{parent.rstrip('/')}/{name}"
    raise AssertionError


def adapter_list() -> str:
    """The built-in groups, their sequences in one column."""
    width = max(len(name) for entries in GROUPS.values() for name, _ in entries)
    blocks = [f"  [{group}]\n" + "".join(f"    {name.ljust(width)}   {seq}\n" for name, seq in entries) for group, entries in GROUPS.items()]
    return "\nBuilt-in adapters. Of a pair, read 1 is searched for 'Read 1' and read 2 for 'Read 2' sequences where a group has both.\n\n" + "\n".join(blocks)


class Progress(threading.Thread):
    """A line on standard error about the tasks of the running stages, with the time that is left at this pace."""

    def __init__(self, spark, reads: int):
        super().__init__(daemon=True)
        self.tracker, self.reads, self.done, self.began = spark.sparkContext.statusTracker(), reads, threading.Event(), time.monotonic()

    def line(self) -> str | None:
        stages = [x for i in self.tracker.getActiveStageIds() if (x := self.tracker.getStageInfo(i))]
        whole, ready = sum(x.numTasks for x in stages), sum(x.numCompletedTasks for x in stages)
        if not whole:
            return None
        spent = time.monotonic() - self.began
        left = f"{spent * (whole - ready) / ready:.0f} s left" if ready else "..."
        return f"about {self.reads:,} reads, {ready}/{whole} tasks of {', '.join(x.name.split(' ')[0] for x in stages)}, {left}"

    def run(self) -> None:
        stage: list[int] = []
        while not self.done.wait(1):
            if (now := list(self.tracker.getActiveStageIds())) != stage:
                stage, self.began = now, time.monotonic()
            if text := self.line():
                print(f"\r{text:<100}", end="", file=sys.stderr, flush=True)
        print(file=sys.stderr)


def logged(verbose: bool, cfg: TrimConfig) -> io.StringIO:
    """The run's log, with its parameters; ``verbose`` shows it on the terminal as well."""
    text = io.StringIO()
    handlers: list[logging.Handler] = [logging.StreamHandler(text)] + [logging.StreamHandler(sys.stderr)] * verbose
    logging.basicConfig(handlers=handlers, level=logging.DEBUG if verbose else logging.INFO, format="%(asctime)s [%(levelname)s] %(message)s", force=True)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    logging.info("--- Start of run parameters ---")
    for name, value in sorted(dataclasses.asdict(cfg).items()):
        logging.info("[PARAMETER] %s: %s", name, ", ".join(map(str, value)) if isinstance(value, tuple | list) else value)
    logging.info("---- End of run parameters ----")
    return text


def main(argv: list[str] | None = None) -> int:
    p = parser()
    argv = sys.argv[1:] if argv is None else argv
    if not argv:
        p.print_help()
        return 1
    args = p.parse_args(argv)
    if args.list_adapters:
        print(adapter_list())
        return 0
    spooled = None
    try:
        cfg = config(args).validate()
        files = list(args.input_files)
        if "-" in files or not (files or args.input_paired or args.input_interleaved or args.input_unpaired or args.full_auto):
            spooled = discover.spooled_stdin()
            files = [spooled if f == "-" else f for f in files] or [spooled]
        elif args.full_auto and not (files or args.input_paired or args.input_interleaved or args.input_unpaired):
            files = discover.in_folder()
        pairs, interleaved, unpaired, warnings = discover.detect(files)
        pairs += discover.explicit_pairs(args.input_paired)
    except (ValueError, OSError) as e:
        p.error(str(e))
    for w in warnings:
        print(w, file=sys.stderr)
    from pyspark.sql import SparkSession

    from readloom.plans.run import Inputs, run

    threads = thread_count(cfg.threads)
    # Under spark-submit the master is set; else the cores of this machine.
    builder = SparkSession.builder.appName("readloom").config("spark.ui.showConsoleProgress", "false")
    spark = (builder if "spark.master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "") or os.environ.get("MASTER") else builder.master(f"local[{threads}]")).getOrCreate()
    progress, log, folder = None, None, None
    try:
        inputs = Inputs(unpaired + args.input_unpaired, pairs, interleaved + args.input_interleaved)
        folder = None if cfg.stdout else tempfile.gettempdir() if cfg.testrun else new_folder(args.output)
        if folder and not cfg.testrun:
            log = logged(args.verbose, cfg)
        if args.progress:
            every = [*inputs.unpaired, *inputs.interleaved, *(f for pair in inputs.paired for f in pair)]
            progress = Progress(spark, sum(fastq.read_count_estimate(f) for f in every))
            progress.start()
        lines = run(spark, cfg, inputs, folder, threads=threads)
        logging.info("finished")
        if not cfg.stdout:
            print("\n".join(lines))
        return 0
    except KeyboardInterrupt:
        return 130
    finally:
        if progress:
            progress.done.set()
        if log:
            files.write_text(f"{folder}/readloom.log", log.getvalue())
        spark.stop()
        if spooled:
            os.unlink(spooled)
