"""Operators over stored reads, and scan and sink over FASTQ files, on local[$BENCH_CPUS]; one JSON line.

The reads are derived from $BENCH_SF_DIR and repeated (under other ids) to $BENCH_READS, 5 million unless set, and stored as
Parquet and FASTQ before the clock starts. Each query then reads what is stored, works, and writes to Spark's noop sink; seconds
are of one run each after a small warm-up. ``reads_per_second`` gives the same as throughput.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from readloom.functions.sequences import fastq_record
    from readloom.operators import pairs, stats
    from readloom.operators.reads import single
    from readloom.plans import derived
    from readloom.plans.config import TrimConfig
    from readloom.sources import fastq

    sf_dir, cpus, wanted = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_READS", "5000000"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", 4 * int(cpus)).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-")
    try:
        source = derived.reads(spark, sf_dir).drop("mgi_header")
        source.write.parquet(f"{folder}/few")
        few = spark.read.parquet(f"{folder}/few")
        n = few.count()
        times = max(1, -(-wanted // n))
        more = few.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
        more.withColumn("ordinal", F.col("ordinal") * times + F.col("copy")).drop("copy").repartition(4 * int(cpus)).write.parquet(f"{folder}/reads")
        reads, n = spark.read.parquet(f"{folder}/reads"), n * times
        both = pairs.aligned(reads)
        record = fastq_record(F.col("header"), F.col("seq"), F.col("plus"), F.col("qual"))
        part = reads.where(f"ordinal % {max(1, times // 5)} = 0")
        os.mkdir(f"{folder}/in")
        text = fastq.write_files(part.select(F.lit("all.fastq").alias("file"), "ordinal", record.alias("record")), f"{folder}/in")["all.fastq"]

        def alone(**options):
            return n, lambda: single(reads, TrimConfig(**options)).select("keep", "out_seq", "out_qual")

        full = TrimConfig(endqual=True, slider=True, poly=True, adapter=True, kmer=True, cut=True, overlap=True, n_filter=True)
        queries = {
            "no_modules": alone(), "endqual_trim": alone(endqual=True), "slider_trim": alone(slider=True), "poly_end": alone(poly=True),
            "adapter_mismatch": alone(adapter=True, adapter_mismatch=3, adapter_seed=10), "kmer_filter": alone(kmer=True),
            "align_mates": (n, lambda: both.select("a_seq", "b_seq")),
            "overlap_insert": (n, lambda: pairs.processed(both, TrimConfig(overlap=True)).select("insert", "route")),
            "full_auto": (n, lambda: single(reads, TrimConfig.full_auto()).select("keep", "out_seq", "out_qual")),
            "merge_windows": (n, lambda: pairs.processed(both, full).select("route", "a_out_seq", "b_out_seq")),
            "module_stats": (n, lambda: stats.module_counters(single(reads, TrimConfig(endqual=True, poly=True, adapter=True)), ["poly", "adapter", "endqual"])),
            "fastq_scan": (text, lambda: fastq.read_fastq(spark, [(0, 0, f"{folder}/in/all.fastq")], 8 << 20)),
        }
        single(few, full).write.format("noop").mode("overwrite").save()  # starts workers and compiles
        took, pace = {}, {}
        for name, (rows, make) in queries.items():
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
            pace[name] = round(rows / took[name])
        os.mkdir(f"{folder}/out")
        began = time.perf_counter()
        fastq.write_files(part.select(F.lit("all.fastq").alias("file"), "ordinal", record.alias("record")), f"{folder}/out", 1)
        took["fastq_gzip_sink"] = round(time.perf_counter() - began, 3)
        pace["fastq_gzip_sink"] = round(text / took["fastq_gzip_sink"])
    finally:
        spark.stop()
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "reads": n, "fastq_reads": text, "reads_per_second": pace}))


if __name__ == "__main__":
    main()
