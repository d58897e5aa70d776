"""Physical plans: what moves, what is read, how often a batch crosses to Python."""

import pytest
from pyspark.sql import functions as F

from readloom.operators import pairs, stats
from readloom.operators.reads import single
from readloom.plans.config import TrimConfig


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("reads") / "r")
    spark.createDataFrame(
        [(0, k, m, f"@r{k}", "ACGTACGT", "+", "IIIIIIII", 33, "unused") for k in range(20) for m in (1, 2)],
        "input_id long, ordinal long, mate int, header string, seq string, plus string, qual string, offset int, other string",
    ).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_single_reads_shuffle_nothing_and_cross_to_python_once(stored):
    cfg = TrimConfig(endqual=True, slider=True, poly=True, adapter=True, kmer=True, cut=True, min_average_qual_pre=20)
    text = plan(single(stored, cfg).where("keep").select("ordinal", "out_seq", "out_qual"))
    assert "Exchange" not in text and text.count("ArrowEvalPython") == 1
    assert "other" not in text.split("ReadSchema")[1]


def test_native_modules_need_no_python(stored):
    cfg = TrimConfig(endqual=True, poly=True, cut=True, cut_start=1, n_filter=True, min_length_output=3)
    assert "Python" not in plan(single(stored, cfg).select("keep", "out_seq"))


def test_filters_reach_the_scan(stored):
    assert "GreaterThanOrEqual(ordinal,5)" in plan(single(stored, TrimConfig(endqual=True)).where("ordinal >= 5").select("keep"))


def test_pairs_join_once(stored):
    done = pairs.processed(pairs.aligned(stored), TrimConfig(endqual=True, overlap=True, adapter=True))
    text = plan(done.select("route", F.col("a_out_seq")))
    assert text.count("SortMergeJoin") + text.count("ShuffledHashJoin") == 1 and text.count("Exchange hashpartitioning") == 2


def test_statistics_sum_before_they_shuffle(stored):
    text = plan(stats.totals(single(stored, TrimConfig(endqual=True), 0, True)))
    assert "partial_sum" in text and text.count("Exchange hashpartitioning") == 1
