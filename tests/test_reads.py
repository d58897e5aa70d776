"""Options, expressions and the merged plan on hand-made reads."""

import pytest
from pyspark.sql import functions as F

from readloom.functions import adapters, sequences
from readloom.operators import pairs, stats
from readloom.operators.filters import well_formed
from readloom.operators.reads import searched, single
from readloom.plans.config import TrimConfig

COLUMNS = "input_id long, ordinal long, mate int, header string, seq string, plus string, qual string, offset int"


def frame(spark, reads, offset=33):
    return spark.createDataFrame([(0, k, 0, "@r", s, "+", q, offset) for k, (s, q) in enumerate(reads)], COLUMNS)


def windows(spark, reads, module, offset=33, **options):
    out = single(frame(spark, reads, offset), TrimConfig(**options).validate()).orderBy("ordinal").select(f"w_{module}.l", f"w_{module}.r").collect()
    return [tuple(r) for r in out]


def test_validation(spark):
    rows = [("@r", "ACGTN", "+", "IIIII", True), ("@r", "", "+", "", True), ("@", "A", "+", "I", False), ("r1", "A", "+", "I", False), ("@r", "a", "+", "I", False), ("@r", "A", "x", "I", False),
            ("@r", "A", "+", "II", False), ("@r", "A", "+", " ", False), ("@r", "A", "+", "\x7f", False), ("@r", "A\n", "+", "II", False), (None, "A", "+", "I", False), ("@r", None, "+", None, False)]
    df = spark.createDataFrame(rows, "header string, seq string, plus string, qual string, want boolean")
    assert all(r.ok == r.want for r in df.select("want", well_formed(*map(F.col, ("header", "seq", "plus", "qual"))).alias("ok")).collect())


def test_cuts(spark):
    reads = [("ACGTACGTAC", "I" * 10), ("ACG", "III"), ("", "")]
    assert windows(spark, reads, "cut", cut=True, cut_start=2, cut_end=3) == [(2, 7), (2, 0), (0, 0)]
    assert windows(spark, reads, "cut", cut=True, cut_start=0, cut_both=4) == [(0, 6), (0, 0), (0, 0)]


def test_end_quality(spark):
    reads = [("ACGTA", "#I#I#"), ("ACGTA", "#####"), ("ACGTA", "I####"), ("ACGTA", "####I"), ("", ""), ("ACGTA", "5I$I5")]
    assert windows(spark, reads, "endqual", endqual=True) == [(1, 4), (5, 0), (0, 1), (4, 5), (0, 0), (0, 5)]
    assert windows(spark, reads[5:], "endqual", endqual=True, endqual_min_start=30, endqual_min_end=10) == [(1, 5)]
    assert windows(spark, [("ACG", "BhB")], "endqual", 64, endqual=True) == [(1, 2)]
    assert windows(spark, [("ACG", "#I#")], "endqual", endqual=True, endqual_min_both=0) == [(0, 3)]


def test_homopolymers(spark):
    reads = [("GGGG", "IIII"), ("ACCGGGGGGGGGGGG", "I" * 15), ("ACGGG", "IIIII"), ("AAACTTT", "I" * 7)]
    assert windows(spark, reads, "poly", poly=True) == [(0, 4), (0, 3), (0, 5), (0, 7)]
    assert windows(spark, reads, "poly", poly=True, poly_bases_start="a", poly_length_start=3, poly_bases_end="G,T", poly_length_end=3)[2:] == [(0, 2), (3, 4)]
    # The 3' end's own defaults stand, so options for both reach the 5' end only.
    assert windows(spark, reads[3:], "poly", poly=True, poly_bases_both="A", poly_length_both=2) == [(3, 7)]
    with pytest.raises(ValueError):
        TrimConfig(poly=True, poly_bases_end="GG").validate()


def test_kmers_and_quality(spark):
    reads = [("ACGTACGGTCAAT", "I" * 13), ("AAAAAAAAAA", "I" * 10), ("AC", "II"), ("ACGTACGT", "+" * 8)]
    assert [r > 0 for _, r in windows(spark, reads, "kmer", kmer=True)] == [True, False, False, True]
    assert windows(spark, reads[2:3], "kmer", kmer=True, kmer_cutoff=0) == [(0, 2)]
    assert windows(spark, reads, "avgqual_pre", min_average_qual_pre=20) == [(0, 13), (0, 10), (0, 2), (0, 0)]


def test_merge_keeps_the_strictest_and_filters(spark):
    cfg = TrimConfig(cut=True, cut_start=1, endqual=True, min_length_output=3, max_length_output_perc=70)
    rows = single(frame(spark, [("ACGTACGTAC", "#III######"), ("ACGTACGTAC", "IIIIIIIIII"), ("ACGTACGTAC", "##II######"), ("ACGTX", "IIIII")]), cfg).orderBy("ordinal").collect()
    assert [(r.l, r.r, r.keep, r.route) for r in rows] == [(1, 4, True, "unpaired"), (1, 10, False, "rejected_filtered"), (2, 4, False, "rejected_filtered"), (None, None, False, "rejected_invalid")]
    assert (rows[0].out_seq, rows[0].out_qual, rows[1].out_seq) == ("CGT", "III", "ACGTACGTAC")


def test_mean_after_trimming(spark):
    cfg = TrimConfig(endqual=True, min_average_qual_post=30)
    assert [r.keep for r in single(frame(spark, [("ACGT", "I##I"), ("ACGT", "#II#")]), cfg).orderBy("ordinal").collect()] == [False, True]


def test_phred(spark):
    df = spark.createDataFrame([("!I~", 33), ("@h~;:", 64)], "q string, o int")
    got = df.select(sequences.phred_convert(F.col("q"), F.col("o"), 64).alias("a"), sequences.phred_convert(F.col("q"), F.col("o"), 33).alias("b")).collect()
    assert [tuple(r) for r in got] == [("@h~", "!I~"), ("@h~;:", "!I_!:")]


def test_headers(spark):
    rows = ["@a:1 2:N:0:AC", "@a/1", "@a", "@a x", "@a 3:N:0:A"]
    df = spark.createDataFrame([(h,) for h in rows], "h string").select(sequences.header_base(F.col("h")), sequences.header_mate(F.col("h")))
    assert [tuple(r) for r in df.collect()] == [("@a:1", 2), ("@a", 1), ("@a", None), ("@a", None), ("@a", None)]
    mgi = spark.createDataFrame([("@@FL3L2C003R0140000567/2 x",), ("@M-1:2:F:1:11:2:3 1:N:0:A",)], "h string")
    made = [r[0] for r in mgi.select(sequences.mgi_header(F.col("h"), "B5", "B7", "I", "R")).collect()]
    assert made == ["@I:R:FL3:2:567:3:14 2:N:0:B7+B5", "@M-1:2:F:1:11:2:3 1:N:0:A"]
    with pytest.raises(Exception, match="neither MGI"):
        spark.createDataFrame([("@x",)], "h string").select(sequences.mgi_header(F.col("h"), "", "", "", "")).collect()


def test_adapter_choice(tmp_path):
    one, two = (s for _, s in adapters.GROUPS["TruSeq"])
    assert searched(TrimConfig(adapter=True), 1) == [one] and searched(TrimConfig(adapter=True), 2) == [two] and searched(TrimConfig(adapter=True), 0) == [one, two]
    # miRNA has the sequence of TruSeq's read 1: kept for read 2 too.
    assert one in searched(TrimConfig(adapter=True, adapter_group=("TruSeq", "Illumina_miRNA")), 2)
    assert searched(TrimConfig(adapter=True, adapter_add=two), 1) == [one]
    assert searched(TrimConfig(adapter=True, adapter_excl=f"{two}, acgt"), 1) == [two, "ACGT"]
    assert searched(TrimConfig(adapter=True, adapter_read_1="ACG"), 2) == [] and searched(TrimConfig(adapter=True, adapter_read_1="ACG"), 0) == ["ACG"]
    fasta = tmp_path / "a.fa"
    fasta.write_text(">x\nacg\nTTT\n>y\nCC\n\n>z\nAA\n")
    assert adapters.load(str(fasta)) == [("x", "ACGTTT"), ("y", "CC")]
    for bad in ("ACG\n", ">x\n>y\nA\n", ">x\nAXZ\n", ""):
        fasta.write_text(bad)
        with pytest.raises(ValueError):
            adapters.load(str(fasta))
    with pytest.raises(ValueError):
        adapters.load("ACX")


def test_pairs(spark):
    ins = "ACGTTGCAACGGATCCATGCAACGTTGCAGCTAGCTTAGGCATCGATTCA"
    rc = ins[::-1].translate(str.maketrans("ACGT", "TGCA"))
    full = "I" * 60
    rows = [(0, 0, 1, (ins + "AGATCGGAAGAGC")[:60]), (0, 0, 2, (rc + "AGATCGGAAGAGC")[:60]), (0, 1, 1, "ACGT" * 15), (0, 1, 2, "X" * 60)]
    df = spark.createDataFrame([(i, o, m, f"@r {m}", s, "+", full, 33) for i, o, m, s in rows], COLUMNS)
    done = pairs.processed(pairs.aligned(df), TrimConfig(overlap=True, overlap_min_length=20), True).orderBy("ordinal").collect()
    assert [(r.a_r, r.b_r, r.route) for r in done] == [(50, 50, "paired"), (60, None, "single_r1")]
    with pytest.raises(Exception, match="mates don't match"):
        pairs.aligned(df.where("NOT (ordinal = 1 AND mate = 2)")).collect()


def test_statistics(spark):
    cfg = TrimConfig(cut=True, cut_end=2, endqual=True, adapter=True, adapter_excl="ACGTAC,TTTTTTTT")
    df = single(frame(spark, [("GGACGTAC", "IIIIIIII"), ("GGGG", "II##"), ("GGGGG", "#####"), ("x", "I")]), cfg, 0, True).persist()
    t = stats.totals(df).first()
    assert (t.invalid, t.reads_in, t.reads_out, t.rejected_after_trim, t.bases_in, t.bases_out) == (1, 3, 2, 1, 17, 4)
    m = {r.module: (r.reads, r.bases, r.decisive_reads) for r in stats.module_counters(df, cfg.modules()).collect()}
    assert m == {"adapter": (1, 6, 1), "endqual": (2, 7, 2), "cut": (3, 6, 1)}
    assert {r.adapter: r.reads for r in stats.adapter_hits(df, cfg).collect()} == {"ACGTAC": 1, "TTTTTTTT": 0}
    med = {r.kind: r.median for r in stats.medians(stats.histograms(df)).collect()}
    assert (med["len_in"], med["len_out"]) == (5, 2)
    names, cells = stats.rendered([r.asDict() for r in stats.summary_grid(df, cfg, cfg.modules()).collect()])
    assert dict(zip(names, cells[0]))["bases_kept_percent"] == "23.5294"


def test_full_auto_and_ranges():
    cfg = TrimConfig.full_auto()
    assert (cfg.endqual, cfg.adapter, cfg.n_filter, cfg.min_length_output_perc, cfg.gzip) == (True, True, True, 33, True)
    for bad in ({"adapter_seed": 0}, {"kmer": True, "kmer_size": "4,22"}, {"slider": True, "slider_step": 0}, {"endqual_min_both": 94}, {"phred_out": 50}):
        with pytest.raises(ValueError):
            TrimConfig(**bad).validate()
