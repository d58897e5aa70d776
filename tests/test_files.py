"""FASTQ framing, discovery, whole runs, the command line and streams."""

import gzip
import random

import pytest

from readloom import cli
from readloom.plans.config import TrimConfig
from readloom.plans.run import Inputs, first_of, load, plan_items, run
from readloom.sources import discover, fastq, files


def write(path, records, end="\n", tail=""):
    path.write_bytes(("".join(end.join(r) + end for r in records) + tail).encode("latin-1"))
    return str(path)


def make(n, name="r", seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        k = rnd.randint(0, 40)
        out.append((f"@{name}:{i}", "".join(rnd.choices("ACGT", k=k)), "+", "@" * min(k, 1) + "".join(rnd.choices("@+I#", k=max(k - 1, 0)))))
    return out


def rows(df):
    return [tuple(r) for r in df.orderBy("ordinal").select("ordinal", "header", "seq", "plus", "qual").collect()]


@pytest.mark.parametrize("range_bytes", [7, 64, 1 << 20])
@pytest.mark.parametrize(("end", "tail"), [("\n", ""), ("\r\n", "\r\n\n\n"), ("\n", "@cut\nACG\n")])
def test_split_anywhere(spark, tmp_path, range_bytes, end, tail):
    records = make(12 if range_bytes == 7 else 200)
    path = write(tmp_path / "a.fastq", records, end, tail)
    if records[-1][1] == "":
        records = records[:-1]
        path = write(tmp_path / "a.fastq", records, end, tail)
    assert rows(fastq.read_fastq(spark, [(0, 0, path)], range_bytes)) == [(i, *r) for i, r in enumerate(records)]


def test_neighbouring_ranges_share_tasks(spark, tmp_path):
    one, two = (make(n, "s", n) + [("@last", "ACGT", "+", "IIII")] for n in (300, 200))
    paths = [write(tmp_path / "a.fastq", one), write(tmp_path / "b.fastq", two)]
    packed = tmp_path / "c.fastq"
    packed.write_bytes(gzip.compress("".join("\n".join(r) + "\n" for r in two).encode()))
    df = fastq.read_fastq(spark, [(0, 0, paths[0]), (1, 1, paths[1]), (1, 2, str(packed))], 64)
    assert df.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism + 3
    for input_id, mate, records in ((0, 0, one), (1, 1, two), (1, 2, two)):
        assert rows(df.where(f"input_id = {input_id} AND mate = {mate}")) == [(i, *r) for i, r in enumerate(records)]


def test_first_records_are_read_alone(spark, tmp_path):
    """A test run ends with its chunks: it reads no more of a file, so what comes later can't stop it."""
    records = [(f"@r:{i}", "ACGT", "+", "IIII") for i in range(90)]
    a, b = write(tmp_path / "x_R1.fastq", records), write(tmp_path / "x_R2.fastq", records[:50])
    mixed = write(tmp_path / "y.fastq", records[:41])
    packed = tmp_path / "z.fastq"
    packed.write_bytes(gzip.compress("".join("\n".join(r) + "\n" for r in records[:40]).encode()))
    cfg = TrimConfig(testrun=True, chunk_size=10)
    items = plan_items(Inputs([str(packed)], [(a, b)], [mixed]), cfg)
    unpaired, couples = load(spark, items, 64, first_of(cfg, 2))
    assert rows(unpaired) == [(i, *r) for i, r in enumerate(records[:20])]
    found = {(r["input_id"], r["ordinal"]): (r["a_header"], r["b_header"]) for r in couples.collect()}
    assert found == {(1, i): (f"@r:{2 * i}", f"@r:{2 * i + 1}") for i in range(20)} | {(2, i): (f"@r:{i}",) * 2 for i in range(20)}


def test_gzip_by_content_and_members(spark, tmp_path):
    records = make(50)
    text = ["".join("\n".join(r) + "\n" for r in part).encode() for part in (records[:20], records[20:])]
    path = tmp_path / "misnamed.fastq"
    path.write_bytes(gzip.compress(text[0]) + gzip.compress(text[1]))
    assert files.is_gzip(str(path)) and not files.is_gzip(str(tmp_path / "absent"))
    assert rows(fastq.read_fastq(spark, [(0, 0, str(path))]))[:49] == [(i, *r) for i, r in enumerate(records)][:49]
    assert fastq.read_count_estimate(str(path)) >= 1


def test_empty_file(spark, tmp_path):
    path = write(tmp_path / "e.fastq", [])
    assert rows(fastq.read_fastq(spark, [(0, 0, path)])) == []
    with pytest.raises(ValueError):
        fastq.phred_offset(path)


def test_data_source(spark, tmp_path):
    path = write(tmp_path / "a.fastq", [("@a", "ACGT", "+", "IIII")] * 3)
    spark.dataSource.register(fastq.FastqSource)
    assert spark.read.format("fastq").option("path", path).load().count() == 3


def test_phred_detection(tmp_path):
    def of(q):
        return fastq.phred_offset(write(tmp_path / "q.fastq", [("@a", "A" * len(q), "+", q)]))

    assert (of("II#"), of("hhB"), fastq.phred_offset("absent", given=64)) == (33, 64, 64)
    with pytest.raises(ValueError):
        of("hi~")


def test_discovery(tmp_path):
    def one(name, *headers):
        return write(tmp_path / name, [(h, "A", "+", "I") for h in headers])

    a, b = one("x_S1_R1.fastq", "@q:1 1:N:0:A", "@q:2 1:N:0:A"), one("X_s1_R2.fq", "@q:1 2:N:0:A", "@q:2 2:N:0:A")
    mixed, alone, single = one("m.fq", "@m/1", "@m/2"), one("u.fastq", "@u", "@v"), one("w.fq", "@w/1")
    pairs, interleaved, unpaired, warnings = discover.detect([b, mixed, a, alone, single])
    assert (pairs, interleaved, unpaired, warnings) == ([(a, b)], [mixed], [alone, single], [])
    c, d = one("c.fq", "@z/1"), one("d.fq", "@z/1")
    assert discover.detect([c, d])[2:] == ([c, d], ["2 files begin with @z and are no pair"])
    assert discover.common_name(a, b) == "x_S1" and discover.base_name("k.FASTQ.GZIP") == "k"
    assert len(discover.in_folder(str(tmp_path))) == 7
    taken = {"s"}
    assert [discover.unique_prefix("s", taken) for _ in range(2)] == ["s_2", "s_3"]
    with pytest.raises(ValueError):
        discover.explicit_pairs(["a"])


def read_gz(path):
    return gzip.open(path).read().decode()


def test_run_writes_every_output(spark, tmp_path):
    good, bad = ("ACGTACGTAC", "I" * 10), ("ACGT", "####")
    a = write(tmp_path / "p_R1.fastq", [(f"@r{i} 1:N:0:A", s, "+", q) for i, (s, q) in enumerate([good, good, bad, bad])])
    b = write(tmp_path / "p_R2.fastq", [(f"@r{i} 2:N:0:A", s, "+", q) for i, (s, q) in enumerate([good, bad, good, bad])])
    u = write(tmp_path / "u.fastq", [("@u1", *("ACGT", "+", "II##")), ("@u2", "acgt", "+", "IIII")])
    out = tmp_path / "out"
    out.mkdir()
    cfg = TrimConfig(endqual=True, write_rejected=True, gzip=True, ordered_output=True)
    lines = run(spark, cfg, Inputs([u], [(a, b)]), str(out), range_bytes=50)
    assert "p_R1.fastq, p_R2.fastq" in lines[2] and lines[2].split("\t")[2:] == ["1", "1", "1", "2", "2"]
    assert lines[-1].split("\t")[2:] == ["1", "1"]
    assert read_gz(out / "p_R1_paired_filtered.fastq.gz") == "@r0 1:N:0:A\nACGTACGTAC\n+\nIIIIIIIIII\n"
    assert read_gz(out / "p_R2_unpaired_filtered.fastq.gz").startswith("@r2 2") and read_gz(out / "u_filtered.fastq.gz") == "@u1\nAC\n+\nII\n"
    assert read_gz(out / "p_R1_rejected.fastq.gz").count("@r") == 2 and read_gz(out / "u_rejected.fastq.gz") == "@u2\nacgt\n+\nIIII\n"
    assert sorted(p.name for p in out.iterdir() if p.name.startswith(".")) == []
    many = tmp_path / "many"
    many.mkdir()
    lines = run(spark, TrimConfig(endqual=True, interleaved_out=True, discard_singles=True, stats=True), Inputs(paired=[(a, b)]), str(many))
    assert (many / "p_interleaved_filtered.fastq").read_text().count("\n") == 8 and len(lines) == 3
    with pytest.raises(Exception, match="mates don't match"):
        run(spark, TrimConfig(), Inputs(paired=[(a, u)]), str(many))
    with pytest.raises(FileExistsError):
        run(spark, TrimConfig(), Inputs([u, u]), str(many))


def test_interleaved_equals_paired(spark, tmp_path):
    last = [("@a:30", "ACGT", "+", "IIII")]  # an empty last read would look like line ends at the end
    one, two = make(30, "a", 5) + last, make(30, "a", 6) + last
    a, b = write(tmp_path / "a_1.fq", one), write(tmp_path / "a_2.fq", two)
    both = write(tmp_path / "i.fq", [r for pair in zip(one, two) for r in pair])
    cfg, texts = TrimConfig(endqual=True, ordered_output=True, phred_offset=33), []
    for inputs in (Inputs(paired=[(a, b)]), Inputs(interleaved=[both])):
        out = tmp_path / f"o{len(texts)}"
        out.mkdir()
        run(spark, cfg, inputs, str(out))
        texts.append(sorted(p.read_text() for p in out.glob("*.fastq")))
    assert texts[0] == texts[1]


def test_command_line(capsys, tmp_path):
    assert cli.main([]) == 1
    assert cli.main(["--list-adapters"]) == 0 and "AGATCGGAAGAGC" in capsys.readouterr().out
    with pytest.raises(SystemExit) as e:
        cli.main(["-ip", "one"])
    assert e.value.code == 2
    args = cli.parser().parse_args(["-iu", "x", "-as", "9", "-ag", "all", "--stdout", "-pbs", "A"])
    cfg = cli.config(args)
    assert (cfg.adapter_seed, cfg.adapter_group, cfg.interleaved_out, cfg.poly_bases_start) == (9, ("all",), True, "A")
    assert cli.new_folder(str(tmp_path)) != cli.new_folder(str(tmp_path))


def test_stream(spark, tmp_path):
    from readloom.plans.derived import reads
    from readloom.streaming.trim import trim_stream, write_stream

    source = str(tmp_path / "in")
    batch = reads(spark, "/root/testdata/sf0.001")
    batch.write.parquet(source)
    cfg = TrimConfig(endqual=True, slider=True, adapter=True)
    q = write_stream(trim_stream(spark.readStream.schema(batch.schema).parquet(source), cfg), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("keep").count() == trim_stream(spark.read.parquet(source), cfg).where("keep").count() > 0
