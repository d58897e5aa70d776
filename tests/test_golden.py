"""A whole run with all modules over a pair of files and an unpaired one: every output byte by byte, from naive definitions."""

import gzip
import random

import pytest

from readloom import cli
from readloom.functions.adapters import GROUPS
from readloom.plans.config import TrimConfig
from readloom.plans.run import Inputs, run
from readloom.sources import fastq

R1, R2 = (s for _, s in GROUPS["TruSeq"])
OPTIONS = dict(gzip=True, n_filter=True, cut=True, endqual=True, slider=True, poly=True, adapter=True, kmer=True, overlap=True, ordered_output=True)


def complement(s):
    return "".join({"A": "T", "T": "A", "C": "G", "G": "C", "N": "N"}[c] for c in reversed(s))


def windows(seq, qual, adapters):
    """Every module's window, looked at letter by letter."""
    n, q, out = len(seq), [ord(c) - 33 for c in qual], {}
    good = [i for i in range(n) if q[i] >= 20]
    out["endqual"] = (good[0], good[-1] + 1) if good else (n, 0)
    if n < 5:
        out["slider"] = (0, n)
    else:
        bad = {i for s in range(n - 4) if sum(q[s : s + 5]) < 100 for i in range(s, s + 5)}
        runs, k = [], 0
        while k < n:
            e = k
            while e < n and e not in bad:
                e += 1
            if e > k:
                runs.append((k - e, -sum(q[k:e]), k, e))
            k = e + 1
        out["slider"] = min(runs)[2:] if runs else (0, 0)
    tail = n - len(seq.rstrip("G"))
    out["poly"] = (0, n - tail if tail >= 10 else n)
    ends = [n]
    for a in adapters:
        for p in range(n - min(6, len(a)) + 1):
            ov = min(len(a), n - p)
            if sum(x != y for x, y in zip(seq[p : p + ov], a)) <= ov * 2 // len(a):
                ends.append(p)
                break
    out["adapter"] = (0, min(ends))
    most = min(n - 3, 4**4)
    out["kmer"] = (0, n if n >= 4 and 100 * len({seq[i : i + 4] for i in range(n - 3)}) >= 50 * most else 0)
    out["cut"] = (0, n)
    return out


def insert(one, two):
    rc = complement(two)
    for size in range(min(len(one), len(two), max(len(one), len(two)) - 1), 49, -1):
        wrong = sum(a != b or a == "N" for a, b in zip(one[:size], rc[len(rc) - size :]))
        if wrong <= 5 and 100 * wrong <= 4 * size:
            return size
    return None


def valid(seq):
    return set(seq) <= set("ACGT")


def trimmed(rec, adapters, size=None):
    """The record that is written, or None."""
    header, seq, plus, qual = rec
    if not valid(seq):
        return None
    found = [*windows(seq, qual, adapters).values(), *([(0, size)] if size is not None else [])]
    left, right = max(0, *(w[0] for w in found)), min(len(seq), *(w[1] for w in found))
    return (header, seq[left:right], plus, qual[left:right]) if right > left else None


def text(records):
    return "".join("\n".join(r) + "\n" for r in records).encode()


def sample(n, seed):
    rnd = random.Random(seed)

    def qual(k):
        q = rnd.choices("IIIIIHGF5", k=k)
        cut = rnd.choice((0, 0, 5, 20, k))
        return "".join(q[: k - cut]) + "#" * cut

    pairs = []
    for i in range(n):
        frag = "".join(rnd.choices("ACGT", k=rnd.choice((30, 60, 80, 95, 150))))
        if i % 13 == 0:
            frag = "AC" * 60
        one, two = ((x + a + "G" * 120)[: rnd.choice((90, 100))] for x, a in ((frag, R1), (complement(frag), R2)))
        if i % 9 == 0:
            one = one[:10] + "N" + one[11:]
        if i % 7 == 0:
            two = two[:40] + ("A" if two[40] != "A" else "C") + two[41:]
        pairs.append(((f"@r{i} 1:N:0:A", one, "+", qual(len(one))), (f"@r{i} 2:N:0:A", two, "+", qual(len(two)))))
    return pairs


def test_all_modules(spark, tmp_path):
    pairs = sample(120, 1)
    alone = [(h.replace("@r", "@u").split()[0], s, p, q) for (h, s, p, q), _ in sample(60, 2)]
    (tmp_path / "t_R1.fastq").write_bytes(text(a for a, _ in pairs))
    (tmp_path / "t_R2.fastq.gz").write_bytes(gzip.compress(text(b for _, b in pairs)))
    (tmp_path / "single.fq").write_bytes(text(alone))
    one, two, single = (str(tmp_path / n) for n in ("t_R1.fastq", "t_R2.fastq.gz", "single.fq"))
    want = {n: [] for n in ("t_R1_paired_filtered", "t_R2_paired_filtered", "t_R1_unpaired_filtered", "t_R2_unpaired_filtered", "single_filtered")}
    for a, b in pairs:
        size = insert(a[1], b[1]) if valid(a[1]) and valid(b[1]) else None
        x, y = trimmed(a, [R1], size), trimmed(b, [R2], size)
        if x and y:
            want["t_R1_paired_filtered"].append(x)
            want["t_R2_paired_filtered"].append(y)
        elif x or y:
            want[f"t_R{1 if x else 2}_unpaired_filtered"].append(x or y)
    want["single_filtered"] = [r for r in (trimmed(a, [R1, R2]) for a in alone) if r]
    out = tmp_path / "out"
    out.mkdir()
    run(spark, TrimConfig(**OPTIONS), Inputs([single], [(one, two)]), str(out), range_bytes=700)
    assert sorted(p.name for p in out.iterdir()) == sorted([*(f"{n}.fastq.gz" for n in want), "results_summary.txt"])
    assert all(len(r) > 3 for r in want.values())
    for name, records in want.items():
        assert gzip.decompress((out / f"{name}.fastq.gz").read_bytes()) == text(records)
    n = {k: len(v) for k, v in want.items()}
    kept, s1, s2 = n["t_R1_paired_filtered"], n["t_R1_unpaired_filtered"], n["t_R2_unpaired_filtered"]
    names = ", ".join(f"t_R{m}_{k}_filtered.fastq.gz" for k in ("paired", "unpaired") for m in (1, 2))
    assert (out / "results_summary.txt").read_bytes().decode() == (
        "[Paired Reads]\nInput File(s)\tOutput File(s)\tKept_Pairs\tKept_R1_Singletons\tKept_R2_Singletons\tRejected_R1\tRejected_R2\r\n"
        f"t_R1.fastq, t_R2.fastq.gz\t{names}\t{kept}\t{s1}\t{s2}\t{120 - kept - s1}\t{120 - kept - s2}\r\n\n"
        "[Unpaired Reads]\nInput File\tOutput File\tKept\tRejected\r\n"
        f"single.fq\tsingle_filtered.fastq.gz\t{n['single_filtered']}\t{60 - n['single_filtered']}\r\n"
    )
    stats = tmp_path / "stats"
    stats.mkdir()
    run(spark, TrimConfig(**OPTIONS, stats=True), Inputs([single], [(one, two)]), str(stats))
    head, *rows = [line.split("\t") for line in (stats / "results_summary.txt").read_bytes().decode().split("\n")[:-1]]
    assert head[:13] == ["input", "type", "mate", "input_files", "output_files", "reads_pre", "invalid_reads", "rejected_after_trimming", "reads_lost", "reads_post", "reads_kept_percent", "kept_in_pairs", "kept_as_singletons"]
    assert head[24:28] == ["median_read_qual_pre", "median_read_qual_post", "kmer_reads_trimmed", "kmer_reads_trimmed_percent"] and head[-3:] == ["overlap_decisive_reads", f"adapter_{R1}_reads", f"adapter_{R2}_reads"]
    grid = {(r[0], r[2]): dict(zip(head, r, strict=True)) for r in rows}
    assert list(grid) == [("single", "all"), ("t", "R1"), ("t", "R2")]
    r = grid["t", "R1"]
    out_1 = want["t_R1_paired_filtered"] + want["t_R1_unpaired_filtered"]
    seen = [a for a, _ in pairs if valid(a[1])]
    assert (r["reads_pre"], r["reads_post"], r["invalid_reads"], r["kept_in_pairs"]) == ("120", str(kept + s1), str(120 - len(seen)), str(kept))
    assert (r["bases_pre"], r["bases_post"]) == (str(sum(len(x[1]) for x in seen)), str(sum(len(x[1]) for x in out_1)))
    assert float(r["mean_length_post"]) == round(sum(len(x[1]) for x in out_1) / len(out_1), 2)
    assert float(r["bases_kept_percent"]) == round(100 * sum(len(x[1]) for x in out_1) / sum(len(x[1]) for x in seen), 4)
    assert int(r["poly_reads_trimmed"]) == sum(len(x[1]) - len(x[1].rstrip("G")) >= 10 for x in seen)
    assert int(r[f"adapter_{R1}_reads"]) == sum(windows(x[1], x[3], [R1])["adapter"][1] < len(x[1]) for x in seen) and r[f"adapter_{R2}_reads"] == "NA"
    assert grid["single", "all"]["overlap_reads_trimmed"] == "NA" and grid["single", "all"]["kept_in_pairs"] == "NA"


def test_parts_without_joining(spark, tmp_path):
    rows = spark.createDataFrame([("a.fastq", i, f"@{i}\nA\n+\nI") for i in range(20)], "file string, ordinal long, record string").repartition(4)
    assert fastq.write_files(rows, str(tmp_path), joined=False) == {"a.fastq": 20}
    parts = sorted((tmp_path / "a.fastq").iterdir())
    assert len(parts) > 1 and sum(p.read_bytes().count(b"@") for p in parts) == 20


def test_schedulers_and_folders(monkeypatch, tmp_path):
    for v in cli.SCHEDULERS:
        monkeypatch.delenv(v, raising=False)
    assert cli.thread_count(None) >= 1 and cli.thread_count(3) == 3 and cli.thread_count(0) == 1
    monkeypatch.setenv("NSLOTS", "5")
    monkeypatch.setenv("PBS_NCPUS", "many")
    assert cli.thread_count(None) == 5
    monkeypatch.setenv("PBS_NCPUS", "7")
    assert cli.thread_count(None) == 7
    one, two = cli.new_folder("file://" + str(tmp_path / "x")), cli.new_folder(str(tmp_path / "x"))
    assert one != two and len(list((tmp_path / "x").iterdir())) == 2


def test_log_and_adapter_list():
    log = cli.logged(False, TrimConfig()).getvalue().splitlines()
    named = [line.split("[PARAMETER] ")[1] for line in log if "[PARAMETER]" in line]
    assert named == sorted(named) and "adapter_group: TruSeq" in named
    assert len({line.index(s) for line in cli.adapter_list().splitlines() for s in (R1, R2) if line.endswith(s)}) == 1


def test_progress(spark):
    bar = cli.Progress(spark, 1000)
    assert bar.line() is None or "reads" in bar.line()


@pytest.mark.parametrize(("given", "want"), [("A,,C", ["A", "C"]), (" acgt ,", ["ACGT"])])
def test_empty_adapter_items(given, want):
    from readloom.functions.adapters import load

    assert [s for _, s in load(given)] == want
    with pytest.raises(ValueError):
        load(" , ")
