"""One query an operator over the derived reads, and the same in DuckDB's SQL, formulated independently (windows, hamming).

Scans, sinks, detection and whole runs work on FASTQ files, which are written from the derived reads once a session: sample 0
is an unpaired file, sample 1 an interleaved one, 2 (packed, under a plain name) and 3 (Phred+64) are pairs of files.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import sequences
from readloom.functions.adapters import GROUPS
from readloom.operators import filters, pairs, stats
from readloom.operators.reads import searched, single
from readloom.plans import derived, run
from readloom.plans.config import TrimConfig
from readloom.sources import discover, fastq, files

ID = ("input_id", "ordinal", "mate")
#: Options of the queries that combine modules.
FULL = TrimConfig(endqual=True, adapter=True, poly=True, overlap=True, cut=True, cut_end=1, min_length_output=30, min_average_qual_post=25)

Query = Callable[[SparkSession, str], DataFrame]
found: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None):
    def add(f: Query) -> Query:
        found[f.__name__] = f, sql
        return f

    return add


# --- SQL fragments -------------------------------------------------------------------------------------------------

_base = derived.duck_sql()
READS = f"""reads as ({_base}),
 v as (select sample_id input_id, ordinal, mate, header, mgi_header, seq, plus, qual, length(seq)::int n, case when sample_id=3 then 64 else 33 end o,
  coalesce(length(header)>1 and starts_with(header,'@') and starts_with(plus,'+') and length(seq)=length(qual)
   and regexp_full_match(seq,'[ACGTN]*') and regexp_full_match(qual,'[!-~]*'), false) valid from reads)"""
#: Every letter of valid reads.
LETTERS = "p as (select input_id, ordinal, mate, n, i, ascii(substr(qual,i::int+1,1))-o q from (select *, unnest(range(0,n)) i from v where valid))"
END = "e as (select input_id, ordinal, mate, coalesce(min(i) filter (q>=20), any_value(n))::int l, coalesce(max(i) filter (q>=20)+1, 0)::int r from p group by all)"


def adapter_cte(name: str, wanted: dict[int, list[str]], seed: int, mm: int) -> str:
    """r and hit of each valid read; wanted: adapters of each mate."""
    rows = ", ".join(f"({m},{k},'{a}')" for m, w in wanted.items() for k, a in enumerate(w))
    return f"""{name}_a(mate, k, a) as (values {rows}),
 {name}_p as (select v.input_id, v.ordinal, v.mate, v.n, k, length(a)::int la, a, seq, unnest(range(0, greatest(n-least({seed},length(a)),-1)+1)) z from v join {name}_a using (mate) where valid),
 {name}_h as (select *, least(la, n-z)::int ov from {name}_p),
 {name}_f as (select input_id, ordinal, mate, k, min(z) z from {name}_h where hamming(substr(seq,z::int+1,ov), substr(a,1,ov)) <= (ov*{mm})//la group by all),
 {name} as (select v.input_id, v.ordinal, v.mate, coalesce(min(z), any_value(n))::int r, coalesce(arg_min(k, z*1000+k), -1)::int hit from v left join {name}_f using (input_id, ordinal, mate) where valid group by all)"""


#: What the SQL expects to be searched for: TruSeq's read 1 in mate 1, its read 2 in mate 2.
TRUSEQ = ["AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT"]
MATES = {1: TRUSEQ[:1], 2: TRUSEQ[1:]}
OVERLAP = """pr as (select a.input_id, a.ordinal, a.n n1, b.n n2, replace(a.seq,'N','x') s1, replace(translate(reverse(b.seq),'ACGTN','TGCAN'),'N','y') s2
   from v a join v b on a.input_id=b.input_id and a.ordinal=b.ordinal and a.mate=1 and b.mate=2 where a.valid and b.valid),
 po as (select *, unnest(range(50, least(n1,n2,greatest(n1,n2)-1)+1)) i from pr),
 ph as (select *, hamming(substr(s1,1,i::int), substr(s2,(n2-i+1)::int,i::int)) d from po),
 ins as (select input_id, ordinal, max(i)::int size from ph where d<=5 and 100*d<=i*4 group by all)"""
#: The combined run on pairs: windows of every module, merged.
RUN = f"""{READS}, {LETTERS}, {END}, {adapter_cte('ad', MATES, 6, 2)}, {OVERLAP},
 w as (select v.*, e.l e_l, e.r e_r, ad.r a_r, hit, least(n, case when length(regexp_extract(seq,'G+$'))>=10 then n-length(regexp_extract(seq,'G+$')) else n end)::int p_r,
   greatest(n-1,0)::int c_r, coalesce(size, n)::int o_r
   from v left join e using (input_id, ordinal, mate) left join ad using (input_id, ordinal, mate) left join ins using (input_id, ordinal)),
 m as (select *, case when valid then greatest(0, e_l) end l, case when valid then least(n, e_r, a_r, p_r, c_r, o_r) end r from w),
 qs as (select input_id, ordinal, mate, sum(q)::bigint qi, coalesce(sum(q) filter (i>=m.l and i<m.r),0)::bigint qo from p join m using (input_id, ordinal, mate) group by all),
 k as (select m.*, coalesce(qi,0) qi, coalesce(qo,0) qo, coalesce(valid and r-l>=30 and qo>=25*(r-l), false) keep from m left join qs using (input_id, ordinal, mate)),
 j as (select a.input_id, a.ordinal, a.keep ka, b.keep kb from k a join k b on a.input_id=b.input_id and a.ordinal=b.ordinal and a.mate=1 and b.mate=2),
 z as (select k.*, case when not valid then 'rejected_invalid' when not keep then 'rejected_filtered' when ka and kb then 'paired' when mate=1 then 'single_r1' else 'single_r2' end route from k join j using (input_id, ordinal))"""


def _with(*parts: str, select: str) -> str:
    return "with " + ", ".join(parts) + " " + select


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.reads(spark, sf_dir)


_folders: dict[tuple[str, str], str] = {}


def _fastq(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """name: path of the FASTQ files, written with the library's sink; a session writes those of a table once."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _folders:
        folder, r = files.shared_folder(spark), _reads(spark, sf_dir)
        rows = r.where("input_id > 0 OR mate = 1").select(
            _name().alias("file"), F.when(F.col("input_id") == 1, 2 * F.col("ordinal") + F.col("mate")).otherwise(F.col("ordinal")).alias("ordinal"), "input_id",
            sequences.fastq_record(F.col("header"), F.col("seq"), F.col("plus"), F.col("qual")).alias("record"),
        )
        rows, path = files.stored(rows)  # sampled and read for each of the sinks: the reads are derived once
        try:
            fastq.write_files(rows.where("input_id <> 2"), folder, None, True)
            fastq.write_files(rows.where("input_id = 2"), folder, 1, True)
        finally:
            files.remove(spark, path)
        _folders[key] = folder
    return {n: f"{_folders[key]}/{n}.fastq" for n in ("s0", "s1", "s2_R1", "s2_R2", "s3_R1", "s3_R2")}


def _name():
    stem = F.concat(F.lit("s"), F.col("input_id").cast("string"))
    return F.concat(F.when(F.col("input_id") < 2, stem).otherwise(F.concat(stem, F.lit("_R"), F.col("mate").cast("string"))), F.lit(".fastq"))


def _inputs(spark: SparkSession, sf_dir: str) -> run.Inputs:
    """The files as the headers tell what they are."""
    couples, mixed, alone, _ = discover.detect(list(_fastq(spark, sf_dir).values()))
    return run.Inputs(alone, couples, mixed)


#: Records of the files, with their places.
FILES = """fl as (select *, 's'||input_id||case when input_id<2 then '' else '_R'||mate end||'.fastq' file from v where input_id>0 or mate=1),
 fr as (select *, row_number() over (partition by file order by ordinal, mate)-1 pos from fl)"""


def _single(spark: SparkSession, sf_dir: str, sums: bool = False, **options) -> DataFrame:
    """Valid reads through one configuration; adapters as for their mates' unpaired search."""
    return single(_reads(spark, sf_dir), TrimConfig(**options).validate(), 0, sums).where("valid")


def _window(df: DataFrame, module: str) -> DataFrame:
    return df.select(*ID, F.col(f"w_{module}.l").alias("l"), F.col(f"w_{module}.r").alias("r"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.processed(pairs.aligned(_reads(spark, sf_dir)), FULL, True)


def _mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.as_reads(_pairs(spark, sf_dir), FULL, True)


# --- Filters -------------------------------------------------------------------------------------------------------


@query(_with(READS, select="select input_id, mate, count(*) reads, count(*) filter (valid) valid_reads, count(*) filter (not valid) invalid_reads from v group by all"))
def validate_counts(spark, sf_dir):
    ok = filters.well_formed(*map(F.col, ("header", "seq", "plus", "qual")))
    return _reads(spark, sf_dir).groupBy("input_id", "mate").agg(F.count("*").alias("reads"), F.count_if(ok).alias("valid_reads"), F.count_if(~ok).alias("invalid_reads"))


def _valid(spark, sf_dir, **options):
    ok = filters.valid(TrimConfig(**options), *map(F.col, ("header", "seq", "plus", "qual")))
    return _reads(spark, sf_dir).select(*ID, ok.alias("valid"))


@query(_with(READS, select="select input_id, ordinal, mate, valid and position('N' in seq)=0 as valid from v"))
def n_filter(spark, sf_dir):
    return _valid(spark, sf_dir, n_filter=True)


@query(_with(READS, select="select input_id, ordinal, mate, valid and n between 70 and 90 as valid from v"))
def input_length(spark, sf_dir):
    return _valid(spark, sf_dir, min_length_input=70, max_length_input=90)


@query(_with(READS, LETTERS, select="select input_id, ordinal, mate, (sum(q)>=38*count(*)) as keep from p group by all"))
def avgqual_pre(spark, sf_dir):
    return _single(spark, sf_dir, min_average_qual_pre=38).select(*ID, "keep")


def _kmers(k: int) -> str:
    return f"k{k} as (select input_id, ordinal, mate, any_value(n) n, count(distinct substr(seq,i::int+1,{k})) d from (select *, unnest(range(0,n-{k}+1)) i from v where valid) group by all)"


@query(_with(READS, _kmers(4), select="select input_id, ordinal, mate, 100*d>=50*least(n-3,625) as keep from k4"))
def kmer_filter(spark, sf_dir):
    return _single(spark, sf_dir, kmer=True).select(*ID, "keep")


@query(_with(READS, _kmers(2), _kmers(3), select="select input_id, ordinal, mate, 100*k2.d>=45*least(k2.n-1,25) and 100*k3.d>=45*least(k3.n-2,125) as keep from k2 join k3 using (input_id, ordinal, mate)"))
def kmer_multi(spark, sf_dir):
    return _single(spark, sf_dir, kmer=True, kmer_size="2,3", kmer_cutoff=45).select(*ID, "keep")


@query(_with(READS, LETTERS, END, select="select input_id, ordinal, mate, (any_value(e.r)>any_value(e.l) and coalesce(sum(q) filter (i>=e.l and i<e.r),0)>=39*(any_value(e.r)-any_value(e.l))) as keep from p join e using (input_id, ordinal, mate) group by input_id, ordinal, mate"))
def avgqual_post(spark, sf_dir):
    return _single(spark, sf_dir, endqual=True, min_average_qual_post=39).select(*ID, "keep")


@query(_with(READS, LETTERS, END, select="select input_id, ordinal, mate, (r-l between 80 and 95 and r>l) as keep from e"))
def output_length_abs(spark, sf_dir):
    return _single(spark, sf_dir, endqual=True, min_length_output=80, max_length_output=95).select(*ID, "keep")


@query(_with(READS, LETTERS, END, select="select input_id, ordinal, mate, (r>l and r-l>=n*85//100 and r-l<=97) as keep from e join v using (input_id, ordinal, mate)"))
def output_length_perc(spark, sf_dir):
    return _single(spark, sf_dir, endqual=True, min_length_output_perc=85, max_length_output_perc=10, max_length_output=97).select(*ID, "keep")


# --- Windows -------------------------------------------------------------------------------------------------------


@query(_with(READS, select="select input_id, ordinal, mate, least(7,n)::int l, greatest(n-60,0)::int r from v where valid"))
def cut_ends(spark, sf_dir):
    return _window(_single(spark, sf_dir, cut=True, cut_start=7, cut_both=60), "cut")


@query(_with(READS, LETTERS, END, select="select input_id, ordinal, mate, l, r, r>l as keep, case when r>l then substr(seq,l+1,r-l) else seq end out_seq, case when r>l then substr(qual,l+1,r-l) else qual end out_qual from e join v using (input_id, ordinal, mate)"))
def endqual_trim(spark, sf_dir):
    return _single(spark, sf_dir, endqual=True).select(*ID, F.col("w_endqual.l").alias("l"), F.col("w_endqual.r").alias("r"), "keep", "out_seq", "out_qual")


def _slider(window: int, quality: int, step: int) -> str:
    return f"""s1 as (select *, sum(q) over (partition by input_id, ordinal, mate order by i rows between {window - 1} preceding and current row) s, i-{window - 1} st from p),
 s2 as (select *, case when st>=0 and (st%{step}=0 or st=n-{window}) and s<{quality * window} then 1 else 0 end f from s1),
 s3 as (select *, max(f) over (partition by input_id, ordinal, mate order by i rows between current row and {window - 1} following) bad from s2),
 s4 as (select *, i-row_number() over (partition by input_id, ordinal, mate order by i) g from s3 where bad=0),
 s5 as (select input_id, ordinal, mate, g, min(i) l, max(i)+1 r, sum(q) t from s4 group by all),
 s6 as (select *, row_number() over (partition by input_id, ordinal, mate order by r-l desc, t desc, l) k from s5)"""


_slid = "select input_id, ordinal, mate, case when n<{0} then 0 else coalesce(l,0) end::int l, case when n<{0} then n else coalesce(r,0) end::int r from v left join (select * from s6 where k=1) using (input_id, ordinal, mate) where valid"


@query(_with(READS, LETTERS, _slider(5, 36, 1), select=_slid.format(5)))
def slider_trim(spark, sf_dir):
    return _window(_single(spark, sf_dir, slider=True, slider_quality=36), "slider")


@query(_with(READS, LETTERS, _slider(7, 36, 3), select=_slid.format(7)))
def slider_step(spark, sf_dir):
    return _window(_single(spark, sf_dir, slider=True, slider_window=7, slider_quality=36, slider_step=3), "slider")


@query(_with(READS, select="select input_id, ordinal, mate, 0::int l, (n-case when length(regexp_extract(seq,'G+$'))>=10 then length(regexp_extract(seq,'G+$')) else 0 end)::int r from v where valid"))
def poly_end(spark, sf_dir):
    return _window(_single(spark, sf_dir, poly=True), "poly")


_run = "greatest(length(regexp_extract(seq,'{0}')),length(regexp_extract(seq,'{1}')))"


@query(_with(READS, f"h as (select *, {_run.format('^A+', '^C+')} x, {_run.format('G+$', 'T+$')} y from v where valid)", select="select input_id, ordinal, mate, case when x>=2 then x else 0 end::int l, (n-case when y>=3 then y else 0 end)::int r from h"))
def poly_both_ends(spark, sf_dir):
    return _window(_single(spark, sf_dir, poly=True, poly_bases_start="a,C", poly_length_start=2, poly_bases_end="G,T", poly_length_end=3), "poly")


_hit = "select input_id, ordinal, mate, r, hit from ad"


def _adapter(df: DataFrame) -> DataFrame:
    return df.select(*ID, F.col("w_adapter.r").alias("r"), "hit")


@query(_with(READS, adapter_cte("ad", {1: TRUSEQ, 2: TRUSEQ}, 6, 0), select=_hit))
def adapter_exact(spark, sf_dir):
    return _adapter(_single(spark, sf_dir, adapter=True, adapter_mismatch=0))


@query(_with(READS, adapter_cte("ad", {1: TRUSEQ, 2: TRUSEQ}, 10, 3), select=_hit))
def adapter_mismatch(spark, sf_dir):
    return _adapter(_single(spark, sf_dir, adapter=True, adapter_mismatch=3, adapter_seed=10))


_many = ["CTGTCTCTTATACACATCT", *TRUSEQ, "GATCGG", "ACGTNACG"]


@query(_with(READS, adapter_cte("ad", {1: _many, 2: _many}, 8, 1), select=_hit))
def adapter_multi_hit(spark, sf_dir):
    return _adapter(_single(spark, sf_dir, adapter=True, adapter_mismatch=1, adapter_seed=8, adapter_group=("Nextera", "TruSeq"), adapter_add="gatcgg,ACGTNACG"))


@query(_with(READS, OVERLAP, select="select input_id, ordinal, size from pr left join ins using (input_id, ordinal)"))
def overlap_insert(spark, sf_dir):
    return _pairs(spark, sf_dir).where("a_valid AND b_valid").select("input_id", "ordinal", F.col("insert").alias("size"))


@query(_with(RUN, select="select input_id, ordinal, mate, l::int l, r::int r, keep, route from z"))
def merge_windows(spark, sf_dir):
    return _mates(spark, sf_dir).select(*ID, "l", "r", "keep", "route")


@query(_with(READS.replace("false) valid from reads", "false) and position('N' in seq)=0 valid from reads"), LETTERS, END, adapter_cte("ad", MATES, 6, 2),
             select="select input_id, ordinal, mate, l, least(e.r, ad.r) r, least(e.r,ad.r)-l>=greatest(1,n*33//100) as keep from v join e using (input_id, ordinal, mate) join ad using (input_id, ordinal, mate)"))
def full_auto(spark, sf_dir):
    cfg = TrimConfig.full_auto()
    return pairs.as_reads(pairs.processed(pairs.aligned(_reads(spark, sf_dir)), cfg), cfg).where("valid").select(*ID, "l", "r", "keep")


# --- Functions -----------------------------------------------------------------------------------------------------


@query(_with(READS, """c as (select *, unnest(range(0,length(qual))) i from v where valid), d as (select *, ascii(substr(qual,i::int+1,1)) b from c)""",
             select="select input_id, ordinal, mate, string_agg(case when o=33 then chr(b) else case when b>=59 then chr(greatest(33,b-31)) else chr(b) end end, '' order by i) to_33, string_agg(case when o=64 then chr(b) else chr(least(126,b+31)) end, '' order by i) to_64 from d group by all"))
def phred_convert(spark, sf_dir):
    df = _single(spark, sf_dir).where("length(qual) > 0")
    return df.select(*ID, sequences.phred_convert(F.col("qual"), F.col("offset"), 33).alias("to_33"), sequences.phred_convert(F.col("qual"), F.col("offset"), 64).alias("to_64"))



@query(_with(READS, select=r"""select input_id, ordinal, mate, '@M1:7:' || x[1] || ':' || x[2]::bigint || ':' || x[5]::bigint || ':' || x[3]::bigint || ':' || x[4]::bigint || ' ' || x[6] || ':N:0:GGG+AAA' header
 from (select *, string_split(regexp_replace(mgi_header,'^@([A-Za-z0-9_]+)L([0-9]+)C([0-9]+)R([0-9]{3})([0-9]+)/([12])','\1,\2,\3,\4,\5,\6'),',') x from v)"""))
def mgi_header(spark, sf_dir):
    made = sequences.mgi_header(F.col("mgi_header"), "AAA", "GGG", "M1", "7")
    return _reads(spark, sf_dir).select(*ID, made.alias("header"))


@query(_with(READS, select="select input_id, ordinal, mate, list_aggregate(list_transform(list_reverse(string_split(seq,'')), lambda x: case x when 'A' then 'T' when 'T' then 'A' when 'C' then 'G' when 'G' then 'C' else x end), 'string_agg', '') revcomp from v where valid and n>0"))
def revcomp(spark, sf_dir):
    return _single(spark, sf_dir).where("length(seq) > 0").select(*ID, sequences.reverse_complement(F.col("seq")).alias("revcomp"))


_headers = "select input_id, ordinal, mate, string_split(h,' ')[1] base, case when string_split(h,' ')[2][1:1] in ('1','2') then string_split(h,' ')[2][1:1]::int end read_no from (select *, header h from v) union all select input_id, ordinal, mate, regexp_replace(h,'/[12]$','') base, right(h,1)::int from (select *, mgi_header h from v)"


@query(_with(READS, select=_headers))
def header_parse(spark, sf_dir):
    r = _reads(spark, sf_dir)
    both = r.select(*ID, F.col("header").alias("h")).unionAll(r.select(*ID, "mgi_header"))
    return both.select(*ID, sequences.header_base(F.col("h")).alias("base"), sequences.header_mate(F.col("h")).alias("read_no"))


@query(_with(READS, FILES, select="select file, pos ordinal, header, seq, plus, qual from fr"))
def file_scan(spark, sf_dir):
    """Plain files in ranges of 64 KB, packed ones told by content; places from line counts."""
    paths = _fastq(spark, sf_dir)
    names = F.create_map(*(x for k, n in enumerate(paths) for x in (F.lit(k).cast("long"), F.lit(f"{n}.fastq"))))
    rows = fastq.read_fastq(spark, [(k, 0, path) for k, path in enumerate(paths.values())], 1 << 16)
    return rows.select(names[F.col("input_id")].alias("file"), "ordinal", "header", "seq", "plus", "qual")


@query(_with(READS, FILES, "b as (select file, ascii(substr(qual,i::int+1,1)) b from (select *, unnest(range(0,length(qual))) i from fr where pos<500))", select="select file, case when min(b)<64 then 33 when max(b)<=104 then 64 end::int phred_offset from b group by all"))
def phred_detect(spark, sf_dir):
    return spark.createDataFrame([(f"{n}.fastq", fastq.phred_offset(path, 500)) for n, path in _fastq(spark, sf_dir).items()], "file string, phred_offset int")


@query(_with(READS, FILES, """h as (select file, pos, string_split(header,' ')[1] base, string_split(header,' ')[2][1:1] no from fr where pos<2),
 f as (select file, any_value(base) filter (pos=0) base, any_value(no) filter (pos=0) no, count(*)=2 and count(distinct base)=1 mixed from h group by file),
 g as (select base, count(*)=2 and list_sort(list(no))=['1','2'] pair from f group by base)""",
             select="select file, case when pair then 'paired' when mixed then 'interleaved' else 'unpaired' end kind from f join g using (base)"))
def file_pairing(spark, sf_dir):
    found = _inputs(spark, sf_dir)
    kinds = {"paired": [f for pair in found.paired for f in pair], "interleaved": found.interleaved, "unpaired": found.unpaired}
    return spark.createDataFrame([(f.rsplit("/", 1)[-1], kind) for kind, paths in kinds.items() for f in paths], "file string, kind string")


# --- Pairs and routes ----------------------------------------------------------------------------------------------


@query(_with(READS, select="select a.input_id, a.ordinal, a.seq seq_1, b.seq seq_2 from v a join v b on a.input_id=b.input_id and a.ordinal=b.ordinal where a.mate=1 and b.mate=2"))
def mate_alignment(spark, sf_dir):
    return pairs.aligned(_reads(spark, sf_dir)).select("input_id", "ordinal", F.col("a_seq").alias("seq_1"), F.col("b_seq").alias("seq_2"))


@query(_with(RUN, select="select input_id, ordinal, mate, route, case when keep then substr(seq,l::int+1,(r-l)::int) else seq end out_seq, case when keep then substr(qual,l::int+1,(r-l)::int) else qual end out_qual from z"))
def pair_reconcile(spark, sf_dir):
    return _mates(spark, sf_dir).select(*ID, "route", "out_seq", "out_qual")


@query(_with(RUN, select="select input_id, count(*) filter (ka and kb) kept_pairs, count(*) filter (ka and not kb) kept_r1_singletons, count(*) filter (kb and not ka) kept_r2_singletons, count(*) filter (not ka) rejected_r1, count(*) filter (not kb) rejected_r2 from j group by all"))
def pair_route_counts(spark, sf_dir):
    return stats.kept_counts(_pairs(spark, sf_dir))


@query(_with(READS, FILES, select="select (pos//2)::bigint ordinal, (pos%2+1)::int mate, header, seq from fr where file='s1.fastq'"))
def interleave_split(spark, sf_dir):
    whole = fastq.read_fastq(spark, [(0, 0, _fastq(spark, sf_dir)["s1"])], 1 << 16)
    return pairs.interleaved(whole).select("ordinal", "mate", "header", "seq")


_text = "header || chr(10) || substr(seq,l::int+1,(r-l)::int) || chr(10) || plus || chr(10) || substr(qual,l::int+1,(r-l)::int)"


@query(_with(RUN, select=f"select input_id, ordinal, string_agg({_text}, chr(10) order by mate) record from z where route='paired' group by all"))
def interleaved_out(spark, sf_dir):
    p = _pairs(spark, sf_dir).where("route = 'paired'")
    one, two = (sequences.fastq_record(F.col(x + "header"), F.col(x + "out_seq"), F.col(x + "plus"), F.col(x + "out_qual")) for x in ("a_", "b_"))
    return p.select("input_id", "ordinal", F.concat_ws("\n", one, two).alias("record"))


@query(_with(RUN, select="select input_id, ordinal, mate, route, header || chr(10) || seq || chr(10) || plus || chr(10) || qual record from z where starts_with(route,'rejected')"))
def rejected_reads(spark, sf_dir):
    m = _mates(spark, sf_dir).where(F.startswith("route", F.lit("rejected")))
    return m.select(*ID, "route", sequences.fastq_record(F.col("header"), F.col("out_seq"), F.col("plus"), F.col("out_qual")).alias("record"))


# --- Statistics ----------------------------------------------------------------------------------------------------


@query(_with(RUN, select="select input_id, mate, count(*) filter (not valid) invalid, count(*) filter (valid) reads_in, coalesce(sum(n) filter (valid),0)::bigint bases_in, coalesce(sum(qi) filter (valid),0)::bigint qual_sum_in from z group by all"))
def stats_input(spark, sf_dir):
    return stats.totals(_mates(spark, sf_dir)).select("input_id", "mate", "invalid", "reads_in", "bases_in", "qual_sum_in")


@query(_with(RUN, select="select input_id, mate, count(*) filter (keep) reads_out, coalesce(sum(r-l) filter (keep),0)::bigint bases_out, coalesce(sum(qo) filter (keep),0)::bigint qual_sum_out, count(*) filter (valid and not keep) rejected_after_trim from z group by all"))
def stats_output(spark, sf_dir):
    return stats.totals(_mates(spark, sf_dir)).select("input_id", "mate", "reads_out", "bases_out", "qual_sum_out", "rejected_after_trim")


_bins = """hb as (select input_id, mate, 'len_in' kind, n::bigint bin from z where valid union all select input_id, mate, 'len_out', r-l from z where keep
 union all select input_id, mate, 'rq_in', floor(qi/greatest(n,1)*10+1e-9)::bigint from z where valid union all select input_id, mate, 'rq_out', floor(qo/(r-l)*10+1e-9)::bigint from z where keep)"""


@query(_with(RUN, _bins, select="select input_id, mate, kind, bin, count(*) n from hb where starts_with(kind,'len') group by all"))
def length_histogram(spark, sf_dir):
    return stats.histograms(_mates(spark, sf_dir)).where(F.startswith("kind", F.lit("len")))


def _median(kind: str) -> str:
    return f"select input_id, mate, kind, list_sort(list(bin))[count(*)//2+1] median from hb where starts_with(kind,'{kind}') group by all"


@query(_with(RUN, _bins, select=_median("len")))
def length_median(spark, sf_dir):
    return stats.medians(stats.histograms(_mates(spark, sf_dir))).where(F.startswith("kind", F.lit("len")))


@query(_with(RUN, _bins, select=_median("rq")))
def read_qual_median(spark, sf_dir):
    return stats.medians(stats.histograms(_mates(spark, sf_dir))).where(F.startswith("kind", F.lit("rq")))


_mods = """mw as (select input_id, mate, n, l, r, unnest([{'m':'poly','a':0,'b':p_r},{'m':'adapter','a':0,'b':a_r},{'m':'endqual','a':e_l,'b':e_r},{'m':'cut','a':0,'b':c_r},{'m':'overlap','a':0,'b':o_r}]) x from z where valid),
 mb as (select *, least(x.a+n-x.b, n) b, (x.a>0 and x.a=l) or (x.b<n and x.b=r) s from mw)"""
_counted = "select input_id, mate, x.m as module, count(*) filter (b>0) reads, sum(b)::bigint bases, count(*) filter (b>0 and s) decisive_reads from mb group by all"


@query(_with(RUN, _mods, select=_counted))
def module_stats(spark, sf_dir):
    return stats.module_counters(_mates(spark, sf_dir), FULL.modules(1))


_hits = "select z.input_id, z.mate, a adapter, count(*) filter (hit=k) reads from z join ad_a on ad_a.mate=z.mate where valid group by all"


@query(_with(RUN, select=_hits))
def adapter_hits(spark, sf_dir):
    return stats.adapter_hits(_mates(spark, sf_dir), FULL)


_grid = f""", {_bins}, mc as ({_counted}), ah as ({_hits}),
 t as (select input_id, mate, count(*) reads_pre, count(*) filter (not valid) invalid_reads, count(*) filter (valid and not keep) rejected_after_trimming, count(*) filter (not keep) reads_lost,
  count(*) filter (keep) reads_post, count(*) filter (route='paired') kept_in_pairs, count(*) filter (route like 'single%') kept_as_singletons, sum(n) filter (valid)::bigint bases_pre, sum(r-l) filter (keep)::bigint bases_post,
  100.0::double*count(*) filter (keep)/count(*) reads_kept_percent, 100.0::double*(sum(r-l) filter (keep))/(sum(n) filter (valid)) bases_kept_percent,
  (sum(n) filter (valid))::double/count(*) filter (valid) mean_length_pre, (sum(r-l) filter (keep))::double/count(*) filter (keep) mean_length_post,
  (sum(qi) filter (valid))::double/(sum(n) filter (valid)) mean_base_qual_pre, (sum(qo) filter (keep))::double/(sum(r-l) filter (keep)) mean_base_qual_post,
  round(sum(qi::double/greatest(n,1)) filter (valid)/count(*) filter (valid), 6) mean_read_qual_pre, round(sum(qo::double/(r-l)) filter (keep)/count(*) filter (keep), 6) mean_read_qual_post from z group by all),
 md as (select input_id, mate, kind, list_sort(list(bin))[count(*)//2+1] median from hb group by all),
 mp as (select input_id, mate, max(median) filter (kind='len_in') median_length_pre, max(median) filter (kind='len_out') median_length_post,
  (max(median) filter (kind='rq_in'))/10.0::double median_read_qual_pre, (max(median) filter (kind='rq_out'))/10.0::double median_read_qual_post from md group by all),
 ap as (select input_id, mate, {", ".join(f"max(reads) filter (adapter='{a}') adapter_{a}_reads" for a in TRUSEQ)} from ah group by all)"""
_per_module = ", ".join(
    f"max(reads) filter (module='{m}') {m}_reads_trimmed, 100.0::double*max(reads) filter (module='{m}')/any_value(reads_pre-invalid_reads) {m}_reads_trimmed_percent, max(bases) filter (module='{m}') {m}_bases_trimmed, "
    f"100.0::double*max(bases) filter (module='{m}')/any_value(bases_pre) {m}_bases_trimmed_percent, max(decisive_reads) filter (module='{m}') {m}_decisive_reads"
    for m in ("poly", "adapter", "endqual", "cut", "overlap")
)


@query(_with(RUN, _mods, select="X").replace(" X", _grid + f", mv as (select input_id, mate, {_per_module} from t join mc using (input_id, mate) group by all) select * from t join mp using (input_id, mate) join mv using (input_id, mate) join ap using (input_id, mate)"))
def summary_grid(spark, sf_dir):
    """Every column of the grid. Means of means are sums of doubles, so they are rounded."""
    mates, _ = files.stored(_mates(spark, sf_dir).drop("header", "plus", "qual", "out_seq", "out_qual"))  # read by every part of the grid
    grid = stats.summary_grid(mates, FULL, FULL.modules(1))
    return grid.withColumns({c: F.round(c, 6) for c in ("mean_read_qual_pre", "mean_read_qual_post")})


# --- Whole runs over files: order, limits, unions, routes ----------------------------------------------------------


_loaded = """u as (select 's0' stem, 'unpaired' kind, pos ordinal, 0 mate, header, seq, 33 o from fr where file='s0.fastq' union all
 select 's1', 'interleaved', (pos//2)::bigint, (pos%2+1)::int, header, seq, 33 from fr where file='s1.fastq' union all
 select 's'||input_id, 'paired', pos, mate, header, seq, o from fr where input_id>=2)"""


def _loaded_rows(spark: SparkSession, sf_dir: str, cfg: TrimConfig, threads: int = 1) -> DataFrame:
    """stem, kind, ordinal, mate, header, seq, offset of what a run reads."""
    items = run.plan_items(_inputs(spark, sf_dir), cfg)
    unpaired, couples = run.load(spark, items, 1 << 16, run.first_of(cfg, threads))
    known = spark.createDataFrame([(i.number, i.stem, i.kind) for i in items], "input_id long, stem string, kind string")
    mates = couples.select("input_id", "ordinal", F.explode(F.array(*(F.struct(F.lit(m).alias("mate"), *(F.col(p + c).alias(c) for c in ("header", "seq", "offset"))) for m, p in ((1, "a_"), (2, "b_"))))).alias("x"))
    rows = unpaired.select("input_id", "ordinal", "mate", "header", "seq", "offset").unionByName(mates.select("input_id", "ordinal", "x.*"))
    return rows.join(F.broadcast(known), "input_id").select("stem", "kind", "ordinal", "mate", "header", "seq", F.col("offset").alias("o"))


@query(_with(READS, FILES, _loaded, select="select * from u"))
def input_union(spark, sf_dir):
    return _loaded_rows(spark, sf_dir, TrimConfig())


@query(_with(READS, FILES, _loaded, select="select stem, ordinal, mate, header from u where ordinal<60 order by stem, ordinal, mate"))
def ordered_first_n(spark, sf_dir):
    """A test run's records, the first chunk of each of four threads, in order."""
    return _loaded_rows(spark, sf_dir, TrimConfig(testrun=True, chunk_size=15), 4).select("stem", "ordinal", "mate", "header").orderBy("stem", "ordinal", "mate")


def _written(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """file, ordinal, record lines of what a run over the paired and interleaved files writes."""
    folder, found = files.shared_folder(spark), _inputs(spark, sf_dir)
    cfg = dataclasses.replace(FULL, ordered_output=True, **options)
    inputs = run.Inputs(paired=found.paired, interleaved=found.interleaved)
    names = [n for names in run.outputs(run.plan_items(inputs, cfg), cfg).values() for n in names]
    run.run(spark, cfg, inputs, folder, 1 << 16)
    known = F.create_map(*(x for k, n in enumerate(names) for x in (F.lit(k).cast("long"), F.lit(n.split(".")[0]))))
    return fastq.read_fastq(spark, [(k, 0, f"{folder}/{n}") for k, n in enumerate(names)]).select(known[F.col("input_id")].alias("file"), "ordinal", "header", "seq", "plus", "qual")


_cut = "case when route like 'rejected%' then {0} else substr({0},l::int+1,(r-l)::int) end {0}"
_out = f"o as (select 's'||input_id||case when route='paired' then {{0}} when route like 'single%' then '_R'||mate||'_unpaired_filtered' else {{1}} end file, ordinal rid, mate, header, {_cut.format('seq')}, plus, {_cut.format('qual')}, z.n from z where input_id>0)"


@query(_with(RUN, _out.format("'_R'||mate||'_paired_filtered'", "'_R'||mate||'_rejected'"), select="select file, row_number() over (partition by file order by rid)-1 ordinal, header, seq, plus, qual from o"))
def run_outputs(spark, sf_dir):
    """Packed files of pairs, singletons and rejected reads."""
    return _written(spark, sf_dir, write_rejected=True, gzip=True)


@query(_with(RUN, _out.format("'_interleaved_filtered'", "'_rejected'"), select="select file, row_number() over (partition by file order by rid, mate)-1 ordinal, header, seq, plus, qual from o where file like '%interleaved%'"))
def run_interleaved(spark, sf_dir):
    """Pairs in one file, singletons not written."""
    return _written(spark, sf_dir, interleaved_out=True, discard_singles=True)


# --- Adapters ------------------------------------------------------------------------------------------------------

#: The built-in table, written out for the comparison.
_table = """('AmpliSeq','AmpliSeq','CTGTCTCTTATACACATCT',0), ('Illumina_miRNA','Illumina_miRNA','AGATCGGAAGAGCACACGTCTGAACTCCAGTCA',1), ('Illumina_RNA','Illumina_RNA','ACTGTCTCTTATACACATCT',2),
 ('Nextera','Nextera','CTGTCTCTTATACACATCT',3), ('TruSeq','Read 1','AGATCGGAAGAGCACACGTCTGAACTCCAGTCA',4), ('TruSeq','Read 2','AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT',5),
 ('TruSeq_DNA_methylation','Read 1','AGATCGGAAGAGCACACGTCTGAAC',6), ('TruSeq_DNA_methylation','Read 2','AGATCGGAAGAGCGTCGTGTAGGGA',7),
 ('TruSeq_Ribo_profile','TruSeq_Ribo_profile','AGATCGGAAGAGCACACGTCT',8), ('TruSeq_small_RNA','TruSeq_small_RNA','TGGAATTCTCGGGTGCCAAGG',9)"""


@query(f"select g group_name, n name, s seq, k::int priority from (values {_table}) t(g,n,s,k)")
def adapter_table(spark, sf_dir):
    rows = [(g, n, s, k) for k, (g, n, s) in enumerate((g, n, s) for g, e in GROUPS.items() for n, s in e)]
    return spark.createDataFrame(rows, "group_name string, name string, seq string, priority int")


#: By the rules: equal sequences once; a sequence that chosen groups have for the other mate only goes; lists for mates win.
_lists = f"""with a(g,n,s,k) as (values {_table}),
 every as (select s, min(k) k, count(*) filter (n<>'Read 2')>0 one, count(*) filter (n<>'Read 1')>0 two from a group by s),
 truseq as (select s, k, n='Read 1' one, n='Read 2' two from a where g='TruSeq'),
 more as (select * from truseq union all values ('GGG',100,true,true), ('ACGT',101,true,true)),
 wanted as (select 'all' options, * from every union all select 'default', * from truseq union all select 'add', * from more
  union all values ('only','TTTT',0,true,true), ('mate 1','AC',0,true,false))
select options, mate::int mate, (row_number() over (partition by options, mate order by k)-1)::int place, s seq from wanted, (values (0),(1),(2)) m(mate) where mate=0 or (mate=1 and one) or (mate=2 and two)"""


@query(_lists)
def adapter_lists(spark, sf_dir):
    """What is searched for in unpaired reads and in either mate, under several options."""
    variants = {"default": {}, "all": {"adapter_group": ("all",)}, "add": {"adapter_add": "ggg,,ACGT,"}, "only": {"adapter_excl": "tttt"}, "mate 1": {"adapter_read_1": "AC"}}
    rows = [(name, mate, k, seq) for name, options in variants.items() for mate in (0, 1, 2) for k, seq in enumerate(searched(TrimConfig(adapter=True, **options), mate))]
    return spark.createDataFrame(rows, "options string, mate int, place int, seq string")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in found.items() if sql}
