"""Reads made from the ``documents`` table, so that reads can be had wherever it is: 180-letter slices become inserts.

Every letter of every text is in a slice: slice k has letters 180 k to 180 k + 179, the last one what is left. A read pair's
number is doc_id * 10**6 + k. FIXTURES.md and the queries' SQL have the same generator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SQL = r"""
with x0 as (select doc_id, upper(regexp_replace(text,'[^A-Za-z]','')) c from {docs}),
 x1 as (select doc_id, posexplode(regexp_extract_all(c,'.{1,180}',0)) as (k, t) from x0),
 x2 as (select doc_id, k, doc_id*1000000+k rid, t from x1),
 x3 as (select *, cast(least(40+rid%140,length(t)) as int) ins, translate(t,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','ACGTACGTACGTACGTNCGTACGTCA') b0, translate(reverse(t),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','HIGFHIGEHFGI5HIGDI?HGFIE;H') q from x2),
 x4 as (select doc_id,k,rid,q,ins, case when rid%29=0 then repeat('AC',90) else b0 end b,
   case when rid%11=0 then 'AGATCGGAAGAGCTCACGTCTGAACTCCAGTCA' else 'AGATCGGAAGAGCACACGTCTGAACTCCAGTCA' end a1,
   'AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT' a2 from x3),
 x5 as (select *, substr(b,1,ins) f, case when rid%31=0 then 60 else 100 end n1, case when rid%37=0 then 75 else 100 end n2 from x4),
 x6 as (select rid, doc_id%4 sample_id, k, doc_id, substr(f||a1||repeat('G',100),1,n1) s1,
   substr(translate(reverse(f),'ACGTN','TGCAN')||a2||repeat('G',100),1,n2) s2,
   rpad(substr(q,1,cast(88+rid%13 as int))||repeat('#',30),n1,'#') q1, rpad(substr(q,81,cast(80+rid%21 as int))||repeat('#',30),n2,'#') q2 from x5),
 x7 as (select rid, sample_id, k, doc_id, s1, s2, case when sample_id=3 then translate(q1,{from},{to}) else q1 end p1, case when sample_id=3 then translate(q2,{from},{to}) else q2 end p2 from x6),
 x8 as (select *, ':1:FCX:1:'||cast(doc_id as string)||':'||cast(k as string)||':7 ' h, '@V3000L1C001R003'||lpad(cast(rid as string),16,'0')||'/' g, case when rid%41=0 then 'x' else '+' end plus,
   case when rid%19=0 then substr(p1,2) else p1 end r1, case when rid%19=0 then substr(p2,2) else p2 end r2 from x7)
"""
#: Phred+33 letters and the same qualities as Phred+64 letters.
_FROM, _TO = "'#0123456789:;<=>?@ABCDEFGHIJ'", r"'BOPQRSTUVWXYZ[\]^_`abcdefghi'"
_MATE = """select cast(sample_id as bigint) sample_id, cast(rid as bigint) ordinal, {m} mate, {h}||h||'{m}:N:0:ACGT' header, g||'{m}' mgi_header, {s} seq, plus, r{m} qual from x8"""
_ONE = {"m": 1, "h": "case when rid%17=0 then 'SIM' else '@SIM' end", "s": "s1"}
_TWO = {"m": 2, "h": "'@SIM'", "s": "case when rid%23=0 then lower(s2) else s2 end"}


def duck_sql() -> str:
    """The generator in DuckDB's SQL."""
    body = _SQL.replace("{docs}", "documents").replace("'[^A-Za-z]','')", "'[^A-Za-z]','','g')").replace("as string", "as varchar").replace("{from}", _FROM).replace("{to}", _TO)
    body = body.replace("posexplode(regexp_extract_all(c,'.{1,180}',0)) as (k, t)", "unnest(range(0, len(regexp_extract_all(c,'.{1,180}')))) k, unnest(regexp_extract_all(c,'.{1,180}')) t")
    return body + " union all ".join(_MATE.format(**x) for x in (_ONE, _TWO))


def derived_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, ordinal, mate, header, mgi_header, seq, plus, qual; sample 3 is in Phred+64."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        docs = docs.repartition(spark.sparkContext.defaultParallelism)  # one small file would be one task
    # Both mates come out of one generator, so what makes them is evaluated once, whatever is done with them above.
    one, two = (
        f"named_struct('sample_id', cast(sample_id as bigint), 'ordinal', cast(rid as bigint), 'mate', {x['m']}, 'header', {x['h']}||h||'{x['m']}:N:0:ACGT', 'mgi_header', g||'{x['m']}', 'seq', {x['s']}, 'plus', plus, 'qual', r{x['m']})"
        for x in (_ONE, _TWO)
    )
    text = _SQL.replace("{from}", "r" + _FROM).replace("{to}", "r" + _TO).replace("{1,180}", "{{1,180}}")
    return spark.sql(text + f"select inline(array({one}, {two})) from x8", docs=docs)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical read columns: input_id, ordinal, mate, header, seq, plus, qual, offset (and mgi_header)."""
    return derived_reads(spark, sf_dir).select(
        F.col("sample_id").alias("input_id"), "ordinal", "mate", "header", "seq", "plus", "qual",
        F.when(F.col("sample_id") == 3, 64).otherwise(33).alias("offset"), "mgi_header",
    )
