"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, lm, media, neardup, packing, quality, tokencount, toxicity, warc
from .common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op1(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op2(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op4(table(spark, sf_dir, "pages"))


def op5_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_column(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op10(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Equal payloads of at least 100 bytes: the smallest page is the response.
OP4 = """
with p as (select page_id, coalesce(html, '') h from pages),
 d as (select page_id, strlen(h) n, sha256(h) s, min(page_id) over (partition by h) f from p)
select page_id, n::bigint payload_bytes, s payload_digest, case when n >= 100 and page_id > f then 'revisit' else 'response' end record_type,
 case when n >= 100 and page_id > f then f end refers_to from d
"""

#: Exact sizes of intersections over all pairs that share a shingle, and the smallest document that links reach.
OP8 = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') x from documents),
 s as (select distinct doc_id, array_to_string(x[i:i+4], ' ') g from (select doc_id, x, unnest(range(1, greatest(len(x)-4, 1)+1)) i from w where len(x) > 0)),
 n as (select w.doc_id, count(g) n from w left join s using (doc_id) group by w.doc_id),
 c as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b using (g) where a.doc_id < b.doc_id group by all),
 l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100*k >= 75*(x.n + y.n - k)),
 e as (select a, b from l union all select b, a from l union all select doc_id, doc_id from n),
 r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
 m as (select a doc_id, min(b) component_id from r group by a)
select n.doc_id, n.n::bigint n_shingles, component_id, n.doc_id = component_id kept from n join m using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_round_trip": OP4, "op8_near_duplicates": OP8}
