"""Each stage on its own input, and the whole."""

import corpus_pipeline as pipeline
from readloom.llm import neardup, quality, toxicity
from readloom.llm.common import table

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents").cache()
    steps = dict(pipeline.STAGES)
    assert list(steps) == ["toxicity", "quality", "near_duplicates", "packing"]
    every = {r.doc_id for r in docs.collect()}
    kept = steps["toxicity"](spark, docs, SF)
    assert kept.columns == docs.columns
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in toxicity.score(docs, model).collect() if not r.predicted} < every
    kept = steps["quality"](spark, docs, SF)
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    left = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and sum(labels[i] == 1 and i not in left for i in every & set(labels)) <= 2
    assert left == {r.doc_id for r in quality.op1(docs).collect() if r.keep}
    kept = steps["near_duplicates"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in neardup.near_duplicates(docs).collect() if r.kept}
    assert {r.doc_id for r in steps["packing"](spark, docs, SF).collect()} == every


def test_run(spark):
    rows = pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_stages_take_empty_and_null_rows(spark, docs):
    odd = docs([None, "", "word " * 30]).selectExpr("doc_id", "text", "'en' lang", "'s' source", "n n_chars")
    for frame in (odd, odd.where("false")):
        now = frame
        for _, stage in pipeline.STAGES:
            now = stage(spark, now, "/root/testdata/sf0.001")
        now.collect()
