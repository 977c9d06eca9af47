"""The pipeline's stages on the smallest tables, each judged on its own input."""

import corpus_pipeline
from tests.conftest import DATA
from tessera.llm import decontaminate, toxicity
from tessera.llm.common import table


def test_stages_take_effect_and_keep_columns(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, DATA).cache()
        assert out.columns == columns, name
        kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept[name] <= before
        docs = out
    bench = table(spark, DATA, "benchmark")
    assert decontaminate.matches(docs, bench).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == kept["decontamination"]


def test_toxic_stage_drops_what_it_scores_toxic(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = toxicity.fit(docs, labels)
    low = {r.doc_id for r in toxicity.score(docs, model).where("score < 0.5").collect()}
    assert {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, DATA).collect()} == low


def test_run_gives_packed_rows(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and out.where("length > 4096").count() == 0
