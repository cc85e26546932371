from collections import defaultdict

import pytest

import corpus_pipeline
from rillgrid.llm import ngram_join, toxicity
from rillgrid.llm.common import read

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returns, written and read again."""
    docs, out = read(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.cache())
    return out


def test_stages_keep_the_columns(spark, stages):
    want = read(spark, SF, "documents").dtypes
    assert len(corpus_pipeline.STAGES) == 5
    assert all(s.dtypes == want for s in stages[:-1])


def test_decisions_take_effect(spark, stages):
    docs = read(spark, SF, "documents")
    model = toxicity.fit(docs, read(spark, SF, "labels"))
    clean = {r["doc_id"] for r in toxicity.score(docs, model, "s").where("s < 0.5").collect()}
    assert {r["doc_id"] for r in stages[0].collect()} == clean
    classes = ngram_join.near_duplicates(stages[0]).collect()
    assert {r["doc_id"] for r in stages[1].collect()} == {r["class_id"] for r in classes}
    assert {r["doc_id"] for r in stages[2].collect()} == {r["doc_id"] for r in stages[1].collect()}


def test_the_last_stage_packs_all_that_was_mixed(stages):
    ends, total = defaultdict(int), defaultdict(int)
    for r in stages[4].collect():
        ends[r["sequence_id"]] = max(ends[r["sequence_id"]], r["offset"] + r["length"])
        total[r["sequence_id"]] += r["length"]
    assert ends == total and max(ends.values()) <= 4096
    assert {r["doc_id"] for r in stages[4].collect()} == {r["doc_id"] for r in stages[3].collect()}


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[4].count()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_and_empty_tables(spark, documents, rows, nothing, name):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing columns; no rows at all."""
    stage = dict(corpus_pipeline.STAGES)[name]
    made = stage(spark, documents, SF)
    got = made.collect()
    ids = {r[0] for r in rows}
    assert {r["doc_id"] for r in got} <= ids
    assert stage(spark, nothing, SF).count() == 0
    if name != "packing":
        assert made.dtypes == documents.dtypes
    if name in ("toxicity", "suffix"):
        assert len(got) == len(rows)  # none of the fixture's texts is toxic, and a cut text stays
    if name == "ngram_join":
        worded = {r[1] for r in rows if r[1] and r[1].split()}
        assert {r["text"] for r in got if r["text"] and r["text"].split()} <= worded
        assert len([r for r in got if not (r["text"] or "").split()]) == len([r for r in rows if not (r[1] or "").split()])
