from __future__ import annotations

import re

import corpus_pipeline
from allelake.llm import queries, rules

from .conftest import SF


def test_names():
    assert {f"op{n}" for n in range(1, 11)} == {re.match(r"op\d+", q)[0] for q in queries.QUERIES}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.dtypes, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.dtypes == columns, name
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        made = spark.read.parquet(path)
        if name in ("quality classifier", "quality rules", "near duplicates"):
            assert 0 < made.count() <= before
            assert made.join(docs, ["doc_id", "text"], "left_anti").count() == 0  # rows go, none change
        if name == "quality rules":
            kept = {r.doc_id for r in rules.judge(docs).filter("kept").collect()}
            assert {r.doc_id for r in made.collect()} == kept
        if name == "repeated passages":
            assert made.count() == before
            assert all(a.n_chars == len(a.text) for a in made.collect())
        docs, before = made, made.count()


def test_rules_keep_long_documents(spark):
    text = " ".join(f"word{i}" for i in range(200_001))
    docs = spark.createDataFrame([(1, text), (2, "too short")], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()] == [1]


def test_clashing_columns(spark, clashing, nothing):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (clashing, nothing):
            assert stage(spark, docs, SF).columns == docs.columns, name
            stage(spark, docs, SF).count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
