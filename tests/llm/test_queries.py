"""The registered queries: against SQL where there is one, and the pipeline stage by stage."""

from __future__ import annotations

import os

import corpus_pipeline
import numpy as np
import pytest
from oracle import connect, difference

from tableload.llm.queries import QUERIES, SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), connect(SF_DIR), SQL[name]) is None


@pytest.mark.parametrize(
    ("name", "label", "parts", "held"), [("op4_quality", "quality", 3, 1), ("op10_toxicity", "toxic", 5, 0)]
)
def test_held_out_accuracy(spark, name, label, parts, held):
    scored = QUERIES[name](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    y = np.array([r[label] for r in rows])
    right = np.mean([r.predicted == r[label] for r in rows])
    assert right >= max(y.mean(), 1 - y.mean())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing",
        "token_id_output",
    ]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.staged(stage(spark, docs, SF_DIR), name)
        if name == "token_id_output":
            packed = {d for r in docs.collect() for d in r.doc_ids}
            assert packed == {r.doc_id for r in before.collect()}
            continue
        assert docs.columns == before.columns
        kept = {r.doc_id: r.text for r in docs.collect()}
        assert kept and set(kept) <= ids
        if name == "benchmark_decontamination":
            assert not [d for d, t in kept.items() for b in benchmark if b.text in t]
