"""The pipeline on sf0.001, stage by stage, against plain Python."""

import os

import pytest

import corpus_pipeline
from meridian.llm import decontamination

from .test_operators import brute_components

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_each_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontaminate", "mix", "shard"]
    stage = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    known = stage["language_id"](spark, docs, SF)
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in known.collect()}
    assert known.columns == columns
    assert kept == {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}

    one = stage["near_dedup"](spark, known, SF)
    want = brute_components([(i, texts[i]) for i in kept])
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {i for i in kept if want[i][1] == i}

    clean = stage["decontaminate"](spark, one, SF)
    items = [t for (t,) in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    plain = lambda t: " ".join(w.decode() for w in decontamination.tokens(t))
    before = {r.doc_id: r.text for r in one.collect()}
    after = {r.doc_id for r in clean.collect()}
    assert clean.columns == columns
    assert all(i not in after for i, t in before.items() if any(f" {plain(x)} " in f" {plain(t)} " for x in items))

    mixed = stage["mix"](spark, clean, SF)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= after

    placed = stage["shard"](spark, mixed, SF).collect()
    assert len(placed) == mixed.count()
    slots = sorted((r.shard, r.slot) for r in placed)
    assert len(set(slots)) == len(slots)


def test_empty_documents(spark, empty):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        if name != "decontaminate":
            docs = stage(spark, docs, SF)
            assert docs.count() == 0
