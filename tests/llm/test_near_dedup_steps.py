"""Steps of near-duplicate detection that bound what is shuffled, run and held."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from probegrid.llm import graph
from probegrid.llm import near_dedup as nd
from probegrid.llm.common import keyed


def test_texts_without_a_key_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)] + [(None, "none")], "doc_id long, text string")
    texts = nd.stored(keyed(docs), "texts")
    keys = nd.stored(texts.where("_id % 10 = 0").select("_id", F.col("_id").alias("c"), F.col("_h").alias("ch")).drop("_id"), "keys")
    left = {x._id for x in nd._marked_texts(texts, keys).collect()}
    assert left >= set(range(0, 3000, 10)) and len(left) < 700
    assert nd._marked_texts(texts, keys.limit(0)).count() == 0


def test_full_bitmap_loses_no_text(spark, monkeypatch):
    monkeypatch.setattr(nd, "BITMAP_BITS", 8)
    texts = nd.stored(keyed(spark.createDataFrame([(i, f"text {i}") for i in range(99)], "doc_id long, text string")), "texts")
    keys = nd.stored(texts.select(F.col("_id").alias("c"), F.col("_h").alias("ch")), "keys")
    assert nd._marked_texts(texts, keys).count() == 99


@pytest.mark.parametrize("edges", [200_000, 20])
def test_components_write_two_tables_if_a_task_holds_the_edges(spark, monkeypatch, edges):
    monkeypatch.setattr(graph, "EDGES", edges)
    written = []
    monkeypatch.setattr(graph, "stored", lambda df, name: written.append(name) or nd.stored(df, name))
    r = random.Random(6)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)]
    label = list(range(400))
    for _ in range(400):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.node: x.label for x in graph.components(spark.createDataFrame(pairs, "a long, b long").repartition(6)).collect()}
    assert got == {i: m for i, m in enumerate(label) if i != m}
    assert len(written) == 2 if edges > len(pairs) else len(written) > 2


def test_pipeline_sends_texts_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
        for stage in (corpus_pipeline.near_dedup, corpus_pipeline.packing):
            spark.conf.set(name, "10000")
            stage(spark, docs, "")
            assert int(spark.conf.get(name)) <= 1000
    finally:
        spark.conf.set(name, before)
