"""Valid and invalid records and configurations."""

import datetime as dt

import pytest

from tabbyline import config, schema
from tabbyline.operators.validate import checked, split_valid, strict

NOW = dt.datetime(2026, 1, 1)
GOOD = dict(id="a", source="cornell_feline_health", url="u", title="T", content="A cat sat on the mat. " * 5, content_type="disease", scraped_at=NOW, metadata=None)
CHUNK = dict(
    id="a__0", document_id="a", source="cornell_feline_health", content="Kidney disease is common in older cats.", content_type="disease", chunk_index=0, token_count=128,
    embedding=None, embedding_model=None, pipeline_version="0.1.0", created_at=NOW, metadata=None,
)


def told(spark, row, rules, struct):
    loose = type(struct)([type(f)(f.name, f.dataType, True) for f in struct.fields])
    df = spark.createDataFrame([tuple(row[f.name] for f in loose.fields)], loose)
    return checked(df, rules).first()["violations"]


@pytest.mark.parametrize(
    "change, violations",
    [
        ({}, []),
        ({"content": "too short"}, ["content"]),
        ({"title": ""}, ["title"]),
        ({"title": None}, ["title"]),
        ({"title": "t" * 501}, ["title"]),
        ({"source": "elsewhere", "content_type": "poem"}, ["source", "content_type"]),
        ({"id": None, "url": None}, ["id", "url"]),
        ({"content": None}, ["content"]),
    ],
)
def test_documents(spark, change, violations):
    assert told(spark, GOOD | change, schema.document_rules(), schema.DOCUMENT) == violations


@pytest.mark.parametrize(
    "change, violations",
    [
        ({}, []),
        ({"token_count": 3000, "content": "Some text"}, ["content", "token_count_bound"]),
        ({"chunk_index": -1}, ["chunk_index"]),
        ({"token_count": 0}, ["token_count"]),
        ({"token_count": None}, ["token_count", "token_count_bound"]),
        ({"pipeline_version": None}, ["pipeline_version"]),
    ],
)
def test_chunks(spark, change, violations):
    assert told(spark, CHUNK | change, schema.chunk_rules(), schema.CHUNK) == violations


def test_response(spark):
    row = ("answer", [("c", "text", "s", 0.92, "t", "u")], "q", "m", 1250.5, "{}", NOW, None)
    df = spark.createDataFrame([row, row[:4] + (-1.0,) + row[5:]], schema.RESPONSE)
    assert [r["violations"] for r in checked(df, schema.response_rules()).collect()] == [[], ["latency_ms"]]


def test_split_and_strict(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    from pyspark.sql import functions as F

    rules = {"b": F.col("b").isNotNull()}
    good, bad = split_valid(df, rules)
    assert [r["a"] for r in good.collect()] == [1] and [r["violations"] for r in bad.collect()] == [["b"]]
    assert strict(df.filter("a = 1"), rules).count() == 1
    with pytest.raises(Exception, match="invalid record: b"):
        strict(df, rules).collect()


def test_configuration():
    c = config.EngineConfig()
    assert (c.chunking.chunk_size, c.retrieval.top_k_initial, c.retrieval.top_k_reranked, c.generation.temperature) == (512, 30, 5, 0.1)
    assert c.embedding_model == "all-MiniLM-L6-v2" and '"top_k_initial": 30' in c.snapshot()
    changed = config.EngineConfig(chunking=config.ChunkingConfig(chunk_size=256, chunk_overlap=25), embedding_model="other")
    assert (changed.chunking.chunk_size, changed.embedding_model) == (256, "other")
    for bad in (lambda: config.ChunkingConfig(chunk_size=10), lambda: config.ChunkingConfig(chunk_overlap=-1), lambda: config.RetrievalConfig(bm25_weight=2), lambda: config.GenerationConfig(temperature=3)):
        with pytest.raises(ValueError):
            bad()
