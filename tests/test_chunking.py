"""The splitter: properties over random texts, and its rules on crafted ones."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabbyline.config import ChunkingConfig
from tabbyline.operators.chunk import chunk_documents, pretokens, split_text, tokenizer_counter

PART = st.sampled_from(["word ", "cat. ", "\n", "\n\n", "a" * 9, "é!", "  ", "x y z ", "猫", "12345 "])


@given(st.lists(PART, max_size=120).map("".join), st.integers(2, 20), st.integers(0, 4))
@settings(max_examples=150, deadline=None)
def test_properties(text, size, overlap):
    overlap = min(overlap, size)
    chunks = split_text(text, size, overlap, measure=len)
    assert chunks == split_text(text, size, overlap, measure=len)
    assert all(c and c == c.strip() and len(c) <= size for c in chunks)
    at = 0
    for c in chunks:  # in order
        found = text.find(c, max(0, at - size))
        assert found >= 0
        at = found
    kept = "".join(chunks)
    assert set(text.split()) == set() if not chunks else set("".join(text.split())) <= set("".join(kept.split()))
    if not overlap:
        assert "".join("".join(chunks).split()) == "".join(text.split())


def test_separators_in_order():
    assert split_text("aaa bbb\n\nccc ddd", 8, 0, measure=len) == ["aaa bbb", "ccc ddd"]
    assert split_text("aaa bbb ccc", 8, 4, measure=len) == ["aaa bbb", "bbb ccc"]
    assert split_text("abcdefgh", 3, 1, measure=len) == ["abc", "cde", "efg", "gh"]
    assert split_text("", 8, 0) == [] and split_text(" \n ", 8, 0) == []


def test_bounds():
    with pytest.raises(ValueError):
        split_text("x", 4, 5)
    assert pretokens("It's 12345 cats!") == 7


def test_documents(spark):
    meta = ("content string, id string, source string, url string, title string, content_type string, metadata struct<word_count:int,title:string>")
    df = spark.createDataFrame([("cat " * 300, "d", "s", "u", "t", "article", (300, "own")), (None, "e", "s", "u", "t", "article", None), ("", "f", "s", "u", "t", "article", None)], meta)
    rows = chunk_documents(df, ChunkingConfig(chunk_size=64, chunk_overlap=8)).orderBy("chunk_index").collect()
    assert {r["document_id"] for r in rows} == {"d"}
    assert [r["chunk_index"] for r in rows] == list(range(len(rows))) and len({r["id"] for r in rows}) == len(rows)
    assert all(0 < r["token_count"] <= 64 and r["metadata"]["total_chunks"] == len(rows) and r["metadata"]["word_count"] == 300 for r in rows)


def test_sizes_are_counted_in_tokens_and_texts_are_cut_once(spark):
    count = tokenizer_counter(ChunkingConfig().rank_file)()
    text = "Antidisestablishmentarianism, 12345678901234567890 and hyperthyroidism! " * 60
    df = spark.createDataFrame([("d", text, "s", "u", "t", "article")], "id string, content string, source string, url string, title string, content_type string")
    cut = chunk_documents(df, ChunkingConfig(chunk_size=64, chunk_overlap=8))
    rows = cut.collect()
    assert len(rows) > 5 and all(r["token_count"] == count(r["content"]) <= 64 for r in rows)
    plan = cut.select("chunk_index", "metadata.total_chunks", "content")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    assert max(pretokens(r["content"]) for r in chunk_documents(df, ChunkingConfig(chunk_size=64, chunk_overlap=8, rank_file=None)).collect()) <= 64
