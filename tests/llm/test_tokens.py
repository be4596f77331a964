"""Problems 8, 4 and 1: exact ids and counts, cuts within bounds."""

import base64
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from tabbyline.llm import bpe, budget, encode, split


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def noise(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    kinds = ["abcdefgh", "aab", "the ing er ", "\n\t \r\v\f", "é漢字かな😀ё½²", "!?.-=#'", "0123456789", " ", "\x1c\x85\xa0 　", "<|endoftext|>"]
    return ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.choice([1, 3, 10, 40, 200]))) for _ in range(n)]


CASES = ["", " ", "<|endoftext|> it's 'll", "a" * 5000, "漢" * 900, "\r\n\r\n x", "  two  blanks ", "é", "😀".encode("utf-16", "surrogatepass").decode("utf-16")]


def test_ids_are_exact(reference):
    enc = bpe.BpeEncoder()
    for text in [*CASES, *noise(1, 1500)]:
        assert enc.encode(text) == reference(text)
        assert enc.count(text) == len(reference(text))
    assert enc.encode(None) == [] and enc.count(None) == 0


def test_pretokens_and_units_cover_the_text():
    for text in [*CASES, *noise(2, 500)]:
        assert "".join(bpe.pretokens(text)) == text == "".join(bpe.units(text))


def test_trie_counts_are_exact(reference):
    counter = budget.TokenCounter(bpe.encoder())
    for text in [*CASES, *noise(3, 800)]:
        assert counter.count(text) == len(reference(text))


def test_trie_is_longest_match():
    words = {w: n for n, w in enumerate(["a", "b", "c", "d", "ab", "abc", "abcde", "bc", "cd", "e", "ea", "dea"])}
    trie = budget.MatchTrie(words)
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice("abcde") for _ in range(rng.randint(0, 30)))
        out, at = [], 0
        while at < len(text):
            best = max((w for w in words if text.startswith(w, at)), key=len)
            out.append(words[best])
            at += len(best)
        assert trie.cut(text) == out
    with pytest.raises(KeyError):
        trie.cut("x")


def test_encode_corpus(spark):
    rows = [(1, "cats", "x"), (2, None, "y"), (3, "", "z"), (1, "cats", "x"), (None, "a", "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").withColumns({"k": F.lit(1), "t": F.lit("q")})
    got = sorted((str(r["doc_id"]), r["ids"]) for r in encode.encode_corpus(df).collect())
    enc = bpe.encoder()
    assert got == sorted([("1", enc.encode("cats")), ("1", enc.encode("cats")), ("2", []), ("3", []), ("None", enc.encode("a"))])
    assert encode.encode_corpus(df.limit(0)).count() == 0


def test_slices_keep_all_rows():
    import pyarrow as pa

    batch = pa.record_batch({"a": list(range(9)), "t": ["x" * 1000] * 9})
    parts = list(encode.slices(batch, 1, 2500))
    assert len(parts) > 3 and [v for p in parts for v in p.column(0).to_pylist()] == list(range(9))


def spans_hold(text, spans, limit, overlap, count):
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for a, b, n in spans:
        assert n == count(text[a:b]) and (n <= limit or b - a == 1)
    for (a, b, _), (c, e, _) in zip(spans, spans[1:]):
        assert a < c <= b < e and count(text[c:b]) <= overlap


def test_cuts_are_legal(reference):
    enc, rng = bpe.encoder(), random.Random(5)
    count = lambda t: len(reference(t))
    parts = ["word ", "\n\n", "。", "漢字かな" * 9, " ", "\t", "x.y! ", "😀" * 9, "!" * 30, "q9z" * 20, "a" * 200, "Die Katze. "]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(5, 150)))
        if count(text) > 40:
            for overlap in (0, 10):
                spans_hold(text, split.cut_texts([text], enc, 40, overlap)[0], 40, overlap, count)


@pytest.mark.parametrize("limit, overlap", [(1, 0), (2, 1), (5, 0), (8, 2), (17, 5), (64, 16), (512, 50)])
def test_cuts_hold_at_any_limit(reference, limit, overlap):
    enc, rng = bpe.encoder(), random.Random(limit)
    count = lambda t: len(reference(t))
    parts = ["word ", "\n\n", "。", "漢字かな" * 9, " ", "\t", "x.y! ", "😀" * 3, "!" * 30, "q9z" * 20, "a" * 200, " \n" * 40, "\t" * 90, "'s", "##'", "don't ", "\x1c", "\u3000", "ЖЪ", "\u00a0 ", "é́", "한글"]
    for _ in range(60):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(5, 90)))
        if count(text) > limit:
            spans_hold(text, split.cut_texts([text], enc, limit, overlap)[0], limit, overlap, count)


def test_a_long_run_does_not_spoil_the_other_pieces(reference):
    text = "word here " * 600 + " \n\t \r" * 3000 + "word there " * 600
    spans = split.cut_texts([text], bpe.encoder(), 512, 50)[0]
    spans_hold(text, spans, 512, 50, lambda t: len(reference(t)))
    total = len(reference(text))
    assert len(spans) < 1.5 * total / 462 + 3 and sum(a < b[1] for (a, _, _), b in zip(spans[1:], spans)) >= 3


def test_cuts_are_natural():
    enc = bpe.encoder()
    text = ("One sentence stands here and goes on. " * 6).strip() + "\n\n" + ("Another one stands there instead. " * 6).strip()
    spans = split.cut_texts([text], enc, 64, 0)[0]
    assert text[spans[0][1] :].startswith("\n\n")
    assert all(text[b - 1] == "." for _, b, _ in spans)


def test_doubling_is_the_walk():
    import numpy as np

    rng = np.random.default_rng(6)
    after = np.minimum(np.arange(50) + rng.integers(1, 5, 50), 49)
    path = split.walk(after, np.array([0]), np.array([49]))[0]
    walked = [0]
    while walked[-1] != 49:
        walked.append(int(after[walked[-1]]))
    assert path[: len(walked)].tolist() == walked and set(path[len(walked) :].tolist()) <= {49}


def test_split_documents(spark):
    long = "Cats sleep a lot. " * 400
    rows = [("a", long, 1), ("a", long, 1), ("b", "short", 2), ("c", None, 3), ("d", " \n", 4), ("e", "", 5), (None, long, 6)]
    df = spark.createDataFrame(rows, "id string, content string, chunk_index int")
    assert [r["id"] for r in split.oversized(df).collect()] == ["a"]
    got = split.split_documents(df).orderBy("id", "chunk_index").collect()
    a = [r for r in got if r["id"] == "a"]
    assert {r["id"] for r in got} == {"a", "b"} and [r["chunk_index"] for r in a] == list(range(len(a))) and len(a) > 1
    assert all(r["token_count"] <= 512 for r in got) and a[0]["content"] + "" == long[: len(a[0]["content"])]
    assert split.oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split.split_spans(df, limit=50, overlap=50)


def test_budget(spark):
    schema = "id string, source string, lang string, content_type string, content string, token_count int, metadata struct<url:string>"
    rows = [
        ("a", "s", "EN", "article", "cats", 1, ("https://H.example/x",)),
        ("a", "s", "EN", "article", "cats", 1, ("https://H.example/x",)),
        ("b", "s", "en-US", "article", "cats and dogs", 99, ("https://h.example:80/y",)),
        ("c", None, None, None, None, None, None),
        ("d", "s", "eng", "article", "cats and dogs", None, ("https://h.example/y",)),
        ("e", "s", "en", "article", "", 0, ("no url",)),
        ("f", "s", "en", "article", " word" * 10, 5, None),
        ("g", "s", "en", "article", " word" * 10, 20, None),
    ]
    df = spark.createDataFrame(rows, schema).withColumn("tokens", F.lit("clash"))
    totals = {(r["source"], r["lang"], r["host"]): (r["chunks"], r["tokens"]) for r in budget.token_budget(df).collect()}
    count = budget.counter().count
    assert totals["s", "en", "h.example"] == (3, count("cats") + 2 * count("cats and dogs"))
    assert totals[None, None, None] == (1, 0)
    assert {r["id"] for r in budget.miscounted(df).collect()} == {"b", "d", "e"}
    assert budget.miscounted(df.limit(0)).count() == 0 and budget.token_budget(df.limit(0)).count() == 0


def test_long_white_space_is_cut(spark, reference):
    texts = {"blank": " \n\t" * 900, "front": "\n" * 3000 + "a cat", "inside": "cat " + "\t \n" * 900 + "dog", "short": " \n "}
    assert all(len(reference(t)) > 512 for i, t in texts.items() if i != "short")
    df = spark.createDataFrame(list(texts.items()), "id string, content string")
    assert sorted(r["id"] for r in split.oversized(df).collect()) == ["blank", "front", "inside"]
    for i in ("blank", "front", "inside"):
        got = split.split_documents(df).filter(f"id = '{i}'").orderBy("chunk_index").collect()
        assert "".join(r["content"] for r in got) == texts[i] and [r["chunk_index"] for r in got] == list(range(len(got)))
        assert all(r["token_count"] == len(reference(r["content"])) <= 512 for r in got)
    assert split.split_documents(df).filter("id = 'short'").count() == 0
