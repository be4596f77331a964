"""Lexical ranking, fusion with dense ranks, and reranking (extensions)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words as the index sees them.
TERM = r"[\p{L}\p{N}]+"
K1, B = 1.5, 0.75
RRF = 60


def bm25(df: DataFrame, queries: Sequence[tuple[int, str]], k: int = 30, key: str = "id", text: str = "content") -> DataFrame:
    """`(query_id, key, score, rank)` by Okapi BM25, the idf being log(1 + (N - n + .5) / (n + .5)).

    Only rows that hold a term of a query are exploded: lengths and frequencies are computed in the row,
    statistics of the corpus in one aggregate, so nothing but matches is shuffled. The terms of the
    queries are a stated set. Null texts count as empty."""
    import regex

    asked = sorted({(q, w) for q, words in queries for w in regex.findall(TERM, words.lower())})
    terms = sorted({w for _, w in asked})
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))
    sized = df.select(F.col(key).alias("k"), words.alias("words"))
    wanted = F.array(*map(F.lit, terms))
    kept = sized.select("k", F.size("words").alias("length"), F.filter("words", lambda w: F.array_contains(wanted, w)).alias("hits"))
    here = F.array_distinct("hits")
    corpus = kept.agg(
        F.count("*").alias("n"),
        F.avg("length").alias("mean"),
        *(F.count_if(F.array_contains("hits", t)).alias(f"df{i}") for i, t in enumerate(terms)),
    ).first()
    n, mean = corpus["n"], corpus["mean"] or 1.0
    idf = {t: math.log(1 + (n - corpus[f"df{i}"] + 0.5) / (corpus[f"df{i}"] + 0.5)) for i, t in enumerate(terms)}
    weights = df.sparkSession.createDataFrame([(q, t, idf[t]) for q, t in asked], "query_id bigint, term string, idf double")
    matched = kept.filter(F.size("hits") > 0).select("k", "length", "hits", F.explode(here).alias("term"))
    matched = matched.withColumn("tf", F.size(F.filter("hits", lambda w: w == F.col("term"))).cast("double")).drop("hits")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    # the stated terms are a few rows
    scored = matched.join(F.broadcast(weights), "term").groupBy("query_id", "k").agg(F.round(F.sum(part), 9).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "k")))
    return ranked.filter(F.col("rank") <= k).withColumnRenamed("k", key)


def fuse(dense: DataFrame, lexical: DataFrame, k: int = 30, dense_weight: float = 1.0, lexical_weight: float = 1.0, key: str = "id", constant: int = RRF) -> DataFrame:
    """Reciprocal-rank fusion of two rankings `(query_id, key, rank)`, weighted if asked."""
    d = dense.select("query_id", key, F.col("rank").alias("d"))
    x = lexical.select("query_id", key, F.col("rank").alias("x"))
    both = d.join(x, ["query_id", key], "full_outer")
    term = lambda r, w: F.coalesce(F.lit(float(w)) / (F.col(r) + constant), F.lit(0.0))
    scored = both.withColumn("score", F.round(term("d", dense_weight) + term("x", lexical_weight), 9)).drop("d", "x")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))
    return ranked.filter(F.col("rank") <= k)


def overlap_scorer() -> Callable[[list[str], list[str]], list[float]]:
    """A deterministic scorer of (query, text): share of the query's words that the text holds."""
    import regex

    def score(queries: list[str], texts: list[str]) -> list[float]:
        out = []
        for q, t in zip(queries, texts):
            asked = set(regex.findall(TERM, (q or "").lower()))
            out.append(len(asked & set(regex.findall(TERM, (t or "").lower()))) / len(asked) if asked else 0.0)
        return out

    return score


def rerank(candidates: DataFrame, k: int = 5, scorer: Callable[[], Callable[[list[str], list[str]], list[float]]] = overlap_scorer, key: str = "id") -> DataFrame:
    """The best `k` of `(query_id, query, key, text)` for each query by a model of pairs, ties by key."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        run = scorer()
        for queries, texts in batches:
            yield pd.Series(run(queries.tolist(), texts.tolist()))

    scored = candidates.withColumn("score", F.round(score("query", "text"), 9))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))
    return ranked.filter(F.col("rank") <= k).select("query_id", key, "score", "rank")
