"""Queries of dense, lexical and fused search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabbyline.config import RetrievalConfig
from tabbyline.functions.vectors import usable
from tabbyline.operators import lexical, search
from tabbyline.plans.base import query
from tabbyline.session import table

_COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"
_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _first_vector(spark, d):
    return table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]


def _top(spark, d, where=None):
    found = search.search(table(spark, d, "embeddings"), _first_vector(spark, d), 5, where, "vec_id", "embedding")
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, label, round({_COS.format(a='embedding', b=_Q0)}, 6) AS score FROM embeddings ORDER BY {_COS.format(a='embedding', b=_Q0)} DESC, vec_id LIMIT 5")
def search_topk(spark, d):
    return _top(spark, d)


@query(f"SELECT vec_id, label, round({_COS.format(a='embedding', b=_Q0)}, 6) AS score FROM embeddings WHERE label = 3 ORDER BY {_COS.format(a='embedding', b=_Q0)} DESC, vec_id LIMIT 5")
def search_filtered(spark, d):
    return _top(spark, d, F.col("label") == 3)


_BATCH = f"""SELECT q.vec_id AS query_id, e.vec_id AS vec_id, round({_COS.format(a='e.embedding', b='q.embedding')}, 9) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS.format(a='e.embedding', b='q.embedding')}, 9) DESC, e.vec_id) AS rank
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q"""


def _batch(spark, d, k):
    vectors = table(spark, d, "embeddings")
    asked = vectors.filter("vec_id % 100 = 0").select("vec_id", "embedding")  # the stated queries
    return search.search_batch(vectors, asked, k, "vec_id", "embedding", "bigint")


@query(f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM ({_BATCH}) WHERE rank <= 5")
def search_topk_batch(spark, d):
    return _batch(spark, d, 5).withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("bigint")})


@query(f"SELECT round(avg(score), 6) AS mean_top_score FROM ({_BATCH}) WHERE rank = 1")
def top1_mean(spark, d):
    return search.mean_top_score(_batch(spark, d, 1)).select(F.round("mean_top_score", 6).alias("mean_top_score"))


_GOOD = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_ONE = f"""(SELECT id, any_value(content) AS content, any_value(source) AS source, any_value(metadata.title) AS title, any_value(embedding) AS embedding FROM chunks
  WHERE {_GOOD} GROUP BY id)"""
_ASK = f"(SELECT embedding FROM {_ONE} ORDER BY id LIMIT 1)"


def _chunks(spark, d, *columns):
    """Chunks with a usable vector, once each, with these columns only."""
    c = table(spark, d, "chunks").filter(usable(F.col("embedding"), 64)).withColumn("title", F.col("metadata.title"))
    one = c.groupBy("id").agg(F.first(F.struct(*columns)).alias("c"))
    return one.select("id", "c.*")


@query(f"""SELECT row_number() OVER (ORDER BY round({_COS.format(a='embedding', b=_ASK)}, 9) DESC, id) AS rank, round({_COS.format(a='embedding', b=_ASK)}, 4) AS score, source,
           title, substr(content, 1, 200) AS preview FROM {_ONE} ORDER BY rank LIMIT 3""")
def search_report(spark, d):
    chunks = _chunks(spark, d, "content", "source", "title", "embedding").withColumnRenamed("id", "point_id")
    asked = chunks.orderBy("point_id").select("embedding").first()
    found = search.search(chunks, asked["embedding"] if asked else [0.0] * 64, 3, None, "point_id", "embedding")
    return search.hits(found).withColumn("rank", F.col("rank").cast("bigint"))


_PAYLOAD = f"""(SELECT id, any_value(source) AS source, any_value(content_type) AS content_type, any_value(metadata.title) AS title, any_value(embedding) AS embedding FROM chunks
  WHERE {_GOOD} AND source = 'merck_vet_manual' AND content_type = 'disease' GROUP BY id)"""


@query(f"""SELECT id, title, source, content_type, round({_COS.format(a='embedding', b=_ASK)}, 6) AS score FROM {_PAYLOAD} ORDER BY round({_COS.format(a='embedding', b=_ASK)}, 9) DESC, id LIMIT 5""")
def search_payload(spark, d):
    """The chunks most similar to the first one, among those of one source and kind."""
    chunks = _chunks(spark, d, "source", "content_type", "title", "embedding")
    asked = chunks.orderBy("id").select("embedding").first()
    wanted = (F.col("source") == "merck_vet_manual") & (F.col("content_type") == "disease")
    found = search.search(chunks, asked["embedding"] if asked else [0.0] * 64, 5, wanted, "id", "embedding")
    return found.select("id", "title", "source", "content_type", F.round("score", 6).alias("score"))


#: The stated questions, by number.
QUESTIONS = ((1, "kidney disease in older cats"), (2, "chronic vomiting after meals"), (3, "toxic lily leaves"))
_TERMS = ", ".join(f"({q}, '{t}')" for q, words in QUESTIONS for t in sorted(set(words.split())))
_BM25 = rf"""WITH w AS (SELECT id AS k, regexp_extract_all(lower(coalesce(content, '')), '[\p{{L}}\p{{N}}]+') AS words FROM {_ONE}),
s AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM w),
q AS (SELECT * FROM (VALUES {_TERMS}) t(query_id, term)),
f AS (SELECT k, len(words) AS length, term, len(list_filter(words, lambda x: x = term))::DOUBLE AS tf FROM w, (SELECT DISTINCT term FROM q)),
i AS (SELECT term, ln(1 + ((SELECT n FROM s) - count_if(tf > 0) + 0.5) / (count_if(tf > 0) + 0.5)) AS idf FROM f GROUP BY term),
r AS (SELECT query_id, k, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / (SELECT mean FROM s)))), 9) AS score
  FROM f JOIN q USING (term) JOIN i USING (term) WHERE tf > 0 GROUP BY query_id, k),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, k) AS rank FROM r)"""


CONFIG = RetrievalConfig()


def _lexical(spark, d, k=CONFIG.top_k_initial):
    return lexical.bm25(_chunks(spark, d, "content"), QUESTIONS, k)


@query(f"{_BM25} SELECT query_id::BIGINT AS query_id, k AS id, round(score, 6) AS score FROM bm WHERE rank <= 10")
def bm25_topk(spark, d):
    return _lexical(spark, d, 10).select("query_id", "id", F.round("score", 6).alias("score"))


def _dense(spark, d):
    """The first three chunks by id ask in the place of the questions."""
    chunks = _chunks(spark, d, "embedding")
    asked = [(n, r["embedding"]) for n, r in enumerate(chunks.orderBy("id").select("embedding").limit(3).collect(), 1)]
    return search.search_batch(chunks, asked, CONFIG.top_k_initial, "id", "embedding")


_DENSE = f"""dn AS (SELECT q.n AS query_id, e.id AS k, row_number() OVER (PARTITION BY q.n ORDER BY round({_COS.format(a='e.embedding', b='q.embedding')}, 9) DESC, e.id) AS rank
  FROM {_ONE} e, (SELECT row_number() OVER (ORDER BY id) AS n, embedding FROM {_ONE} ORDER BY id LIMIT 3) q)"""


def _fused_sql(w: float) -> str:
    return f"""{_BM25}, {_DENSE},
    u AS (SELECT query_id, k, {w} / (rank + 60) AS s FROM bm WHERE rank <= 30 UNION ALL SELECT query_id, k, {w} / (rank + 60) FROM dn WHERE rank <= 30),
    t AS (SELECT query_id, k, round(sum(s), 9) AS score FROM u GROUP BY query_id, k)
    SELECT query_id::BIGINT AS query_id, k AS id, round(score, 6) AS score FROM t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, k) <= 10"""


@query(_fused_sql(1.0))
def rrf_fusion(spark, d):
    return lexical.fuse(_dense(spark, d), _lexical(spark, d), 10).select("query_id", "id", F.round("score", 6).alias("score"))


@query(_fused_sql(0.5))
def weighted_fusion(spark, d):
    return lexical.fuse(_dense(spark, d), _lexical(spark, d), 10, CONFIG.dense_weight, CONFIG.bm25_weight).select("query_id", "id", F.round("score", 6).alias("score"))


@query(rf"""{_BM25}, c AS (SELECT bm.query_id, bm.k, (SELECT count(DISTINCT x)::DOUBLE FROM unnest(w.words) t(x) WHERE x IN (SELECT term FROM q q2 WHERE q2.query_id = bm.query_id))
  / (SELECT count(*) FROM q q3 WHERE q3.query_id = bm.query_id) AS raw FROM bm JOIN w USING (k) WHERE bm.rank <= 30)
  SELECT query_id::BIGINT AS query_id, k AS id, round(raw, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, k) <= 5""")
def rerank(spark, d):
    asked = F.broadcast(spark.createDataFrame(QUESTIONS, "query_id bigint, query string"))  # the stated questions
    texts = _chunks(spark, d, "content").withColumnRenamed("content", "text")
    candidates = _lexical(spark, d).select("query_id", "id").join(asked, "query_id").join(texts, "id")
    return lexical.rerank(candidates, CONFIG.top_k_reranked).select("query_id", "id", F.round("score", 6).alias("score"))
