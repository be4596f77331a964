"""Queries over chunks and their store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabbyline import schema
from tabbyline.config import ChunkingConfig
from tabbyline.functions import text as T
from tabbyline.functions import vectors as V
from tabbyline.operators import chunk, embed, metrics, store, validate
from tabbyline.plans.base import WS, query
from tabbyline.session import shared_dir, table

_LIST = lambda names: ", ".join(f"'{n}'" for n in names)
_SOURCES, _TYPES = _LIST(schema.DATA_SOURCES), _LIST(schema.CONTENT_TYPES)


def uuid5_sql(x: str) -> str:
    h = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({x}))"
    digit = f"(strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 8"
    return f"substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||substr('0123456789abcdef', ({digit})::INT + 1, 1)||substr({h},18,3)||'-'||substr({h},21,12)"


@query("SELECT id, document_id || '__' || chunk_index || '__' || substr(sha256(document_id || '|' || chunk_index || '|' || content), 1, 12) AS derived FROM chunks WHERE content IS NOT NULL")
def chunk_id(spark, d):
    c = table(spark, d, "chunks").filter(F.col("content").isNotNull())
    return c.select("id", T.chunk_id(F.col("document_id"), F.col("chunk_index"), F.col("content")).alias("derived"))


@query(f"SELECT id, {uuid5_sql('id')} AS point_id FROM chunks")
def point_id(spark, d):
    return table(spark, d, "chunks").select("id", T.uuid5(F.col("id")).alias("point_id"))


_BAD = f"""list_filter([
  CASE WHEN id IS NULL THEN 'id' END, CASE WHEN document_id IS NULL THEN 'document_id' END,
  CASE WHEN NOT coalesce(source IN ({_SOURCES}), false) THEN 'source' END,
  CASE WHEN NOT coalesce(length(content) >= 10, false) THEN 'content' END,
  CASE WHEN NOT coalesce(content_type IN ({_TYPES}), false) THEN 'content_type' END,
  CASE WHEN NOT coalesce(chunk_index >= 0, false) THEN 'chunk_index' END,
  CASE WHEN NOT coalesce(token_count > 0, false) THEN 'token_count' END,
  CASE WHEN NOT coalesce(token_count <= 2048, false) THEN 'token_count_bound' END,
  CASE WHEN pipeline_version IS NULL THEN 'pipeline_version' END], lambda v: v IS NOT NULL)"""


@query(f"SELECT id, array_to_string(bad, ', ') AS violations FROM (SELECT id, {_BAD} AS bad FROM chunks) WHERE len(bad) > 0")
def chunk_validate(spark, d):
    _, bad = validate.split_valid(table(spark, d, "chunks"), schema.chunk_rules())
    return bad.select("id", F.array_join("violations", ", ").alias("violations"))


@query(
    """SELECT (SELECT count(*) FROM chunks) AS chunks, min(token_count) AS token_min, max(token_count) AS token_max, round(avg(token_count), 6) AS token_mean,
       (SELECT count(*) FROM source_documents) AS documents, round((SELECT count(*) FROM chunks) / (SELECT count(*) FROM source_documents), 9) AS chunks_per_document FROM chunks"""
)
def chunk_stats(spark, d):
    s = chunk.chunk_stats(table(spark, d, "chunks"), table(spark, d, "source_documents"))
    return s.withColumns({"token_mean": F.round("token_mean", 6), "chunks_per_document": F.round("chunks_per_document", 9)})


@query("SELECT document_id, count(*) AS total_chunks, count(DISTINCT chunk_index) AS places FROM chunks GROUP BY document_id")
def chunks_per_document(spark, d):
    return table(spark, d, "chunks").groupBy("document_id").agg(F.count("*").alias("total_chunks"), F.count_distinct("chunk_index").alias("places"))


@query(
    f"""SELECT DISTINCT id AS document_id, title, url, metadata.word_count AS word_count, metadata.registry AS registry FROM source_documents
        WHERE regexp_matches(content, '[^{WS}]')"""
)
def chunk_metadata(spark, d):
    """What the chunks of each document carry of it: title and url first, then its own metadata."""
    docs = table(spark, d, "source_documents").filter(F.col("content").isNotNull())
    own = chunk.chunk_documents(docs).select("document_id", "metadata.title", "metadata.url", "metadata.word_count", "metadata.registry")
    return own.distinct()


@query(f"""SELECT DISTINCT {uuid5_sql('id')} AS point_id, id AS chunk_id, document_id, source, content, content_type, chunk_index, token_count,
           coalesce(metadata.title, '') AS title, coalesce(metadata.url, '') AS url FROM chunks""")
def payload_flatten(spark, d):
    return store.payload(table(spark, d, "chunks")).drop("vector").distinct()


@query(
    """SELECT id, (SELECT round(sum(x::DOUBLE * x::DOUBLE), 4) FROM unnest(embedding) t(x)) AS squared, len(embedding) AS dims FROM chunks WHERE embedding IS NOT NULL AND len(embedding) > 0"""
)
def vector_norms(spark, d):
    c = table(spark, d, "chunks").filter(F.size("embedding") > 0)
    return c.select("id", F.round(F.pow(V.norm(F.col("embedding")), 2), 4).alias("squared"), F.size("embedding").cast("bigint").alias("dims"))


@query(
    """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS unit_sum FROM embeddings"""
)
def embed_normalize(spark, d):
    unit = V.normalized(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("unit_sum"))


@query(
    f"""SELECT {uuid5_sql('id')} AS point_id, id AS chunk_id, arg_max(token_count, (created_at IS NOT NULL, created_at)) AS token_count FROM chunks
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY id"""
)
def upsert_merge(spark, d):
    """Two upserts of the same chunks leave each point once, the latest one."""
    chunks = table(spark, d, "chunks")
    c = _collection(spark)
    c.upsert(chunks.filter(F.col("chunk_index") % 2 == 0))
    c.upsert(chunks)
    return c.points().select("point_id", "chunk_id", "token_count")


def _collection(spark):
    c = store.Collection(spark, f"{shared_dir(spark)}/tabbyline/collection-{uuid.uuid4().hex}")
    c.create(dim=64)
    return c


_GOOD = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


@query(
    f"""SELECT count(DISTINCT id) FILTER (WHERE {_GOOD}) AS distinct_points, count(*) FILTER (WHERE {_GOOD}) AS sent,
        count(*) FILTER (WHERE NOT coalesce({_GOOD}, false)) AS skipped FROM chunks"""
)
def upsert_counts(spark, d):
    """What an upsert of all chunks reports."""
    told = _collection(spark).upsert(table(spark, d, "chunks"))
    return spark.createDataFrame([(told["distinct"], told["sent"], told["skipped"])], "distinct_points bigint, sent bigint, skipped bigint")


@query()
def chunk_recursive(spark, d):
    docs = table(spark, d, "source_documents").filter(F.col("content").isNotNull())
    return chunk.chunk_documents(docs, ChunkingConfig()).select("id", "document_id", "chunk_index", "token_count", "metadata.total_chunks", "content")


_BARE = rf"regexp_replace(content, '[{WS}]+', '', 'g')"


@query(f"SELECT id AS document_id, md5({_BARE}) AS text, 0 AS out_of_place FROM (SELECT DISTINCT id, content FROM source_documents) WHERE {_BARE} <> ''")
def chunk_cover(spark, d):
    """Chunks without overlap, put together again: each document's text but for white space, none lost, added or out of place."""
    docs = table(spark, d, "source_documents").filter(F.col("content").isNotNull()).select("id", "source", "url", "title", "content_type", "content").dropDuplicates(["id", "content"])
    cut = chunk.chunk_documents(docs, ChunkingConfig(chunk_overlap=0))
    whole = cut.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("c"), F.max("metadata.total_chunks").alias("n"))
    text = F.regexp_replace(F.array_join("c.content", ""), f"[{WS}]+", "")
    places = F.zip_with("c.chunk_index", F.sequence(F.lit(0), F.col("n") - 1), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    return whole.select("document_id", F.md5(text).alias("text"), F.aggregate(places, F.lit(0), lambda x, y: x + y).alias("out_of_place"))


@query("SELECT count(*) FILTER (WHERE false) AS over_size, count(DISTINCT id) AS documents FROM source_documents WHERE regexp_matches(content, '[^" + WS + "]')")
def chunk_sizes(spark, d):
    """Chunks over the bound of valid chunks by the exact count of tokens, which there are none of, and documents that have
    chunks. (The size itself is kept by the sum over parts, which joined may count a few tokens more.)"""
    docs = table(spark, d, "source_documents").filter(F.col("content").isNotNull())
    cut = chunk.chunk_documents(docs, ChunkingConfig())
    return cut.agg(F.count_if(F.col("token_count") > schema.MAX_CHUNK_TOKENS).alias("over_size"), F.count_distinct("document_id").alias("documents"))


@query()
def chunk_embed(spark, d):
    docs = table(spark, d, "source_documents").filter(F.col("content").isNotNull())
    return embed.embed_chunks(chunk.chunk_documents(docs), embed.hash_model(128)).select("id", "embedding_model", "embedding")


@query(
    """WITH s AS (SELECT count(*) AS chunks, min(token_count) AS token_min, max(token_count) AS token_max FROM chunks)
       SELECT 'baseline' AS run, 'metric' AS kind, 'chunks' AS key, chunks::VARCHAR AS value FROM s
       UNION ALL SELECT 'baseline', 'metric', 'token_min', token_min::VARCHAR FROM s UNION ALL SELECT 'baseline', 'metric', 'token_max', token_max::VARCHAR FROM s"""
)
def experiment_metrics(spark, d):
    s = table(spark, d, "chunks").agg(F.count("*").alias("chunks"), F.min("token_count").alias("token_min"), F.max("token_count").alias("token_max"))
    return metrics.metric_rows(s, "baseline")


@query(
    """SELECT 'baseline' AS run, * FROM (VALUES ('param', 'chunk_size', '512'), ('param', 'chunk_overlap', '50'), ('tag', 'stage', 'chunking')) t(kind, key, value)
       UNION ALL SELECT 'baseline', 'metric', 'documents', count(DISTINCT document_id)::VARCHAR FROM chunks"""
)
def experiment_run(spark, d):
    """A whole record of a run: parameters and tags beside what was measured."""
    config = ChunkingConfig()
    measured = table(spark, d, "chunks").agg(F.count_distinct("document_id").alias("documents"))
    return metrics.run_rows(measured, "baseline", {"chunk_size": config.chunk_size, "chunk_overlap": config.chunk_overlap}, {"stage": "chunking"})


@query("""SELECT c.id, s.title FROM chunks c JOIN (SELECT id, min(title) AS title FROM source_documents GROUP BY id) s ON c.document_id = s.id""")
def chunk_document_join(spark, d):
    titles = table(spark, d, "source_documents").groupBy("id").agg(F.min("title").alias("title")).withColumnRenamed("id", "document_id")
    return table(spark, d, "chunks").select("id", "document_id").join(titles, "document_id").select("id", "title")


@query("SELECT DISTINCT id, substr(content, 1, 400) AS sample FROM chunks ORDER BY id, sample LIMIT 1")
def chunk_sample(spark, d):
    return table(spark, d, "chunks").select("id", F.left("content", F.lit(400)).alias("sample")).orderBy("id", "sample").limit(1)


@query(f"SELECT ceil(count(*) / 100)::BIGINT AS batches, (count(*) - 100 * floor((count(*) - 1) / 100))::BIGINT AS last_batch FROM chunks WHERE {_GOOD}")
def upsert_batches(spark, d):
    """How many batches of a hundred an upsert sends, and the rows of the last."""
    told = _collection(spark).upsert(table(spark, d, "chunks"), 100)
    return spark.createDataFrame([(told["batches"], told["last_batch"])], "batches bigint, last_batch bigint")


@query(
    """SELECT s.id, count(c.id) AS chunks FROM (SELECT DISTINCT id FROM source_documents) s LEFT JOIN (SELECT DISTINCT id, document_id FROM chunks) c ON c.document_id = s.id GROUP BY s.id"""
)
def chunkless_documents(spark, d):
    """Distinct chunks of every document, 0 for those without: counted before the join, which then is one to one."""
    counted = table(spark, d, "chunks").select("id", "document_id").distinct().groupBy("document_id").agg(F.count("*").alias("n"))
    documents = table(spark, d, "source_documents").select("id").distinct()
    joined = documents.join(counted, documents["id"] == counted["document_id"], "left")
    return joined.select("id", F.coalesce("n", F.lit(0).cast("bigint")).alias("chunks"))
