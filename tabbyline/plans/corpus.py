"""Queries over documents: scan, filters, identifiers, validation, quality."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabbyline import schema
from tabbyline.functions import text as T
from tabbyline.operators import ingest, links, quality, validate
from tabbyline.plans.base import WS, query, strip_sql
from tabbyline.session import shared_dir, table
from tabbyline.sources import corpus

_LIST = lambda names: ", ".join(f"'{n}'" for n in names)
_SOURCES, _TYPES = _LIST(schema.DATA_SOURCES), _LIST(schema.CONTENT_TYPES)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_documents")


@query("SELECT id, source, url, title, content_type FROM source_documents")
def corpus_scan(spark, d):
    return _docs(spark, d).select("id", "source", "url", "title", "content_type")


@query("SELECT id, title FROM source_documents WHERE source = 'cfa_breed_profiles'")
def corpus_source_filter(spark, d):
    return _docs(spark, d).filter(F.col("source") == "cfa_breed_profiles").select("id", "title")


@query(
    """SELECT source, id FROM (SELECT DISTINCT source, id FROM source_documents)
       QUALIFY row_number() OVER (PARTITION BY source ORDER BY id) <= 5"""
)
def corpus_limit_per_source(spark, d):
    return ingest.first_per_source(_docs(spark, d).select("source", "id").distinct(), 5, "id")


@query("SELECT id FROM source_documents ORDER BY id NULLS FIRST LIMIT 10")
def corpus_limit(spark, d):
    return _docs(spark, d).select("id").orderBy("id").limit(10)


@query(
    """SELECT id, source FROM source_documents WHERE source = 'cornell_feline_health'
       UNION ALL SELECT id, source FROM source_documents WHERE source = 'wikipedia_cat_breeds'
       UNION ALL SELECT id, source FROM source_documents WHERE source = 'cfa_breed_profiles'"""
)
def corpus_union(spark, d):
    docs = _docs(spark, d).select("id", "source")
    return ingest.union_sources(*(docs.filter(F.col("source") == s) for s in ("cornell_feline_health", "wikipedia_cat_breeds", "cfa_breed_profiles")))


@query("SELECT DISTINCT source FROM source_documents ORDER BY source")
def corpus_sources_sorted(spark, d):
    return _docs(spark, d).select("source").distinct().orderBy("source")


@query("SELECT source, count(*) AS documents FROM source_documents GROUP BY source")
def quality_source_breakdown(spark, d):
    return quality.source_breakdown(_docs(spark, d))


@query(f"SELECT DISTINCT source FROM source_documents WHERE source IS NOT NULL AND source NOT IN ({_SOURCES})")
def quality_unknown_sources(spark, d):
    return quality.unknown_sources(_docs(spark, d))


@query("SELECT id FROM source_documents WHERE content IS NULL OR length(content) < 100 OR length(content) > 100100")
def quality_length_bounds(spark, d):
    return quality.outside_length(_docs(spark, d)).select("id")


_REPORT = f"""WITH m AS (
  SELECT count(*) AS n, count_if(content IS NULL OR length({strip_sql('content')}) < 50) AS short,
    list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)) AS sources,
    count_if(content IS NULL OR length(content) < 100 OR length(content) > 100100) AS outside
  FROM source_documents),
u AS (SELECT *, list_filter(sources, lambda s: NOT list_contains([{_SOURCES}], s)) AS unknown FROM m)
SELECT 'row_count_range' AS "check", n BETWEEN 50 AND 500 AS passed, n || ' docs (expected 50~500)' AS detail FROM u
UNION ALL SELECT 'no_empty_content', short = 0, short || ' documents with empty/short content' FROM u
UNION ALL SELECT 'sources_in_expected_set', len(unknown) = 0, 'Sources found: [' || array_to_string(sources, ', ') || ']. Unknown: '
  || CASE WHEN len(unknown) > 0 THEN '[' || array_to_string(unknown, ', ') || ']' ELSE 'None' END FROM u
UNION ALL SELECT 'content_length_in_bounds', outside = 0, outside || ' docs outside 100~100100 chars' FROM u"""


@query(_REPORT)
def quality_report(spark, d):
    return quality.quality_report(_docs(spark, d))


@query(f"""WITH r AS ({_REPORT}) SELECT count_if(passed) AS passed_checks, count(*) AS checks, count_if(NOT passed) = 0 AS passed FROM r""")
def quality_summary(spark, d):
    return quality.report_summary(quality.quality_report(_docs(spark, d)))


@query("SELECT count(*) AS documents FROM source_documents")
def quality_row_count(spark, d):
    return _docs(spark, d).agg(F.count("*").alias("documents"))


@query("SELECT id, count(*) AS copies FROM source_documents GROUP BY id HAVING count(*) > 1")
def quality_repeated_ids(spark, d):
    return quality.repeated_ids(_docs(spark, d))


_BAD = f"""list_filter([
  CASE WHEN id IS NULL THEN 'id' END,
  CASE WHEN NOT coalesce(source IN ({_SOURCES}), false) THEN 'source' END,
  CASE WHEN url IS NULL THEN 'url' END,
  CASE WHEN NOT coalesce(length(title) BETWEEN 1 AND 500, false) THEN 'title' END,
  CASE WHEN NOT coalesce(length(content) >= 50, false) THEN 'content' END,
  CASE WHEN NOT coalesce(content_type IN ({_TYPES}), false) THEN 'content_type' END], lambda v: v IS NOT NULL)"""


@query(f"SELECT id, url FROM (SELECT id, url, {_BAD} AS bad FROM source_documents) WHERE len(bad) = 0")
def validate_documents(spark, d):
    good, _ = validate.split_valid(_docs(spark, d), schema.document_rules())
    return good.select("id", "url")


@query(f"""SELECT id, array_to_string(bad, ', ') AS violations FROM (SELECT id, {_BAD} AS bad FROM source_documents) WHERE len(bad) > 0""")
def validate_rejects(spark, d):
    _, bad = validate.split_valid(_docs(spark, d), schema.document_rules())
    return bad.select("id", F.array_join("violations", ", ").alias("violations"))


@query("SELECT lower(trim(reason)) AS reason, count(*) AS records FROM quarantine GROUP BY 1")
def reject_reason_counts(spark, d):
    q = table(spark, d, "quarantine")
    return q.groupBy(F.lower(F.trim("reason")).alias("reason")).agg(F.count("*").alias("records"))


@query("SELECT s.id FROM source_documents s ANTI JOIN quarantine q ON s.url = q.url")
def corpus_skip_quarantined(spark, d):
    return _docs(spark, d).join(table(spark, d, "quarantine").select("url").distinct(), "url", "left_anti").select("id")


@query("SELECT id, 'cornell_' || list_extract(string_split(trim(url, '/'), '/'), -1) AS document_id FROM source_documents")
def doc_id_url_slug(spark, d):
    return _docs(spark, d).select("id", T.document_id("cornell_", T.url_slug(F.col("url"))).alias("document_id"))


_SLUG = "regexp_replace(replace(lower(name), ' ', '-'), '[^a-z0-9-]', '', 'g')"


@query(f"SELECT name, 'wiki-' || {_SLUG} AS document_id FROM breed_seeds")
def doc_id_name_slug_b(spark, d):
    return table(spark, d, "breed_seeds").select("name", T.document_id("wiki-", T.name_slug(F.col("name"))).alias("document_id"))


@query(f"SELECT name, 'cfa_' || {_SLUG} AS document_id FROM breed_seeds")
def doc_id_name_slug_c(spark, d):
    return table(spark, d, "breed_seeds").select("name", T.document_id("cfa_", T.name_slug(F.col("name"))).alias("document_id"))


@query(rf"""SELECT name, {strip_sql(rf"regexp_replace({strip_sql('name')}, '\[\d+\]', '', 'g')")} AS clean_name FROM breed_seeds""")
def name_cleanup(spark, d):
    return table(spark, d, "breed_seeds").select("name", T.clean_name(F.col("name")).alias("clean_name"))


@query("SELECT name || ' - CFA Breed Profile' AS title, url FROM breed_seeds WHERE registry = 'CFA'")
def breed_titles(spark, d):
    seeds = table(spark, d, "breed_seeds").filter(F.col("registry") == "CFA")
    return seeds.select(F.concat("name", F.lit(" - CFA Breed Profile")).alias("title"), "url")


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{w}') THEN '{k}'" for k, w in T.CONTENT_KEYWORDS) + " ELSE 'article' END"


@query(f"SELECT id, {_KIND} AS kind FROM source_documents")
def classify_content_type(spark, d):
    return _docs(spark, d).select("id", T.content_type(F.col("title")).alias("kind"))


@query("SELECT page_id, url <> final_url AS was_redirect, url AS original_url FROM pages")
def redirect_flag(spark, d):
    return table(spark, d, "pages").select("page_id", (F.col("url") != F.col("final_url")).alias("was_redirect"), F.col("url").alias("original_url"))


@query(f"SELECT id, len(regexp_extract_all(content, '[^{WS}]+')) AS words, length(content) AS chars, metadata.word_count AS stored FROM source_documents")
def word_counts(spark, d):
    return _docs(spark, d).select(
        "id", T.word_count(F.col("content")).cast("bigint").alias("words"), F.char_length("content").cast("bigint").alias("chars"), F.col("metadata.word_count").alias("stored")
    )


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+')) AS tokens FROM documents")
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.pretoken_count(F.col("text")).cast("bigint").alias("tokens"))


@query("SELECT id, substr(title, 1, 50) AS short, rpad(substr(title, 1, 40), 40, ' ') AS padded FROM source_documents")
def text_previews(spark, d):
    return _docs(spark, d).select("id", F.left("title", F.lit(50)).alias("short"), T.padded(F.left("title", F.lit(40)), 40).alias("padded"))


@query(
    """SELECT c.source, c.host, c.estimated_articles, count(s.id) AS documents
       FROM source_catalog c LEFT JOIN source_documents s ON s.source = c.source GROUP BY ALL"""
)
def catalog_coverage(spark, d):
    catalog = table(spark, d, "source_catalog").select("source", "host", "estimated_articles")
    counted = _docs(spark, d).groupBy("source").agg(F.count("id").alias("documents"))
    return catalog.join(counted, "source", "left").select("source", "host", "estimated_articles", F.coalesce("documents", F.lit(0).cast("bigint")).alias("documents"))


@query("SELECT unnest(content_types) AS content_type, count(*) AS sources FROM source_catalog GROUP BY 1")
def catalog_content_types(spark, d):
    return table(spark, d, "source_catalog").select(F.explode("content_types").alias("content_type")).groupBy("content_type").agg(F.count("*").alias("sources"))


@query(
    """SELECT id, 'id,source,url,title,content,content_type,scraped_at,metadata' AS fields, title, md5(content) AS content, metadata.word_count::VARCHAR AS word_count,
       strftime(scraped_at, '%Y-%m-%dT%H:%M:%S') AS second FROM source_documents"""
)
def record_json(spark, d):
    """Each document as one JSON record, nulls kept, times in ISO form; read field by field."""
    records = _docs(spark, d).select("id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("r"))
    told = lambda path: F.get_json_object("r", path)
    return records.select(
        "id", F.array_join(F.json_object_keys("r"), ",").alias("fields"), told("$.title").alias("title"), F.md5(told("$.content")).alias("content"),
        told("$.metadata.word_count").alias("word_count"), F.left(told("$.scraped_at"), F.lit(19)).alias("second"),
    )


_JSON_OK = f"""id IS NOT NULL AND source IN ({_SOURCES}) AND url IS NOT NULL AND length(title) BETWEEN 1 AND 500 AND length(content) >= 50 AND content_type IN ({_TYPES})"""


def _loaded(spark, d):
    """The corpus written as JSON records, and read again through the checks of the corpus reader."""
    path = f"{shared_dir(spark)}/tabbyline/corpus-{uuid.uuid4().hex}"
    corpus.write_documents(_docs(spark, d), path)
    return corpus.read_corpus(spark, path, quarantine=True)


@query(f"SELECT id, source, url, title, md5(content) AS content, content_type, epoch_us(scraped_at) AS scraped, metadata.word_count AS word_count FROM source_documents WHERE coalesce({_JSON_OK}, false)")
def corpus_json(spark, d):
    good, _ = _loaded(spark, d)
    return good.select("id", "source", "url", "title", F.md5("content").alias("content"), "content_type", F.unix_micros("scraped_at").alias("scraped"), "metadata.word_count")


@query(f"SELECT id, content IS NULL AS empty FROM source_documents WHERE NOT coalesce({_JSON_OK}, false)")
def corpus_json_rejects(spark, d):
    _, bad = _loaded(spark, d)
    return bad.select("id", F.col("content").isNull().alias("empty"))


@query("SELECT name, 'https://x.example/breed/' || slug || '/' AS url FROM (VALUES ('Birman', 'birman'), ('Maine Coon', 'maine-coon'), ('Sphynx', 'sphynx')) t(name, slug)")
def seed_urls(spark, d):
    """A stated list of pages (the operator reads no table)."""
    return links.seed_urls(spark, [("Birman", "birman"), ("Maine Coon", "maine-coon"), ("Sphynx", "sphynx")], "https://x.example")


@query("SELECT DISTINCT url FROM source_documents INTERSECT SELECT url FROM pages")
def urls_with_page(spark, d):
    return _docs(spark, d).select("url").intersect(table(spark, d, "pages").select("url"))


@query("SELECT source, content_type, count(*) AS documents FROM source_documents GROUP BY ROLLUP (source, content_type)")
def corpus_rollup(spark, d):
    return _docs(spark, d).rollup("source", "content_type").agg(F.count("*").alias("documents"))


@query("SELECT event_type, count(*) AS events, round(sum(value), 4) AS total, date_trunc('hour', ts) AS hour FROM events GROUP BY ALL")
def event_windows(spark, d):
    e = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour"))
    return e.agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
