"""Queries over fetched pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabbyline.functions import html as H
from tabbyline.functions import text as T
from tabbyline.operators import ingest, links
from tabbyline.plans.base import decode_sql, query, strip_sql
from tabbyline.session import table

def _without(x: str, *tags: str) -> str:
    """`x` without elements of these names. SQL has no back-references: one name after the other, none nested."""
    for tag in tags:
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    return x


_BARE = f"regexp_replace({_without('html', 'script', 'style', 'noscript', 'template')}, '(?s)<!--.*?-->', '', 'g')"


def _tagless(x: str) -> str:
    return decode_sql(f"regexp_replace({x}, '(?s)<[^>]+>', '', 'g')")


_WHOLE = rf"regexp_replace({_BARE}, '(?is)<head\b[^>]*>.*?</head\s*>|<!doctype[^>]*>', '', 'g')"
_PARTS = ", ".join(rf"nullif(regexp_extract({_BARE}, '(?is)<{part}', 1), '')" for part in (r"article\b[^>]*>(.*)</article\s*>", r"main\b[^>]*>(.*)</main\s*>", r"body\b[^>]*>(.*)"))
_CHOSEN = _without(f"coalesce({_PARTS}, {_WHOLE})", "nav", "footer", "aside", "header", "form")
_LINED = (
    rf"regexp_replace(regexp_replace({_CHOSEN}, '(?i)</?(p|br|div|h1|h2|h3|h4|li|ul|ol|tr|table|section|article)\b[^>]*>', chr(10), 'g'),"
    r" '(?i)</(td|th)\s*>', chr(9), 'g')"
)
_MAIN = f"nullif({strip_sql(rf'''regexp_replace({_tagless(_LINED)}, '[ \t]*\n\s*', chr(10), 'g')''')}, '')"
_H1 = _tagless(rf"regexp_extract({_BARE}, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1)")
_HEAD = _tagless(rf"regexp_extract({_BARE}, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)")
_TITLE = f"coalesce(nullif({_H1}, ''), nullif({strip_sql(f'''split_part({strip_sql(_HEAD)}, '|', 1)''')}, ''))"
_FIRST = """(SELECT arg_min(page_id, (url, page_id)) AS page_id, min(url) AS url, final_url FROM pages
  WHERE error IS NULL AND html IS NOT NULL GROUP BY final_url)"""


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", H.title(F.col("html")).alias("title"))


@query(f"SELECT page_id, {_MAIN} AS content FROM pages")
def page_main_text(spark, d):
    stripped = table(spark, d, "pages").select("page_id", F.inline(F.array(F.struct(H.bare(F.col("html")).alias("bare")))))
    return stripped.select("page_id", H.main_text_of(F.col("bare")).alias("content"))


@query("SELECT count(*) AS pages, count(error) AS failed, count_if(error IS NULL AND html IS NULL) AS empty, count(DISTINCT final_url) AS final_urls FROM pages")
def page_counts(spark, d):
    return table(spark, d, "pages").agg(
        F.count("*").alias("pages"), F.count("error").alias("failed"), F.count_if(F.col("error").isNull() & F.col("html").isNull()).alias("empty"), F.count_distinct("final_url").alias("final_urls")
    )


@query(f"SELECT final_url, url FROM {_FIRST}")
def page_dedup_final_url(spark, d):
    return ingest.first_per_final_url(table(spark, d, "pages")).select("final_url", "url")


_DONE = f"(SELECT f.url, f.final_url, {_MAIN} AS content, {_TITLE} AS title FROM {_FIRST} f JOIN pages p USING (page_id))"
_GOOD = f"coalesce(length({strip_sql('content')}) >= 50, false)"


@query(
    f"""SELECT 'tica_' || list_extract(string_split(trim(url, '/'), '/'), -1) AS id, url, title, length(content) AS chars, url <> final_url AS was_redirect
        FROM {_DONE} WHERE {_GOOD} AND length(title) BETWEEN 1 AND 500"""
)
def ingest_documents(spark, d):
    valid, _ = ingest.ingest_pages(table(spark, d, "pages"), "tica_breed_profiles", "tica_")
    return valid.select("id", "url", "title", F.char_length("content").cast("bigint").alias("chars"), "metadata.was_redirect")


@query(
    f"""SELECT url, 'fetch failure: ' || coalesce(error, 'no page') AS reason FROM pages WHERE error IS NOT NULL OR html IS NULL
        UNION ALL SELECT final_url, CASE WHEN NOT {_GOOD} THEN 'extraction failure' ELSE 'no title' END FROM {_DONE} WHERE NOT {_GOOD} OR title IS NULL
        UNION ALL SELECT url, 'validation: title' FROM {_DONE} WHERE {_GOOD} AND length(title) > 500"""
)
def ingest_quarantine(spark, d):
    _, bad = ingest.ingest_pages(table(spark, d, "pages"), "tica_breed_profiles", "tica_")
    return bad.select("url", "reason")


#: Pages of the tables hold no links, so each document makes an index page of its own: its heading, a link to it, and
#: links of the other kinds made of its address.
_BASE = "https://feline-health.example"
_POLICY = links.LinkPolicy(_BASE, f"{_BASE}/topics", (f"{_BASE}/about",), ("/catwatch",))
_SLUG = "list_extract(string_split(rtrim(url, '/'), '/'), -1)"
#: Parts of a link's address around the slug of the document.
_FORMS = (
    ("/topics/", ""), ("/topics/", "?x=1"), ("/node/", ""), ("/health-information/", ""), ("/health-information/", "/more"), ("/about#", ""), ("mailto:", "@b.example"),
    ("//other.example/topics/", ""), ("https://feline-health.example/topics/", ""), ("https://youtube.com/topics/", ""), ("node/", ""), ("/catwatch/node/", ""),
)


def _index(spark, d):
    docs = table(spark, d, "source_documents").filter(F.col("url").isNotNull() & F.col("title").isNotNull()).select("source", "url", "title").distinct()
    slug = F.element_at(F.split(F.rtrim(F.col("url"), F.lit("/")), "/"), -1)
    name = F.replace(F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    parts = [F.lit("<html><body><h2>"), name, F.lit("</h2><h3><a href='/x'>Linked</a></h3><h4>Plain &amp; simple</h4>")]
    for n, (before, after) in enumerate(_FORMS):
        parts += [F.lit(f"<a class='l' href='{before}"), slug, F.lit(f"{after}'> Link <b>{n}</b> </a>")]
    return docs.select("url", F.concat(*parts, F.lit("</body></html>")).alias("html")).withColumnRenamed("url", "site")


_DOCS = f"(SELECT DISTINCT source, url AS site, title, {_SLUG} AS slug FROM source_documents WHERE url IS NOT NULL AND title IS NOT NULL)"
_HREF = "CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN href WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN '%s' || href WHEN href = '' THEN '%s' ELSE '%s/' || href END" % ((_BASE,) * 3)
_SEEN = f"""(SELECT site, place, href, text, {_HREF} AS url FROM (
  SELECT site, 0 AS place, '/x' AS href, 'Linked' AS text FROM {_DOCS}
  UNION ALL SELECT site, n + 1, b || slug || a, 'Link ' || n FROM {_DOCS}, (VALUES {', '.join(f"({n}, '{b}', '{a}')" for n, (b, a) in enumerate(_FORMS))}) t(n, b, a)))"""
_WANTED = rf"""starts_with(url, '{_BASE}/') AND NOT regexp_matches(url, '#|youtube\.com|mailto:|tel:|/catwatch') AND url NOT IN ('{_BASE}/topics', '{_BASE}/about')
  AND (contains(url, '/topics/') OR contains(url, '/node/') OR regexp_matches(url, '/health-information/[^/]+$'))"""


@query(f"SELECT site, place::BIGINT AS place, href, text, url FROM {_SEEN}")
def page_links(spark, d):
    return links.page_links(_index(spark, d), _BASE).withColumn("place", F.col("place").cast("bigint"))


@query(f"SELECT DISTINCT url FROM {_SEEN} WHERE {_WANTED}")
def page_link_filter(spark, d):
    return links.article_urls(_index(spark, d), _POLICY)


@query(f"SELECT DISTINCT text, url, CASE WHEN contains(url, '/topics/') AND url <> '{_BASE}/topics' THEN 'CAUGHT' ELSE 'MISSED' END AS marker FROM {_SEEN}")
def page_link_labels(spark, d):
    return links.link_audit(_index(spark, d), _POLICY)


@query(f"SELECT count(*) AS links, count_if(contains(url, 'feline-health.example')) AS host_links FROM (SELECT DISTINCT text, url FROM {_SEEN})")
def page_link_counts(spark, d):
    return links.link_counts(_index(spark, d), _BASE, "feline-health.example")


@query(f"""SELECT site, place::BIGINT AS place, tag, text, label FROM (SELECT site, 0 AS place, 'h2' AS tag, {strip_sql('title')} AS text, 'TEXT' AS label FROM {_DOCS}
           UNION ALL SELECT site, 1, 'h3', 'Linked', 'LINKED' FROM {_DOCS} UNION ALL SELECT site, 2, 'h4', 'Plain & simple', 'TEXT' FROM {_DOCS})""")
def page_headings(spark, d):
    return links.page_headings(_index(spark, d)).withColumn("place", F.col("place").cast("bigint"))


_SEEDS = "(SELECT DISTINCT name, url FROM breed_seeds WHERE name IS NOT NULL AND url IS NOT NULL)"


@query(rf"""SELECT {strip_sql(rf"regexp_replace({strip_sql('name')}, '\[\d+\]', '', 'g')")} AS name, 'https://w.example/wiki/' || md5(url) AS url FROM {_SEEDS}""")
def breed_table(spark, d):
    """Each breed in a table of its own, beside a row without and a row with another link."""
    name = F.replace(F.replace(F.col("name"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = (F.lit("<table class='wikitable sortable'><tr><th>Breed</th></tr><tr><td><a href='/wiki/"), F.md5("url"), F.lit("'>"), name,
            F.lit("</a> </td><td>x</td></tr><tr><td>none</td></tr><tr><td><a href='/other'>y</a></td></tr></table>"))
    seeds = table(spark, d, "breed_seeds").filter(F.col("name").isNotNull() & F.col("url").isNotNull()).select("name", "url").distinct()
    return links.breed_links(seeds.select(F.concat(*rows).alias("html")), "https://w.example")


#: Pages stand in for breed pages: named after the last part of their address.
_NAMED = "(SELECT DISTINCT url, upper(list_extract(string_split(trim(url, '/'), '/'), -1)) AS name FROM pages WHERE error IS NULL AND url IS NOT NULL)"


@query(f"""SELECT b.name, 'cfa_' || regexp_replace(replace(lower(b.name), ' ', '-'), '[^a-z0-9-]', '', 'g') AS id, b.name || ' - CFA Breed Profile' AS title
           FROM (SELECT p.url, {_MAIN} AS content FROM pages p WHERE error IS NULL AND html IS NOT NULL) p JOIN {_NAMED} b USING (url) WHERE {_GOOD}""")
def breed_pages(spark, d):
    named = table(spark, d, "pages").filter(F.col("error").isNull() & F.col("url").isNotNull())
    seeds = named.select(F.upper(T.url_slug(F.col("url"))).alias("name"), "url").distinct()
    found = ingest.breed_documents(table(spark, d, "pages"), seeds, "cfa_breed_profiles", "cfa_", " - CFA Breed Profile", "CFA")
    return found.select(F.col("metadata.breed_name").alias("name"), "id", "title")


@query("SELECT page_id, list_extract(string_split(trim(url, '/'), '/'), -1) AS slug FROM pages WHERE contains(url, '/breed/')")
def page_slugs(spark, d):
    return table(spark, d, "pages").filter(F.col("url").contains("/breed/")).select("page_id", T.url_slug(F.col("url")).alias("slug"))
