"""From fetched pages to documents and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabbyline import schema
from tabbyline.functions import html as H
from tabbyline.functions import text as T
from tabbyline.operators.validate import quarantine, split_valid


def first_per_final_url(pages: DataFrame) -> DataFrame:
    """One page of each final url: the first fetched one by url. Failed fetches are left out.

    A page counts as seen before it is extracted, so one that yields nothing still hides the later ones. Final
    urls of several pages are found from the urls alone; only their pages are compared, by an aggregate with
    map-side combine, so that a final url of many pages is no hot task. All others stay where they are."""
    fetched = pages.filter(F.col("error").isNull() & F.col("html").isNotNull())
    key = F.coalesce("final_url", F.lit("\0")).alias("__key")
    several = fetched.select(key).groupBy("__key").count().filter("count > 1").select("__key")
    keyed = fetched.withColumn("__key", key)
    rest = [c for c in pages.columns if c not in ("final_url", "url")]
    first = keyed.join(several, "__key", "left_semi").groupBy("final_url").agg(F.min(F.struct("url", *rest)).alias("p"))
    order = ["url", "final_url", *rest]
    return keyed.join(several, "__key", "left_anti").select(*order).unionByName(first.select("p.url", "final_url", *(F.col(f"p.{c}") for c in rest)).select(*order))


def extracted(pages: DataFrame) -> DataFrame:
    """Pages with `content` and `title`, null where there is none.

    The bare page and what is found in it come out of generators, which the optimiser doesn't look through, so that
    each is computed once however often it is used afterwards."""
    rest = [c for c in pages.columns if c not in ("html", "content", "title")]
    stripped = pages.select(*rest, F.inline(F.array(F.struct(H.bare(F.col("html")).alias("__bare")))))
    found = F.struct(H.main_text_of(F.col("__bare")).alias("content"), H.title_of(F.col("__bare")).alias("title"))
    return stripped.select(*rest, F.inline(F.array(found)))


def metadata(content: Column, url: Column, final_url: Column, breed: Column | None = None, registry: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        T.word_count(content).cast("int").alias("word_count"),
        F.char_length(content).alias("char_count"),
        url.alias("original_url"),
        (url != final_url).alias("was_redirect"),
        (breed if breed is not None else null).alias("breed_name"),
        (registry if registry is not None else null).alias("registry"),
    )


def ingest_pages(pages: DataFrame, source: str, prefix: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents of one source, and the quarantine of its failures.

    most: only the first so many urls (0 and None: all), taken before anything is extracted."""
    todo = pages.orderBy("url").limit(most) if most else pages
    failed = todo.filter(F.col("error").isNotNull() | F.col("html").isNull())
    failed = failed.select("url", F.lit(None).cast("string").alias("final_url"), F.concat(F.lit("fetch failure: "), F.coalesce("error", F.lit("no page"))).alias("reason"))
    done = extracted(first_per_final_url(todo))
    good = schema.usable(F.col("content"))
    lost = done.filter(~good | F.col("title").isNull()).select(
        F.col("final_url").alias("url"), "final_url", F.when(~good, "extraction failure").otherwise("no title").alias("reason")
    )
    documents = done.filter(good & F.col("title").isNotNull()).select(
        T.document_id(prefix, T.url_slug(F.col("url"))).alias("id"),
        F.lit(source).alias("source"),
        "url",
        "title",
        "content",
        T.content_type(F.col("title")).alias("content_type"),
        F.current_timestamp().alias("scraped_at"),
        metadata(F.col("content"), F.col("url"), F.col("final_url")).alias("metadata"),
        "final_url",
    )
    valid, bad = split_valid(documents, schema.document_rules((*schema.DATA_SOURCES, source)))
    rejected = quarantine(bad, F.col("source"), F.col("id"), F.col("url"), F.col("final_url"))
    failures = failed.unionByName(lost).select(F.lit(source).alias("source"), F.lit(None).cast("string").alias("key"), "url", "final_url", "reason")
    return valid.drop("final_url"), failures.unionByName(rejected)


def breed_documents(pages: DataFrame, breeds: DataFrame, source: str, prefix: str, title_suffix: str = "", registry: str | None = None) -> DataFrame:
    """Documents of a list of breeds `(name, url)` joined to their pages: title and id come from the name."""
    done = extracted(pages.filter(F.col("error").isNull() & F.col("html").isNotNull())).drop("title").join(breeds, "url")
    name = F.col("name")
    return done.filter(schema.usable(F.col("content"))).select(
        T.document_id(prefix, T.name_slug(name)).alias("id"),
        F.lit(source).alias("source"),
        "url",
        F.concat(name, F.lit(title_suffix)).alias("title"),
        "content",
        F.lit("breed_profile").alias("content_type"),
        F.current_timestamp().alias("scraped_at"),
        metadata(F.col("content"), F.col("url"), F.col("final_url"), name, F.lit(registry)).alias("metadata"),
    )


def union_sources(*sources: DataFrame) -> DataFrame:
    """All documents of all sources, repeated ones included."""
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more)
    return out


def first_per_source(df: DataFrame, most: int | None, *order: str) -> DataFrame:
    """The first `most` rows of each source (0 and None: all). Rows beyond are dropped before the shuffle."""
    if not most:
        return df
    place = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    return df.withColumn("__place", place).filter(F.col("__place") <= most).drop("__place")
