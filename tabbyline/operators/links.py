"""Discovery: which pages to fetch."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabbyline.functions.html import headings, links, resolve, wiki_rows
from tabbyline.functions.text import clean_name


@dataclass(frozen=True)
class LinkPolicy:
    """What makes a link of an index page an article of its site."""

    base: str
    index: str
    skip_urls: tuple[str, ...] = ()
    skip_parts: tuple[str, ...] = ()
    markers: tuple[str, ...] = ("#", "youtube.com", "mailto:", "tel:")
    topic_part: str = "/topics/"
    node_part: str = "/node/"
    section_part: str = "/health-information/"

    def wanted(self, url: Column) -> Column:
        """On the site, without a marker, not skipped, and of one of three forms: below the topics, a node,
        or directly below the section."""
        last = F.substring_index(url, self.section_part.lstrip("/"), -1)
        form = url.contains(self.topic_part) & (url != self.index)
        form |= url.contains(self.node_part)
        form |= url.contains(self.section_part) & (last != "") & ~last.contains("/")
        bad = F.lit(False)
        for part in (*self.markers, *self.skip_parts):
            bad |= url.contains(part)
        skipped = url.isin(self.index, *self.skip_urls)
        return url.startswith(self.base.rstrip("/") + "/") & ~bad & ~skipped & form


def page_links(pages: DataFrame, base: str, html: str = "html") -> DataFrame:
    """`(place, href, text, url)` of each link, beside the page's own columns but for its source text."""
    rest = [c for c in pages.columns if c != html]
    found = pages.select(*rest, F.posexplode(links(F.col(html))).alias("place", "link"))
    return found.select(*rest, "place", "link.href", "link.text", resolve(base, F.col("link.href")).alias("url"))


def article_urls(pages: DataFrame, policy: LinkPolicy, most: int | None = None) -> DataFrame:
    """Distinct wanted urls in order, the first `most` of them (0 and None: all)."""
    urls = page_links(pages, policy.base).select("url").filter(policy.wanted(F.col("url"))).distinct()
    ordered = urls.orderBy("url")
    return ordered.limit(most) if most else ordered


def breed_links(pages: DataFrame, wiki_base: str, html: str = "html") -> DataFrame:
    """`(name, url)` of the rows of the first wikitable whose first cell links to an article, in order.

    A page without such a table fails the job."""
    rows = wiki_rows(F.col(html))
    told = F.when(rows.isNull(), F.raise_error(F.lit("no wikitable on the page")).cast("array<struct<name:string,href:string>>")).otherwise(rows)
    found = pages.select(F.posexplode(told).alias("place", "row")).filter(F.col("row.href").startswith("/wiki/"))
    return found.orderBy("place").select(clean_name(F.col("row.name")).alias("name"), F.concat(F.lit(wiki_base), F.col("row.href")).alias("url"))


def seed_urls(spark, seeds: Sequence[tuple[str, str]], base: str) -> DataFrame:
    """`(name, url)` of a stated list of names and slugs."""
    listed = spark.createDataFrame(list(seeds), "name string, slug string")
    return listed.select("name", F.concat(F.lit(f"{base}/breed/"), F.col("slug"), F.lit("/")).alias("url"))


def link_audit(pages: DataFrame, policy: LinkPolicy) -> DataFrame:
    """Distinct `(text, url)` of all links with whether discovery by topic catches them."""
    seen = page_links(pages, policy.base).select(F.left("text", F.lit(50)).alias("text"), "url").distinct()
    caught = F.col("url").contains(policy.topic_part) & (F.col("url") != policy.index)
    return seen.withColumn("marker", F.when(caught, "CAUGHT").otherwise("MISSED"))


def link_counts(pages: DataFrame, base: str, host: str) -> DataFrame:
    """Distinct links, and those that name the host."""
    seen = page_links(pages, base).select(F.left("text", F.lit(50)).alias("text"), "url").distinct()
    return seen.agg(F.count("*").alias("links"), F.count_if(F.col("url").contains(host)).alias("host_links"))


def page_headings(pages: DataFrame, html: str = "html") -> DataFrame:
    """Headings of levels 2 to 4 in order with whether they hold a link."""
    rest = [c for c in pages.columns if c != html]
    found = pages.select(*rest, F.posexplode(headings(F.col(html))).alias("place", "h"))
    return found.select(*rest, "place", "h.tag", "h.text", F.when(F.col("h.linked"), "LINKED").otherwise("TEXT").alias("label"))
