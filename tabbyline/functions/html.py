"""Extraction from pages by patterns that don't rely on balanced tags."""

from __future__ import annotations

import html as _html
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tabbyline.functions.text import py_strip

#: Entities decoded by expression, the ampersand last; `unescape` knows them all.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
DROPPED = r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>"
COMMENT = r"(?s)<!--.*?-->"
#: An element of page furniture that holds none of its own kind, with its own closing tag. The possessive group is
#: matched in a loop, so that long elements need no stack.
FURNITURE = r"(?is)<(nav|footer|aside|header|form)\b[^>]*>[^<]*+(?:<(?!/?\1\b)[^<]*+)*+</\1\s*>"
#: So deep may furniture of one kind be nested.
NESTED = 3
#: From the first opening to the last closing tag.
ARTICLE = r"(?is)<article\b[^>]*>(.*)</article\s*>"
MAIN = r"(?is)<main\b[^>]*>(.*)</main\s*>"
BODY = r"(?is)<body\b[^>]*>(.*)"
HEAD = r"(?is)<head\b[^>]*>.*?</head\s*>|<!doctype[^>]*>"
BLOCK = r"(?i)</?(p|br|div|h1|h2|h3|h4|li|ul|ol|tr|table|section|article)\b[^>]*>"
CELL = r"(?i)</(td|th)\s*>"
TAG = r"(?s)<[^>]+>"
LINK = r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>"
HEADING = r"(?is)<(h[2-4])\b[^>]*>(.*?)</h[2-4]\s*>"
WIKI_TABLE = r"(?is)<table\b[^>]*class\s*=\s*[\"'][^\"']*wikitable[^\"']*[\"'][^>]*>(.*?)</table\s*>"
ROW = r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"
FIRST_CELL = r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"


def decode(text: Column) -> Column:
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def inner_text(fragment: Column) -> Column:
    """The text of a fragment: tags removed, entities decoded."""
    return decode(F.regexp_replace(fragment, TAG, ""))


def bare(page: Column) -> Column:
    """The page without scripts, styles and comments, which may hold tags."""
    return F.regexp_replace(F.regexp_replace(page, DROPPED, ""), COMMENT, "")


def main_text(page: Column) -> Column:
    """The main text of a page; null if it has none.

    Of the `bare` page the articles if there are any, else the main element, else the body (the whole but for its head
    where no body is opened); of that, without navigation, footer and the like, innermost first; block tags end
    lines, cells are divided by tabs."""
    return main_text_of(bare(page))


def main_text_of(page: Column) -> Column:
    """`main_text` of a page that is bare already."""
    found = [F.nullif(F.regexp_extract(page, part, 1), F.lit("")) for part in (ARTICLE, MAIN, BODY)]
    chosen = F.coalesce(*found, F.regexp_replace(page, HEAD, ""))
    for _ in range(NESTED):
        chosen = F.regexp_replace(chosen, FURNITURE, "")
    lined = F.regexp_replace(F.regexp_replace(chosen, BLOCK, "\n"), CELL, "\t")
    text = py_strip(F.regexp_replace(inner_text(lined), r"[ \t]*\n\s*", "\n"))
    return F.nullif(text, F.lit(""))


def title(page: Column) -> Column:
    """The first h1 as it stands, else the page title up to the first bar; null if there is neither.

    A heading of white space alone is a heading."""
    return title_of(bare(page))


def title_of(page: Column) -> Column:
    """`title` of a page that is bare already."""
    heading = inner_text(F.regexp_extract(page, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1))
    head = inner_text(F.regexp_extract(page, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))
    first = py_strip(F.split_part(py_strip(head), F.lit("|"), F.lit(1)))
    return F.coalesce(F.nullif(heading, F.lit("")), F.nullif(first, F.lit("")))


def links(page: Column) -> Column:
    """Links of a page in order, as an array of `(href, text)`."""
    whole = F.regexp_extract_all(page, F.lit(LINK), F.lit(0))
    return F.transform(
        whole, lambda a: F.struct(decode(F.regexp_extract(a, LINK, 1)).alias("href"), py_strip(inner_text(F.regexp_extract(a, LINK, 2))).alias("text"))
    )


def headings(page: Column) -> Column:
    """Headings of levels 2 to 4 in order, as an array of `(tag, text, linked)`."""
    whole = F.regexp_extract_all(page, F.lit(HEADING), F.lit(0))
    return F.transform(
        whole,
        lambda h: F.struct(
            F.lower(F.regexp_extract(h, HEADING, 1)).alias("tag"),
            py_strip(inner_text(F.regexp_extract(h, HEADING, 2))).alias("text"),
            h.rlike(r"(?i)<a[\s>]").alias("linked"),
        ),
    )


def wiki_rows(page: Column) -> Column:
    """First cells `(name, href)` of the rows of the first wikitable, header row left out; null without a table."""
    table = F.regexp_extract(page, WIKI_TABLE, 1)
    rows = F.regexp_extract_all(table, F.lit(ROW), F.lit(1))
    body = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
    cells = F.transform(body, lambda r: F.regexp_extract(r, FIRST_CELL, 1))
    named = F.transform(cells, lambda c: F.struct(inner_text(c).alias("name"), F.regexp_extract(c, LINK, 1).alias("href")))
    return F.when(table != "", named)


def resolve(base: str, href: Column) -> Column:
    """A link against a site root, for the usual forms: absolute, scheme-relative, rooted, relative."""
    scheme = base.split("//", 1)[0]
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.lit(scheme), href))
        .when(href.startswith("/"), F.concat(F.lit(base.rstrip("/")), href))
        .when(href == "", F.lit(base))
        .otherwise(F.concat(F.lit(base.rstrip("/") + "/"), href))
    )


def resolve_exact(base: str, href: Column) -> Column:
    """A link against a base by all the rules of the standard, in Arrow batches."""

    @F.pandas_udf(StringType())
    def join(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda h: None if h is None else urljoin(base, h))

    return join(href)


def unescape(text: Column) -> Column:
    """All named and numbered entities, in Arrow batches."""

    @F.pandas_udf(StringType())
    def plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else _html.unescape(t))

    return plain(text)
