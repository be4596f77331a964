"""Text expressions: all are built-in columns that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip and str.split see it.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Pre-tokens, a lower bound of the tokens of a byte-pair vocabulary.
PRETOKEN = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"
#: Words of a title that decide its content type, first match first.
CONTENT_KEYWORDS = (
    ("toxicology", "poison|toxic|hazard|plant"),
    ("nutrition", "feed|nutrition|diet|obesity|food"),
    ("behavior", "behavior|aggression|litter|scratch|lick|soiling|destructive"),
    ("breed_profile", "breed|persian|siamese|maine coon"),
    ("disease", "disease|virus|cancer|diabetes|kidney|asthma|infection|fiv|leukemia|heart|liver|urinary"),
)
_DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def py_strip(text: Column) -> Column:
    """The text without white space of any kind around it."""
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def word_count(text: Column) -> Column:
    """Number of runs without white space; null for null."""
    return F.when(text.isNotNull(), F.size(F.regexp_extract_all(text, F.lit(rf"[^{SPACE}]+"), F.lit(0))))


def pretoken_count(text: Column) -> Column:
    """Number of pre-tokens; null for null."""
    return F.when(text.isNotNull(), F.size(F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))))


def url_slug(url: Column) -> Column:
    """The last part of a url's path, slashes at the ends left aside."""
    return F.element_at(F.split(F.btrim(url, F.lit("/")), "/"), -1)


def name_slug(name: Column) -> Column:
    """A name in lower case, blanks as hyphens, other characters dropped."""
    return F.regexp_replace(F.replace(F.lower(name), F.lit(" "), F.lit("-")), "[^a-z0-9-]", "")


def document_id(prefix: str, part: Column) -> Column:
    return F.concat(F.lit(prefix), part)


def clean_name(name: Column) -> Column:
    """A name without footnote marks such as [3] and white space around it."""
    return py_strip(F.regexp_replace(py_strip(name), r"\[\d+\]", ""))


def content_type(title: Column) -> Column:
    """The content type by the first group of keywords that a title holds, anywhere in it."""
    low, out = F.lower(title), F
    for kind, words in CONTENT_KEYWORDS:
        out = out.when(low.rlike(words), kind)
    return out.otherwise("article")


def chunk_id(document: Column, index: Column, text: Column) -> Column:
    """A chunk's id from its document, place and text."""
    place = index.cast("string")
    digest = F.sha2(F.concat_ws("|", document, place, text), 256)
    return F.concat_ws("__", document, place, F.substring(digest, 1, 12))


def uuid5(name: Column) -> Column:
    """The version-5 identifier of a name in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(_DNS_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 8))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3))]
    parts += [F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


def preview(text: Column, length: int) -> Column:
    return F.left(text, F.lit(length))


def padded(text: Column, width: int) -> Column:
    """Cut or filled up with blanks, to `width` at least; longer texts are kept."""
    return F.when(F.char_length(text) >= width, text).otherwise(F.rpad(text, width, " "))
