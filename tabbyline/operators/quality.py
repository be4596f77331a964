"""The report on a corpus: four checks and a breakdown in one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabbyline.functions.text import py_strip
from tabbyline.schema import DATA_SOURCES, MIN_DOCUMENT_CHARS

#: Default bounds of the checks (fixed values).
MIN_ROWS, MAX_ROWS, MIN_CHARS, MAX_CHARS = 50, 500, 100, 100_100


def _measures(df: DataFrame, content: str, source: str, min_chars: int, max_chars: int) -> DataFrame:
    length = F.char_length(content)
    short = F.col(content).isNull() | (F.char_length(py_strip(F.col(content))) < MIN_DOCUMENT_CHARS)
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(short).alias("short"),
        F.array_sort(F.collect_set(source)).alias("sources"),
        F.count_if(length.isNull() | (length < min_chars) | (length > max_chars)).alias("outside"),
    )


def quality_report(
    df: DataFrame,
    content: str = "content",
    source: str = "source",
    sources: tuple[str, ...] = DATA_SOURCES,
    min_rows: int = MIN_ROWS,
    max_rows: int = MAX_ROWS,
    min_chars: int = MIN_CHARS,
    max_chars: int = MAX_CHARS,
) -> DataFrame:
    """`(check, passed, detail)`, four rows. An empty corpus fails the row count only.

    Only the names of sources are gathered, which are few by the nature of a source."""
    m = _measures(df, content, source, min_chars, max_chars)
    unknown = F.array_except("sources", F.array(*map(F.lit, sources)))
    listed = lambda a: F.concat(F.lit("["), F.array_join(a, ", "), F.lit("]"))
    checks = [
        ("row_count_range", F.col("n").between(min_rows, max_rows), F.format_string(f"%d docs (expected {min_rows}~{max_rows})", "n")),
        ("no_empty_content", F.col("short") == 0, F.format_string("%d documents with empty/short content", "short")),
        (
            "sources_in_expected_set",
            F.size(unknown) == 0,
            F.concat(F.lit("Sources found: "), listed(F.col("sources")), F.lit(". Unknown: "), F.when(F.size(unknown) > 0, listed(unknown)).otherwise("None")),
        ),
        ("content_length_in_bounds", F.col("outside") == 0, F.format_string(f"%d docs outside {min_chars}~{max_chars} chars", "outside")),
    ]
    rows = F.array(*(F.struct(F.lit(n).alias("check"), p.alias("passed"), d.alias("detail")) for n, p, d in checks))
    return m.select(F.explode(rows).alias("r")).select("r.check", "r.passed", "r.detail")


def report_summary(report: DataFrame) -> DataFrame:
    """Checks passed, checks in all, and whether all passed."""
    return report.agg(
        F.count_if("passed").alias("passed_checks"), F.count("*").alias("checks"), (F.count_if(~F.col("passed")) == 0).alias("passed")
    )


def source_breakdown(df: DataFrame, source: str = "source") -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("documents"))


def outside_length(df: DataFrame, content: str = "content", min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> DataFrame:
    """The documents whose length is out of bounds."""
    length = F.char_length(content)
    return df.filter(length.isNull() | (length < min_chars) | (length > max_chars))


def unknown_sources(df: DataFrame, sources: tuple[str, ...] = DATA_SOURCES, source: str = "source") -> DataFrame:
    return df.select(source).filter(F.col(source).isNotNull()).distinct().filter(~F.col(source).isin(*sources))


def repeated_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """Ids with more than one row, an optional check beside the report."""
    return df.groupBy(key).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)
