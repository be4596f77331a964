"""Corpus files: JSON in, JSON out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabbyline.operators.quality import quality_report
from tabbyline.operators.validate import split_valid, strict
from tabbyline.schema import DATA_SOURCES, DOCUMENT, document_rules
from tabbyline.session import materialise, scope


#: Times are written with all their digits; files with fewer are read as well.
_TIMES = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]"


def read_corpus(spark: SparkSession, path: str, multiline: bool = False, sources: tuple[str, ...] = DATA_SOURCES, quarantine: bool = False):
    """Documents of a corpus file, checked again on reading.

    multiline: the file is one JSON array instead of a record a line; such a file can't be split, so it suits
    small corpora only. A record that can't be parsed fails the job. An invalid one fails it too, unless
    `quarantine` is set: then the result is a pair of valid and rejected documents. A missing path raises."""
    raw = spark.read.schema(DOCUMENT).option("multiLine", multiline).option("mode", "FAILFAST").option("timestampFormat", _TIMES).json(path)
    return split_valid(raw, document_rules(sources)) if quarantine else strict(raw, document_rules(sources))


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON record a line, nulls kept; replaces what is there, and writes even if there are none."""
    df.write.mode("overwrite").option("ignoreNullFields", False).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def write_failures(bad: DataFrame, path: str) -> bool:
    """The quarantine as JSON; nothing is written if it is empty. Whether something was."""
    if bad.isEmpty():
        return False
    bad.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return True


def save_corpus(df: DataFrame, path: str, **bounds) -> dict:
    """Write corpus and quality report, whatever the report says. Returns a summary.

    The documents are materialised first, as both writes and the counts read them."""
    with scope(df.sparkSession):
        docs = materialise(df, "corpus")
        report = materialise(quality_report(docs, **bounds), "report")
        write_documents(docs, f"{path}/corpus")
        report.write.mode("overwrite").json(f"{path}/report")
        counts = docs.groupBy("source").count().collect()  # one row a source
        passed = report.filter(~F.col("passed")).isEmpty()
    return {
        "total_documents": sum(r["count"] for r in counts),
        "source_breakdown": {r["source"]: r["count"] for r in counts},
        "quality_passed": passed,
        "output": f"{path}/corpus",
    }
