"""Problem 3: lines that stand in many documents of one source.

Method: incremental tables of line counts by source. A batch of documents is a delta: what its lines add to the
counts, less the lines of earlier versions of its documents, is written beside the deltas before it. Only keys of
the delta are looked up in those, so the lines that thereby cross the threshold, upwards or downwards, are known
at once and written as events. The lines repeated now are those whose last event is upwards; after a batch only
documents that have a newly crossed line need to be built again.

Everything runs inside the JVM. Lines travel as 128-bit fingerprints, counts are combined before the
shuffle, and no task ever holds a whole line group: a line that stands in a third of all documents is
one count. When places are looked up again, lines with at least a ten-thousandth of the places of
all wanted ones, at most ten thousand of them, are broadcast; all others are joined by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabbyline.session import materialise

_KEYS = ["source", "h1", "h2"]
#: Lines with at least this share of the places of all wanted lines are broadcast; there are at most 1 / share of them.
HOT_SHARE = 1e-4


def line_form(line: Column) -> Column:
    """Equal for lines that count as the same: trimmed of blanks, tabs and \\r, each run of blanks, tabs or
    ideographic spaces as one blank, in lower case."""
    trimmed = F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", "")
    return F.lower(F.regexp_replace(trimmed, r"[ \t\x{3000}]+", " "))


def _filled(line: Column) -> Column:
    return line.rlike(r"[^\s\x{3000}\x{a0}]")


def _fingerprint(form: Column) -> list[Column]:
    return [F.xxhash64(form).alias("h1"), F.xxhash64(form, F.lit(7)).alias("h2")]


def line_places(df: DataFrame, key: str = "id", source: str = "source", text: str = "content") -> DataFrame:
    """`(source, h1, h2, id, places)`: the numbers of the lines of a form in a document, one row for each
    document and form. Null contents, null ids and blank lines have none; a null source is a source of its
    own; rows repeated under an id count once."""
    lines = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.coalesce(F.col(source).cast("string"), F.lit("\0")).alias("source"),
        F.col(key).alias("id"),
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"),
    )
    formed = lines.filter(_filled(F.col("line"))).withColumn("form", line_form(F.col("line")))
    return (
        formed.select("source", *_fingerprint(F.col("form")), "id", "line_no")
        .groupBy(*_KEYS, "id")
        .agg(F.collect_set("line_no").alias("places"))
    )


class LineCounts:
    """The incremental state: merge batches, ask for crossed lines, their places, and cleaned documents.

    path: a folder that keeps the state between sessions; what it holds is taken up again. It has a table a batch of
    each kind: lines of its documents, ids it had of earlier batches (none of the first), and what it added to the
    counts with the crossings, the last to be written, so that a merge that broke off is written over. Without a path
    the state lives in the shared folder of the session."""

    def __init__(self, spark: SparkSession, threshold: int = 5, path: str | None = None):
        self.spark = spark
        self.threshold = threshold
        self.path = path and path.rstrip("/")
        self.kept: dict[str, list[DataFrame]] = {"lines": [], "again": [], "deltas": []}
        if self.path:
            self._take_up()

    @property
    def batches(self) -> int:
        return len(self.kept["deltas"])

    def _take_up(self) -> None:
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = lambda n: jvm.org.apache.hadoop.fs.Path(f"{self.path}/deltas/{n}/_SUCCESS")
        files = at(1).getFileSystem(hadoop)
        while files.exists(at(self.batches + 1)):
            n = self.batches + 1
            for kind, tables in self.kept.items():
                if kind != "again" or n > 1:
                    tables.append(self.spark.read.parquet(f"{self.path}/{kind}/{n}"))

    def _keep(self, df: DataFrame, kind: str) -> DataFrame:
        if self.path:
            at = f"{self.path}/{kind}/{self.batches + 1}"
            df.write.mode("overwrite").parquet(at)
            written = self.spark.read.schema(df.schema).parquet(at)
        else:
            written = materialise(df, f"line-{kind}")
        return written

    def lines(self) -> DataFrame | None:
        """The lines of the last version of each document: those of a batch but for ids that came again later."""
        parts = []
        for n, lines in enumerate(self.kept["lines"]):
            later = self.kept["again"][n:]
            parts.append(lines.join(_union(later).distinct(), "id", "left_anti").select(*lines.columns) if later else lines)
        return _union(parts) if parts else None

    def merge(self, batch: DataFrame, key: str = "id", source: str = "source", text: str = "content") -> DataFrame:
        """Add a batch of documents; returns the lines that crossed the threshold upwards with it.

        A document seen before is taken back first, so that only its new version counts."""
        new = self._keep(line_places(batch, key, source, text), "lines")
        old, again = self.lines(), None
        changes = new.select(*_KEYS, F.lit(1).alias("d"))
        if old is not None:
            ids = batch.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"))
            again = self._keep(old.select("id").distinct().join(ids, "id", "left_semi"), "again")
            changes = changes.unionByName(old.join(again, "id", "left_semi").select(*_KEYS, F.lit(-1).alias("d")))
        delta = changes.groupBy(*_KEYS).agg(F.sum("d").alias("d")).filter("d <> 0")
        if old is None:
            both = delta.withColumn("was", F.lit(0).cast("bigint"))
        else:
            # earlier counts of the keys of this delta only
            was = _union(self.kept["deltas"]).join(delta.select(*_KEYS), _KEYS, "left_semi").groupBy(*_KEYS).agg(F.sum("d").alias("was"))
            both = delta.join(was, _KEYS, "left").withColumn("was", F.coalesce("was", F.lit(0)))
        over, now = F.col("was") >= self.threshold, F.col("was") + F.col("d") >= self.threshold
        told = both.select(*_KEYS, "d", F.when(over != now, now).alias("up"), F.lit(self.batches + 1).alias("batch"))
        told = self._keep(told, "deltas")
        self.kept["lines"].append(new)
        self.kept["deltas"].append(told)
        if again is not None:
            self.kept["again"].append(again)
        return told.filter("up").select(*_KEYS)

    def crossed(self) -> DataFrame:
        """All lines at or over the threshold, with their counts of documents: those whose last crossing is upwards."""
        counts = _union(self.kept["deltas"]).groupBy(*_KEYS).agg(F.sum("d").alias("n"), F.max_by("up", F.when(F.col("up").isNotNull(), F.col("batch"))).alias("up"))
        return counts.filter("up").select(*_KEYS, "n")

    def places(self, wanted: DataFrame | None = None) -> DataFrame:
        """`(id, h1, h2, places)` of the `wanted` lines (default: all crossed ones)."""
        crossed = self.crossed() if wanted is None else self.crossed().join(wanted, _KEYS, "left_semi")
        crossed = materialise(crossed, "line-wanted")
        total = crossed.agg(F.sum("n")).first()[0] or 0
        hot = F.col("n") >= max(self.threshold, total * HOT_SHARE)
        frequent = crossed.filter(hot).select(*_KEYS)  # at most 1 / HOT_SHARE rows
        rest = crossed.filter(~hot).select(*_KEYS)
        lines = self.lines()
        by_broadcast = lines.join(F.broadcast(frequent), _KEYS, "left_semi")
        by_key = lines.join(F.broadcast(frequent), _KEYS, "left_anti").join(rest, _KEYS, "left_semi")
        return by_broadcast.unionByName(by_key).select("id", "h1", "h2", "places")

    def clean(self, df: DataFrame, wanted: DataFrame | None = None, key: str = "id", text: str = "content") -> DataFrame:
        """`df` with the wanted lines taken out of `text`, wherever they stand in it. Only documents that have one are
        built again; those that were never merged have none."""
        drop = self.places(wanted).groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("__drop"))
        hit = df.join(drop.withColumnRenamed("id", "__id"), F.col(key) == F.col("__id"), "left")
        kept = F.filter(F.split(F.col(text), "\n", -1), lambda line: ~(_filled(line) & F.array_contains("__drop", F.struct(*_fingerprint(line_form(line))))))
        return hit.withColumn(text, F.when(F.col("__drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("__drop", "__id")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def counted(df: DataFrame, threshold: int = 5) -> LineCounts:
    """The state after a table of documents, merged as two deltas: the first and second halves of months."""
    state = LineCounts(df.sparkSession, threshold)
    early = F.coalesce(F.dayofmonth("scraped_at") <= 15, F.lit(False))
    for part in (early, ~early):
        state.merge(df.filter(part))
    return state


def repeated_lines(df: DataFrame, threshold: int = 5) -> DataFrame:
    """`(id, line_no)` of each line that stands in at least `threshold` documents of its source."""
    return counted(df, threshold).places().select("id", F.explode("places").alias("line_no")).distinct()


def without_repeated_lines(df: DataFrame, threshold: int = 5) -> DataFrame:
    """`(id, content)` without those lines, one row for each row of `df`."""
    return counted(df, threshold).clean(df).select("id", "content")
