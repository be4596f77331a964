"""Streams of pages and chunks on the same transformations as in batch (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabbyline.operators.ingest import extracted
from tabbyline.operators.store import Collection
from tabbyline.schema import usable


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """New page files below `path`, with the time they were fetched."""
    return spark.readStream.schema("page_id bigint, url string, final_url string, html string, error string, fetched_at timestamp").parquet(path)


def stream_documents(pages: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Usable documents, one for each final url within the watermark; later repeats are dropped with their state."""
    fetched = pages.filter(F.col("error").isNull() & F.col("html").isNotNull())
    once = fetched.withWatermark("fetched_at", lateness).dropDuplicatesWithinWatermark(["final_url"])
    done = extracted(once)
    return done.filter(usable(F.col("content")) & F.col("title").isNotNull())


def stream_counts(pages: DataFrame, window: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Pages and failures by window of the fetch time."""
    timed = pages.withWatermark("fetched_at", lateness).groupBy(F.window("fetched_at", window).alias("w"))
    counts = timed.agg(F.count("*").alias("pages"), F.count("error").alias("failed"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "pages", "failed")


def upsert_stream(chunks: DataFrame, collection: Collection, checkpoint: str) -> StreamingQuery:
    """Upsert a stream of embedded chunks: ids are derived from content, so a repeated batch changes nothing."""
    return chunks.writeStream.foreachBatch(lambda batch, _: collection.upsert(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
