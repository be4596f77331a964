"""Experiment records as rows that can be appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_rows(measured: DataFrame, run: str, kind: str = "metric") -> DataFrame:
    """One row `(run, kind, key, value)` for each column of a one-row table."""
    pairs = F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in measured.columns))
    return measured.select(F.explode(pairs).alias("p")).select(F.lit(run).alias("run"), F.lit(kind).alias("kind"), "p.key", "p.value")


def run_rows(measured: DataFrame, run: str, params: dict[str, object] | None = None, tags: dict[str, object] | None = None) -> DataFrame:
    """The record of a run: its parameters, its tags and the metrics of a one-row table."""
    stated = [(run, kind, key, str(value)) for kind, pairs in (("param", params), ("tag", tags)) for key, value in (pairs or {}).items()]
    return measured.sparkSession.createDataFrame(stated, "run string, kind string, key string, value string").unionByName(metric_rows(measured, run))


def log_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
