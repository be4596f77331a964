"""Validation by named rules: all violated rules of a record are told, bad records go to quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a record violates; a condition that is null is violated."""
    told = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return F.array_compact(F.array(*told))


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.withColumn("violations", violations(rules))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid records, and the others with their violations."""
    told = checked(df, rules)
    return told.filter(F.size("violations") == 0).drop("violations"), told.filter(F.size("violations") > 0)


def strict(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The records; reading an invalid one fails the job, with its violations in the message."""
    told = checked(df, rules)
    message = F.concat(F.lit("invalid record: "), F.array_join("violations", ", "))
    kept = told.withColumn("__ok", F.when(F.size("violations") == 0, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    return kept.filter("__ok").drop("violations", "__ok")


def quarantine(bad: DataFrame, source: Column, key: Column, url: Column, final_url: Column) -> DataFrame:
    """Rejected records in the form of the quarantine table."""
    reason = F.concat(F.lit("validation: "), F.array_join("violations", ", "))
    return bad.select(source.alias("source"), key.alias("key"), url.alias("url"), final_url.alias("final_url"), reason.alias("reason"))
