"""Exact cosine search over a table of vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabbyline.functions.vectors import cosine
from tabbyline.session import ensure_shipped

#: Up to so many queries travel with the tasks; more are met with the points block by block.
SHIPPED_QUERIES = 4_096
#: Rows of a block of queries and of a block of points.
QUERY_BLOCK, POINT_BLOCK = 4_096, 65_536


def search(points: DataFrame, query: Sequence[float], k: int = 5, where: Column | None = None, key: str = "point_id", vector: str = "vector") -> DataFrame:
    """The `k` points most similar to one query vector, with `score`, best first, ties by key.

    A filter on payload columns comes before the ranking and reaches the scan. The plan is one pass and a
    top-k for each partition."""
    chosen = points if where is None else points.filter(where)
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = chosen.withColumn("score", cosine(F.col(vector), q)).filter(F.col("score").isNotNull() & ~F.isnan("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def search_batch(points: DataFrame, queries: DataFrame | Sequence[tuple[object, Sequence[float]]], k: int = 5, key: str = "point_id", vector: str = "vector", key_type: str = "string", query_type: str = "bigint", digits: int = 9) -> DataFrame:
    """`(query_id, key, score, rank)` of the `k` points most similar to each of a set of queries: a list of id and
    vector, or a table whose first two columns are these.

    Points are scored in blocks by one matrix product, each block keeps its best `k` for each query, and the best of
    those are ranked. Up to `SHIPPED_QUERIES` travel with the tasks, and points stay where they are. Any number more are
    cut into blocks that meet the blocks of points; none is ever collected. Scores are rounded to `digits` before
    ranking, ties go by key. Vectors of zeros or another length than the point's are left out."""
    spark = points.sparkSession
    ensure_shipped(spark)
    sides = points.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    schema = f"query_id {query_type}, k {key_type}, score double"
    if isinstance(queries, DataFrame):
        asked = queries.toDF("k", "v").select(F.col("k").cast(query_type), F.col("v").cast("array<double>"))
        first = asked.limit(SHIPPED_QUERIES + 1).collect()  # bounded
        listed = None if len(first) > SHIPPED_QUERIES else [(r["k"], r["v"]) for r in first]
    else:
        listed = list(queries) if len(queries) <= SHIPPED_QUERIES else None
        asked = None if listed is not None else spark.createDataFrame([(q, [float(x) for x in v]) for q, v in queries], f"k {query_type}, v array<double>")
    if listed is not None:
        ids, matrix = _unit([q for q, _ in listed], [v for _, v in listed])

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield from _best(ids, matrix, *_unit(batch["k"], batch["v"]), k, digits)

        found = sides.mapInPandas(score, schema)
    else:
        found = _in_blocks(sides, asked, k, digits, schema)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "k")))
    return ranked.filter(F.col("rank") <= k).withColumnRenamed("k", key)


def _unit(keys: Sequence, vectors: Sequence) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys and unit vectors; those that are null, not finite or zero have no vector."""
    units = []
    for v in vectors:
        x = np.asarray([] if v is None else v, np.float64)
        norm = np.linalg.norm(x)
        units.append(x / norm if np.isfinite(norm) and norm > 0 else None)
    return np.array(list(keys), dtype=object), units


def _best(ids: np.ndarray, asked: list[np.ndarray], keys: np.ndarray, held: list[np.ndarray], k: int, digits: int) -> Iterator[pd.DataFrame]:
    """The best `k` of the held vectors for each asked one of the same length."""
    for dim in {len(v) for v in asked if v is not None}:
        q = [n for n, v in enumerate(asked) if v is not None and len(v) == dim]
        p = [n for n, v in enumerate(held) if v is not None and len(v) == dim]
        if not p:
            continue
        scores = np.round(np.stack([asked[n] for n in q]) @ np.stack([held[n] for n in p]).T, digits)
        names = keys[p]
        order = np.argsort(names, kind="stable")
        n = min(k, len(p))
        best = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :n]]
        yield pd.DataFrame({"query_id": np.repeat(ids[q], n), "k": names[best.ravel()], "score": np.take_along_axis(scores, best, 1).ravel()})


def _in_blocks(points: DataFrame, queries: DataFrame, k: int, digits: int, schema: str) -> DataFrame:
    """Each block of queries against each block of points; the copies of a side are as many as the other has blocks."""
    n, m = queries.count(), points.count()
    qn, pn = max(1, -(-n // QUERY_BLOCK)), max(1, -(-m // POINT_BLOCK))

    def side(df: DataFrame, own: str, blocks: int, other: str, copies: int) -> DataFrame:
        spread = df.withColumn(own, F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
        return spread.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    q, x = side(queries, "qb", qn, "pb", pn).groupBy("qb", "pb"), side(points, "pb", pn, "qb", qn).groupBy("qb", "pb")

    def meet(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = list(_best(*_unit(asked["k"], asked["v"]), *_unit(held["k"], held["v"]), k, digits))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "k": [], "score": []})

    return q.cogroup(x).applyInPandas(meet, schema)


def hits(found: DataFrame, length: int = 200) -> DataFrame:
    """The report of a search: rank, score to four digits, source, title and the beginning of the text."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "point_id"))  # of k rows
    return found.select(rank.alias("rank"), F.round("score", 4).alias("score"), "source", "title", F.left("content", F.lit(length)).alias("preview"))


def mean_top_score(ranked: DataFrame) -> DataFrame:
    """Mean of the best scores of all queries."""
    return ranked.filter(F.col("rank") == 1).agg(F.avg("score").alias("mean_top_score"))
