"""Queries of the training-data problems; `__spark_entry__.py` adds them where this package is present."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabbyline.llm.budget import miscounted, token_budget
from tabbyline.llm.encode import encode_corpus
from tabbyline.llm.furniture import furniture_lines, main_body
from tabbyline.llm.lookalike import lookalike_classes, lookalike_pairs, normalize_documents
from tabbyline.llm.pack import fills, pack_documents, too_large
from tabbyline.llm.quality import not_prose, quality_table
from tabbyline.llm.repeated import repeated_lines, without_repeated_lines
from tabbyline.llm.residue import residue_documents, without_residue
from tabbyline.llm.similar import SimilarityIndex, similar_pairs
from tabbyline.llm.split import oversized, split_documents
from tabbyline.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized(table(spark, sf_dir, "source_documents"))


def p1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(table(spark, sf_dir, "source_documents"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_prose(table(spark, sf_dir, "source_documents"))


def p2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_table(table(spark, sf_dir, "source_documents"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "source_documents"))


def p3_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_lines(table(spark, sf_dir, "source_documents"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return miscounted(table(spark, sf_dir, "chunks"))


def p4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_budget(table(spark, sf_dir, "chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(table(spark, sf_dir, "chunks"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SimilarityIndex(table(spark, sf_dir, "chunks")).classes().withColumnRenamed("k", "id")


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth chunk (by the hash of its id, ids being strings), against all."""
    found = SimilarityIndex(table(spark, sf_dir, "chunks")).nearest(F.pmod(F.xxhash64("k"), 100) == 0)
    return found.withColumnsRenamed({"k_a": "id", "k_b": "neighbour_id"})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_documents(table(spark, sf_dir, "source_documents"))


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_residue(table(spark, sf_dir, "source_documents")).select("id", "source", "content")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture_lines(table(spark, sf_dir, "source_documents"))


def p7_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_body(table(spark, sf_dir, "source_documents"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return too_large(table(spark, sf_dir, "documents"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def p9_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fills(pack_documents(table(spark, sf_dir, "documents")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(table(spark, sf_dir, "documents"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_classes(table(spark, sf_dir, "documents"))


def p10_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_chunks": p1_chunks,
    "p2_found": p2_found,
    "p2_statistics": p2_statistics,
    "p3_found": p3_found,
    "p3_cleaned": p3_cleaned,
    "p4_found": p4_found,
    "p4_totals": p4_totals,
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p5_neighbours": p5_neighbours,
    "p6_found": p6_found,
    "p6_kept": p6_kept,
    "p7_found": p7_found,
    "p7_bodies": p7_bodies,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_containers": p9_containers,
    "p9_fills": p9_fills,
    "p10_found": p10_found,
    "p10_classes": p10_classes,
    "p10_normalized": p10_normalized,
}

#: SQL of those that plain SQL can express over whole tables; the tests hold the others against brute force.
ORACLE_SQL: dict[str, str] = {
    "p3_found": r"""WITH l AS (
      SELECT id, coalesce(source, chr(1)) AS source, n AS line_no, line,
        lower(regexp_replace(regexp_replace(line, '^[ \t\r]+|[ \t\r]+$', '', 'g'), '[ \t\x{3000}]+', ' ', 'g')) AS form
      FROM (SELECT id, source, unnest(string_split(content, chr(10))) AS line, (unnest(range(len(string_split(content, chr(10)))))) AS n
            FROM source_documents WHERE content IS NOT NULL AND id IS NOT NULL)),
    k AS (SELECT * FROM l WHERE regexp_matches(line, '[^\s\x{3000}\x{a0}]')),
    c AS (SELECT source, form FROM k GROUP BY source, form HAVING count(DISTINCT id) >= 5)
    SELECT DISTINCT id, line_no::INTEGER AS line_no FROM k SEMI JOIN c USING (source, form)""",
    "p5_found": """WITH v AS (SELECT id, embedding::DOUBLE[] AS e FROM chunks WHERE id IS NOT NULL AND len(embedding) = 64
      AND len(list_filter(embedding, lambda x: x IS NULL)) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    u AS (SELECT DISTINCT id, e FROM v)
    SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM u a JOIN u b ON a.id < b.id AND list_cosine_similarity(a.e, b.e) >= 0.9""",
}
