"""Record schemas and the rules a valid record meets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabbyline.functions.text import py_strip

PIPELINE_VERSION = "0.1.0"
#: The sources and content types that a valid record may name.
DATA_SOURCES = ("cornell_feline_health", "wikipedia_cat_breeds", "cfa_breed_profiles", "aspca_toxicology", "merck_vet_manual")
CONTENT_TYPES = ("article", "breed_profile", "toxicology", "nutrition", "disease", "behavior")

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "vector": T.ArrayType(T.FloatType()),
}


def struct(fields: str, required: str = "", **nested: T.DataType) -> T.StructType:
    """A schema from `name:type` pairs (string if no type is given); no session is needed for it."""
    out = []
    for field in fields.split():
        name, _, kind = field.partition(":")
        out.append(T.StructField(name, nested[name] if name in nested else _TYPES[kind or "string"], name not in required.split()))
    return T.StructType(out)


_META = "word_count:int char_count:int original_url was_redirect:boolean breed_name registry"
DOCUMENT = struct(
    "id source url title content content_type scraped_at:timestamp metadata", "id source url title content content_type", metadata=struct(_META)
)
CHUNK = struct(
    "id document_id source content content_type chunk_index:int token_count:int embedding:vector embedding_model pipeline_version created_at:timestamp metadata",
    metadata=struct(f"title url total_chunks:int {_META}"),
)
POINT = struct("point_id vector:vector chunk_id document_id source content content_type chunk_index:int token_count:int title url")
PAGE = struct("url final_url html error")
QUARANTINE = struct("source key url final_url reason")
METRICS = struct("run kind key value")
HIT = struct("chunk_id content source score:double document_title url")
RESPONSE = struct(
    "answer retrieved_chunks query model_used latency_ms:double config_snapshot created_at:timestamp trace_id", retrieved_chunks=T.ArrayType(HIT)
)

#: Bounds of valid records (fixed values).
MIN_DOCUMENT_CHARS, MAX_TITLE_CHARS, MIN_CHUNK_CHARS, MAX_CHUNK_TOKENS = 50, 500, 10, 2048


def document_rules(sources: tuple[str, ...] = DATA_SOURCES) -> dict[str, Column]:
    """Rule name to the condition that a valid document meets."""
    return {
        "id": F.col("id").isNotNull(),
        "source": F.col("source").isin(*sources),
        "url": F.col("url").isNotNull(),
        "title": F.char_length("title").between(1, MAX_TITLE_CHARS),
        "content": F.char_length("content") >= MIN_DOCUMENT_CHARS,
        "content_type": F.col("content_type").isin(*CONTENT_TYPES),
    }


def chunk_rules(sources: tuple[str, ...] = DATA_SOURCES) -> dict[str, Column]:
    """Rule name to the condition that a valid chunk meets."""
    return {
        "id": F.col("id").isNotNull(),
        "document_id": F.col("document_id").isNotNull(),
        "source": F.col("source").isin(*sources),
        "content": F.char_length("content") >= MIN_CHUNK_CHARS,
        "content_type": F.col("content_type").isin(*CONTENT_TYPES),
        "chunk_index": F.col("chunk_index") >= 0,
        "token_count": F.col("token_count") > 0,
        "token_count_bound": F.col("token_count") <= MAX_CHUNK_TOKENS,
        "pipeline_version": F.col("pipeline_version").isNotNull(),
    }


def response_rules() -> dict[str, Column]:
    """Rule name to the condition that a valid response meets."""
    required = ("answer", "retrieved_chunks", "query", "model_used", "config_snapshot")
    return {c: F.col(c).isNotNull() for c in required} | {"latency_ms": F.col("latency_ms") >= 0}


def usable(content: Column) -> Column:
    """Whether an extracted text is long enough without the white space around it."""
    return F.coalesce(F.char_length(py_strip(content)) >= MIN_DOCUMENT_CHARS, F.lit(False))
