"""Recursive chunking: cut at the most natural separator that gives pieces under the size."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tabbyline.config import SEPARATORS, ChunkingConfig
from tabbyline.functions.text import PRETOKEN, chunk_id
from tabbyline.schema import PIPELINE_VERSION
from tabbyline.session import ensure_shipped

_PRETOKEN = regex.compile(PRETOKEN)


#: Pre-tokenisation of the byte-pair vocabularies that are counted with (fixed values of the public format).
_BYTE_PAIR = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counts of strings up to so many characters are remembered, in a table of so many at most.
_MEMO_CHARS, _MEMO_ROWS = 64, 200_000


def pretokens(text: str) -> int:
    """A measure without any file: pre-tokens, a lower bound of byte-pair tokens."""
    return len(_PRETOKEN.findall(text))


def tokenizer_counter(rank_file: str, pattern: str = _BYTE_PAIR) -> Callable[[], Callable[[str], int]]:
    """A factory of exact counters over a public rank file; each worker builds its own, once."""

    def build() -> Callable[[str], int]:
        known = _counters.get((rank_file, pattern))
        if known is None:
            known = _counters[rank_file, pattern] = _counter(rank_file, pattern)
        return known

    return build


_counters: dict[tuple[str, str], Callable[[str], int]] = {}


def _counter(rank_file: str, pattern: str) -> Callable[[str], int]:
    import base64

    import tiktoken

    with open(rank_file, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    memo: dict[str, int] = {}

    def count(text: str) -> int:
        n = memo.get(text)
        if n is None:
            n = len(encode(text))
            if len(text) <= _MEMO_CHARS:
                if len(memo) >= _MEMO_ROWS:
                    memo.clear()
                memo[text] = n
        return n

    return count


def default_counter(config: ChunkingConfig) -> Callable[[], Callable[[str], int]]:
    """The measure of a configuration: tokens of its rank file, or pre-tokens if it names none."""
    return tokenizer_counter(config.rank_file) if config.rank_file else lambda: pretokens


def _cut(text: str, separator: str) -> list[str]:
    """Parts of the text, the separator kept at the front of what follows it."""
    if not separator:
        return list(text)
    first, *others = text.split(separator)
    return [p for p in (first, *(separator + o for o in others)) if p]


def _pack(parts: list[tuple[str, int]], size: int, overlap: int) -> Iterator[str]:
    """Windows of consecutive parts of at most `size`, sharing at most `overlap` with the one before."""
    window: deque[tuple[str, int]] = deque()
    total = 0
    for part, length in parts:
        if window and total + length > size:
            yield "".join(p for p, _ in window)
            while window and (total > overlap or total + length > size):
                total -= window.popleft()[1]
        window.append((part, length))
        total += length
    if window:
        yield "".join(p for p, _ in window)


def split_text(text: str, size: int = 512, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS, measure: Callable[[str], int] = pretokens) -> list[str]:
    """Chunks of a text in order, without white space around them; empty ones are left out."""
    if overlap > size:
        raise ValueError("overlap is more than size")

    def level(piece: str, seps: tuple[str, ...]) -> Iterator[str]:
        at = next((n for n, s in enumerate(seps) if not s or s in piece), len(seps) - 1)
        deeper, waiting = seps[at + 1 :], []
        for part in _cut(piece, seps[at]):
            length = measure(part)
            if length < size:
                waiting.append((part, length))
                continue
            yield from _pack(waiting, size, overlap)
            waiting = []
            yield from level(part, deeper) if deeper else (part,)
        yield from _pack(waiting, size, overlap)

    return [c for c in (chunk.strip() for chunk in level(text, separators)) if c]


def chunk_documents(df: DataFrame, config: ChunkingConfig | None = None, counter: Callable[[], Callable[[str], int]] | None = None) -> DataFrame:
    """One row for each chunk of each document, in the chunk schema without vectors.

    counter: a factory of the measure, instead of the configuration's. Each text is cut once, in one pass that gives
    place, number, text and count of its chunks; the document's columns travel with them and nothing is shuffled.
    Metadata holds title, url and the number of chunks, then the document's own; a document without metadata
    leaves those null. Null and blank contents have no chunks."""
    config = config or ChunkingConfig()
    ensure_shipped(df.sparkSession)
    build = counter or default_counter(config)
    kept = [c for c in ("id", "source", "url", "title", "content_type", "metadata") if c in df.columns]
    chosen = df.select(*kept, F.col("content").cast("string").alias("content"))
    added = [StructField("chunk_index", IntegerType()), StructField("__total", IntegerType()), StructField("__chunk", StringType()), StructField("__tokens", IntegerType())]
    schema = StructType([*chosen.schema.fields[:-1], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = build()
        for batch in batches:
            rows, place, total, text = [], [], [], []
            for n, value in enumerate(batch.column(len(kept))):
                content = value.as_py()
                chunks = split_text(content, config.chunk_size, config.chunk_overlap, config.separators, measure) if content else []
                rows += [n] * len(chunks)
                place += range(len(chunks))
                total += [len(chunks)] * len(chunks)
                text += chunks
            at = pa.array(rows, pa.int32())
            own = [batch.column(c).take(at) for c in range(len(kept))]
            told = [pa.array(place, pa.int32()), pa.array(total, pa.int32()), pa.array(text, pa.string()), pa.array(list(map(measure, text)), pa.int32())]
            yield pa.RecordBatch.from_arrays([*own, *told], schema.names)

    rows = chosen.mapInArrow(run, schema)
    own = [f.name for f in df.schema["metadata"].dataType.fields if f.name not in ("title", "url", "total_chunks")] if "metadata" in kept else []
    return rows.select(
        chunk_id(F.col("id"), F.col("chunk_index"), F.col("__chunk")).alias("id"),
        F.col("id").alias("document_id"),
        "source",
        F.col("__chunk").alias("content"),
        "content_type",
        "chunk_index",
        F.col("__tokens").alias("token_count"),
        F.lit(None).cast("array<float>").alias("embedding"),
        F.lit(None).cast("string").alias("embedding_model"),
        F.lit(PIPELINE_VERSION).alias("pipeline_version"),
        F.current_timestamp().alias("created_at"),
        F.struct("title", "url", F.col("__total").alias("total_chunks"), *(F.col(f"metadata.{c}") for c in own)).alias("metadata"),
    )


def chunk_stats(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks, documents (those without chunks too), their ratio, and bounds and mean of token counts."""
    n = documents.agg(F.count("*").alias("documents"))
    c = chunks.agg(
        F.count("*").alias("chunks"),
        F.min("token_count").alias("token_min"),
        F.max("token_count").alias("token_max"),
        F.avg("token_count").alias("token_mean"),
    )
    # two rows of one
    return c.join(n, F.lit(True)).withColumn("chunks_per_document", F.try_divide("chunks", "documents"))
