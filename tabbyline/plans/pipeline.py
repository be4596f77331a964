"""End to end: pages to corpus, corpus to collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tabbyline.config import EngineConfig
from tabbyline.operators import chunk, embed, ingest, store, validate
from tabbyline.schema import DATA_SOURCES, chunk_rules
from tabbyline.session import materialise, scope
from tabbyline.sources.corpus import save_corpus, write_failures


def ingest_corpus(pages: dict[str, tuple[DataFrame, str]], path: str, only: str | None = None, test: bool = False, **bounds) -> dict:
    """Pages by source, each with its id prefix, to a corpus with its report and quarantine.

    only: read no other source than this. test: five pages of each source."""
    chosen = {s: p for s, p in pages.items() if only in (None, s)}
    done = [ingest.ingest_pages(df, source, prefix, 5 if test else None) for source, (df, prefix) in chosen.items()]
    write_failures(ingest.union_sources(*(bad for _, bad in done)), f"{path}/failures")
    return save_corpus(ingest.union_sources(*(good for good, _ in done)), path, **bounds)


def index_corpus(documents: DataFrame, path: str, config: EngineConfig | None = None, model: Callable | None = None, dim: int = 384, sources: tuple[str, ...] = DATA_SOURCES) -> dict:
    """Documents to a fresh collection: chunk, validate, embed, replace. The old points are read until the new ones are
    published. Chunks that break a rule go to `<path>-rejected` with the rules they break."""
    config = config or EngineConfig()
    with scope(documents.sparkSession):
        good, bad = validate.split_valid(materialise(chunk.chunk_documents(documents, config.chunking), "chunks"), chunk_rules(sources))
        points = store.Collection(documents.sparkSession, path)
        counts = points.replace(embed.embed_chunks(good, model or embed.hash_model(dim)), dim)
        write_failures(bad.select("id", "document_id", "chunk_index", "content", "violations"), f"{path.rstrip('/')}-rejected")
        return {**counts, "rejected": bad.count()}
