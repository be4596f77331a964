"""Parameters of the operators, checked on construction."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

#: Boundaries from the most natural to the last resort.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} is {value}, must be from {low} to {high}")


@dataclass(frozen=True)
class ChunkingConfig:
    chunk_size: int = 512
    chunk_overlap: int = 50
    separators: tuple[str, ...] = SEPARATORS
    #: Rank file of the tokenizer that sizes are counted with; None counts pre-tokens, a lower bound.
    rank_file: str | None = "/opt/tokenizers/byte_bpe_50k.tiktoken"

    def __post_init__(self) -> None:
        _within("chunk_size", self.chunk_size, 64, 2048)
        _within("chunk_overlap", self.chunk_overlap, 0, float("inf"))


@dataclass(frozen=True)
class RetrievalConfig:
    top_k_initial: int = 30
    top_k_reranked: int = 5
    bm25_weight: float = 0.5
    dense_weight: float = 0.5
    use_reranker: bool = True
    reranker_model: str = "cross-encoder/ms-marco-MiniLM-L-6-v2"

    def __post_init__(self) -> None:
        _within("top_k_initial", self.top_k_initial, 5, 100)
        _within("top_k_reranked", self.top_k_reranked, 1, 20)
        _within("bm25_weight", self.bm25_weight, 0, 1)
        _within("dense_weight", self.dense_weight, 0, 1)


@dataclass(frozen=True)
class GenerationConfig:
    model_name: str = "llama-3.3-70b-versatile"
    temperature: float = 0.1
    max_tokens: int = 1024
    system_prompt: str = "Answer from the given context only, cite the sources, and say so if the context does not hold the answer."

    def __post_init__(self) -> None:
        _within("temperature", self.temperature, 0, 2)
        _within("max_tokens", self.max_tokens, 64, 4096)


@dataclass(frozen=True)
class EngineConfig:
    chunking: ChunkingConfig = field(default_factory=ChunkingConfig)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    generation: GenerationConfig = field(default_factory=GenerationConfig)
    embedding_model: str = "all-MiniLM-L6-v2"
    collection_name: str = "chunks"

    def snapshot(self) -> str:
        """All parameters as JSON, for the record of an answer or a run."""
        return json.dumps(asdict(self), sort_keys=True)
