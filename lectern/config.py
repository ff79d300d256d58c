"""Settings of ingest and retrieval, with environment overrides."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field


def _env(name: str, kind, default):
    return field(default_factory=lambda: kind(os.environ.get(name, default)))


@dataclass(frozen=True)
class Config:
    """One table name serves ingest and retrieval alike."""

    index_name: str = _env("INDEX_NAME", str, "chunks")
    chunk_tokens: int = _env("CHUNK_SIZE", int, 256)
    min_chunk_tokens: int = 20
    dimension: int = _env("EMBEDDING_DIMENSIONS", int, 1024)
    recall_k: int = _env("RECALL_K", int, 10)
    top_k: int = _env("TOP_K", int, 5)
    threshold: float = _env("SIMILARITY_THRESHOLD", float, 0.3)
    vector_weight: float = _env("HYBRID_VECTOR_WEIGHT", float, 0.6)
    keyword_weight: float = _env("HYBRID_KEYWORD_WEIGHT", float, 0.4)
    context_chars: int = 4000

    def weights(self) -> tuple[float, float]:
        """Vector and keyword weight, rescaled to a sum of 1 where they are off by more than 0.01."""
        total = self.vector_weight + self.keyword_weight
        if abs(total - 1) > 0.01 and total > 0:
            return self.vector_weight / total, self.keyword_weight / total
        return self.vector_weight, self.keyword_weight

    def sizes(self) -> tuple[int, int]:
        """(top_k, recall_k) with recall_k >= top_k >= 1."""
        top = max(1, self.top_k)
        return top, max(top, self.recall_k)

    def as_dict(self) -> dict:
        return asdict(self)
