"""Settings with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Options of search and indexing."""

    max_items: int = 10
    chunk_size: int = 512
    chars_per_token: int = 4
    index_fields: tuple[str, ...] = ("title", "description", "metadata")
    system_prompt: str = "Answer from the items below."
    #: A batch of texts for an embedder ends at either limit.
    batch_texts: int = 2048
    batch_tokens: int = 100_000
    #: (largest collection, items a batch); a collection beyond all has ``batch_size_beyond``.
    batch_sizes: tuple[tuple[int, int], ...] = ((100, 50), (500, 30), (1000, 20))
    batch_size_beyond: int = 10
    browser_batch_sizes: tuple[tuple[int, int], ...] = ((49, 5), (199, 10), (999, 20))
    browser_batch_size_beyond: int = 30
    cost_per_1000_tokens: float = 0.008
    tokens_per_word: int = 4
    #: Dimensions of the hashed embedder.
    dims: int = 64


DEFAULT = Config()
