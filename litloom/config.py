"""Tunables of the pipeline in one immutable place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Chunking:
    target_chars: int = 1200
    max_chars: int = 1800
    overlap_chars: int = 150
    # Headings (by how they start) whose sections are not chunked.
    skip_sections: tuple[str, ...] = (
        "references", "bibliography", "acknowledgement", "acknowledgements", "appendix", "author contributions", "conflicts of interest", "funding",
    )


@dataclass(frozen=True)
class Search:
    default_top_k: int = 12
    candidate_pool: int = 60
    rrf_k: int = 60
    steelman_top_k: int = 24


@dataclass(frozen=True)
class Synthesis:
    future_work_similarity: float = 0.62
    min_papers_per_construct: int = 2
    evidence_budget_chars: int = 60_000


@dataclass(frozen=True)
class Config:
    chunking: Chunking = field(default_factory=Chunking)
    search: Search = field(default_factory=Search)
    synthesis: Synthesis = field(default_factory=Synthesis)
    embedding_dim: int = 384
    fuzzy_threshold: float = 0.88
    min_probe_chars: int = 12
    empty_document_chars: int = 500
    retry_pause: float = 2.0


DEFAULT = Config()
