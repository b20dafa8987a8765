"""Tunable constants of retrieval, expansion and offline jobs, with their default values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # fixed values: the defaults a user of the search engine relies on
    title_weight: float = 0.7
    relevant_weight: float = 0.5
    non_relevant_weight: float = 0.25
    max_relevant_queries: int = 5
    max_ranked_words: int = 5
    co_occurrence_weight: float = 0.5
    max_co_occurrence_terms: int = 5
    title_frequency_above: int = 1
    body_frequency_above: int = 3
    pmi_above: float = 0.3
    pmi_title_weight: float = 0.3
    damping: float = 0.85
    pagerank_weight: float = 0.3
    pagerank_rounds: int = 20
    max_fuzzy_words: int = 5
    max_relations: int = 5
    max_merged_queries: int = 5
    max_sub_queries: int = 2

    @property
    def body_weight(self) -> float:
        return round(1 - self.title_weight, 12)

    @property
    def pmi_body_weight(self) -> float:
        return round(1 - self.pmi_title_weight, 12)


DEFAULT = Config()
