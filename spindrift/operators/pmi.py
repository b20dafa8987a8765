"""Term co-occurrence by pointwise mutual information, per field, and its use.

For a page with words a and b, each above the field's frequency threshold, the
pair's value is log10(min(f_a, f_b) * N / (F_a * F_b)): F the words' summed
frequencies above the threshold, N the summed frequency of all postings.  Pairs
are formed within a page as a < b, where the rarer word's pairs are (``cooccur``).

``literal``    one value per (pair, page); the highest counts; kept are the pairs
               whose value is among the five highest distinct values of all.
``aggregated`` one value per pair from the sum of the minima over its pages;
               kept are each word's pairs with its five highest distinct values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.config import DEFAULT, Config
from spindrift.operators import cooccur
from spindrift.session import materialize
from spindrift.tables import ByPage


def page_strong(postings: DataFrame | ByPage, field: str, cfg: Config = DEFAULT) -> cooccur.Strong:
    """What :func:`page_values` are made of; given to it in place of the postings, these are read once for all calls."""
    return cooccur.strong(postings, [field], False, cfg)


def page_values(postings: DataFrame | ByPage | cooccur.Strong, field: str, cfg: Config = DEFAULT, touching: DataFrame | None = None, without: DataFrame | None = None) -> DataFrame:
    """(word1_id, word2_id, pmi): the highest per-page value above the threshold; with ``touching`` (word_id) only of pairs that have one of these words, or ``without``, none."""
    s = postings if isinstance(postings, cooccur.Strong) else page_strong(postings, field, cfg)
    if touching is not None:
        return cooccur.values_touching(s, touching)
    return cooccur.all_values(s) if without is None else cooccur.values_without(s, without)


def pair_values(postings: DataFrame, field: str, cfg: Config = DEFAULT) -> DataFrame:
    """(word1_id, word2_id, pmi) from the summed minima, above the threshold."""
    return cooccur.all_values(cooccur.strong(postings, [field], True, cfg))


def combined_pair_values(postings: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """:func:`combine_fields` of both fields' :func:`pair_values`; a pair's fields are added up where its owner's pairs are."""
    return cooccur.all_values(cooccur.strong(postings, ["title", "body"], True, cfg, [cfg.pmi_title_weight, cfg.pmi_body_weight]))


def page_values_top(postings: DataFrame, field: str, cfg: Config = DEFAULT) -> DataFrame:
    """:func:`top_literal` of :func:`page_values`, without the values being written."""
    return cooccur.highest(cooccur.strong(postings, [field], False, cfg), cfg.max_co_occurrence_terms)


def pair_values_top(postings: DataFrame, field: str, cfg: Config = DEFAULT) -> DataFrame:
    """:func:`top_per_term` of :func:`pair_values`, without the values being written."""
    return cooccur.highest_per_word(cooccur.strong(postings, [field], True, cfg), cfg.max_co_occurrence_terms)


def top_literal(values: DataFrame, n: int = DEFAULT.max_co_occurrence_terms) -> DataFrame:
    """Pairs whose value is among the ``n`` highest distinct values of all: n values are fetched, the rest is a semi join over the written values."""
    values = materialize(values, "pmi-values")
    best = values.select("pmi").distinct().orderBy(F.desc("pmi")).limit(n)
    return values.join(F.broadcast(best), "pmi", "left_semi").select("word1_id", "word2_id", "pmi")


def both_directions(pairs: DataFrame) -> DataFrame:
    """(word_id, other_id, pmi)."""
    return pairs.select(F.col("word1_id").alias("word_id"), F.col("word2_id").alias("other_id"), "pmi").unionByName(pairs.select(F.col("word2_id").alias("word_id"), F.col("word1_id").alias("other_id"), "pmi"))


def top_per_term(values: DataFrame, n: int = DEFAULT.max_co_occurrence_terms) -> DataFrame:
    """(word1_id, word2_id, pmi) of pairs that are among the ``n`` highest distinct values of either word; the values are written, as both directions read them."""
    values = materialize(values, "pmi-values")
    w = Window.partitionBy("word_id").orderBy(F.desc("pmi"))
    kept = both_directions(values).withColumn("r", F.dense_rank().over(w)).filter(F.col("r") <= n)
    return kept.select(F.least("word_id", "other_id").alias("word1_id"), F.greatest("word_id", "other_id").alias("word2_id"), "pmi").distinct()


def combine_fields(title: DataFrame, body: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(word1_id, word2_id, pmi): title and body values by weight, a missing one counts as 0."""
    w = cfg.pmi_title_weight
    both = title.withColumn("pmi", F.col("pmi") * w).unionByName(body.withColumn("pmi", F.col("pmi") * cfg.pmi_body_weight))
    return both.groupBy("word1_id", "word2_id").agg(F.round(F.sum("pmi"), 9).alias("pmi"))


def build(postings: DataFrame, mode: str = "literal", cfg: Config = DEFAULT) -> DataFrame:
    """The combined table in either mode."""
    per_field = []
    for f in ("title", "body"):
        per_field.append(page_values_top(postings, f, cfg) if mode == "literal" else pair_values_top(postings, f, cfg))
    return combine_fields(*per_field, cfg)


#: Pairs as a table, or a function that gives those that have none of its words.
Pairs = DataFrame | Callable[[DataFrame], DataFrame]


def _without(pairs: Pairs, words: DataFrame) -> DataFrame:
    return pairs(words) if callable(pairs) else cooccur.touching(pairs, words, either=False)


def _words(pairs: DataFrame) -> DataFrame:
    """word_id of both words, in one reading."""
    return pairs.select(F.explode(F.array("word1_id", "word2_id")).alias("word_id"))


def delete_words(pairs: Pairs, words: DataFrame, touched: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs that touch none of the words, word_id of all words in the pairs removed); ``touched``: those pairs, if they are had without reading ``pairs``, which a function needs."""
    touched = cooccur.touching(pairs, words) if touched is None else touched
    return _without(pairs, words), _words(touched).distinct()


def refresh(pairs: Pairs, values: DataFrame | Callable[[DataFrame], DataFrame], words: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """``pairs`` with everything that touches ``words`` or a word paired with them replaced by freshly computed ``values``.

    ``values`` are all of them, or a function that gives those that have one of its words.  Pairs are
    read, not written or shuffled: only the words that are affected are.  ``touched`` as in :func:`delete_words`.
    """
    touched = cooccur.touching(pairs, words) if touched is None else touched
    affected = materialize(_words(touched).unionByName(words.select("word_id")).distinct(), "affected")
    fresh = values(affected) if callable(values) else cooccur.touching(values, affected)
    return _without(pairs, affected).unionByName(fresh.select("word1_id", "word2_id", "pmi"))
