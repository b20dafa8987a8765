"""Sparse vectors in long form (owner, word_id, weight): weights, norms, cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.config import DEFAULT
from spindrift.session import broadcast_if_small


def combine(title: Column, body: Column, title_weight: float = DEFAULT.title_weight) -> Column:
    """Weighted sum of a title and a body value; a missing one counts as 0."""
    zero = F.lit(0.0)
    return F.lit(title_weight) * F.coalesce(title, zero) + F.lit(round(1 - title_weight, 12)) * F.coalesce(body, zero)


def norms(vectors: DataFrame, owner: str) -> DataFrame:
    """(owner, norm)."""
    return vectors.groupBy(owner).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def dots(vectors: DataFrame, owner: str, query: DataFrame) -> DataFrame:
    """(owner, dot) with a query (word_id, q); owners that share no word are absent.

    A query is broadcast if a count shows it small; one moved by much feedback may not be.
    """
    return vectors.join(broadcast_if_small(query)[0], "word_id").groupBy(owner).agg(F.sum(F.col("weight") * F.col("q")).alias("dot"))


def cosine(dot: Column, norm_a: Column, norm_b: Column) -> Column:
    """0 where either norm is 0 or missing."""
    return F.coalesce(F.try_divide(dot, norm_a * norm_b), F.lit(0.0))


def merge_sum(*vectors: DataFrame, keys=("word_id",), value: str = "weight") -> DataFrame:
    """Sum of sparse vectors: a full outer merge with + as combiner."""
    out = vectors[0].select(*keys, value)
    for v in vectors[1:]:
        out = out.unionByName(v.select(*keys, value))
    return out.groupBy(*keys).agg(F.sum(value).alias(value))


def min_max(x: Column, lo: Column, hi: Column) -> Column:
    """(x - lo) / (hi - lo); 0 for a null value or an empty range."""
    return F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0))
