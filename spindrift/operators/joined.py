"""Joined searches: result lists (webpage_id, score) combined into one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(lists: Sequence[DataFrame], scores: Sequence[str] = ("score",)) -> DataFrame:
    """Union of the lists; each score is its sum over the lists divided by their number."""
    n = len(lists)
    rows = reduce(DataFrame.unionByName, [x.select("webpage_id", *scores) for x in lists])
    return rows.groupBy("webpage_id").agg(*[(F.sum(s) / F.lit(n)).alias(s) for s in scores])


def within(first: DataFrame, second: DataFrame, scores: Sequence[str] = ("score",), strict: bool = False) -> DataFrame:
    """Search within a result: pages of the first list, scores averaged with the second's (missing: 0); ``strict`` keeps only pages of both."""
    s = second.select("webpage_id", *[F.col(c).alias(f"__{c}") for c in scores])
    both = first.select("webpage_id", *scores).join(s, "webpage_id", "inner" if strict else "left")
    return both.select("webpage_id", *[((F.col(c) + F.coalesce(f"__{c}", F.lit(0.0))) / 2).alias(c) for c in scores])
