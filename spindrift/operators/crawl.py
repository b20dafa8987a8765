"""Breadth-first crawl over a link table: frontier joined with links, visited pages anti-joined."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.session import materialize


def frontier(links: DataFrame, seeds: DataFrame, max_pages: int, max_depth: int | None = None) -> DataFrame:
    """(page_id, depth) of up to ``max_pages`` pages reachable over ``links`` (parent_id, child_id) from ``seeds`` (page_id).

    Level by level, until one is empty or ``max_depth`` (none by default) is reached; where a level exceeds what is left,
    its smallest ids are taken.
    """
    visited = materialize(seeds.select("page_id", F.lit(0).alias("depth")).distinct(), "frontier")
    level, seen = visited, visited.count()
    for depth in count(1):
        if max_depth is not None and depth > max_depth or seen >= max_pages:
            break
        nxt = links.join(level.select(F.col("page_id").alias("parent_id")), "parent_id", "left_semi").select(F.col("child_id").alias("page_id")).distinct().join(visited, "page_id", "left_anti")
        level = materialize(nxt.orderBy("page_id").limit(max_pages - seen).withColumn("depth", F.lit(depth)), "frontier")
        n = level.count()
        if not n:
            break
        visited, seen = visited.unionByName(level), seen + n
        if depth % 20 == 0:  # one table again, so that a deep crawl's plan doesn't grow
            visited = materialize(visited, "frontier")
    return visited
