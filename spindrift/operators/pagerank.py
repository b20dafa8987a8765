"""PageRank over the active links between act pages.

Every page starts at 1; a page without a live parent stays there.  In a round
each other page becomes (1 - d) + d * sum(rank(parent) / outdegree(parent)); in
``literal`` mode its former value is added on top, so values grow.

A round references the ranks once (parents' ranks joined with the edges, then one
aggregation; the sums are formed before the shuffle, so a child with a third of
all edges is harmless), and the lineage is cut every few rounds.  The edges are
written once, bucketed by parent, so that a round shuffles partial sums only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.config import DEFAULT, Config
from spindrift.session import materialize, materialize_by


def live_edges(relationship: DataFrame, act: DataFrame) -> DataFrame:
    """Distinct (parent_id, child_id) of active edges whose both ends are act pages; self-links are left out."""
    e = relationship.filter("is_active and parent_id <> child_id").select("parent_id", "child_id").distinct()
    return e.join(act.select(F.col("webpage_id").alias("parent_id")), "parent_id", "left_semi").join(act.select(F.col("webpage_id").alias("child_id")), "child_id", "left_semi").select("parent_id", "child_id")


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("parent_id").agg(F.count(F.lit(1)).alias("out_degree"))


def pagerank(edges: DataFrame, act: DataFrame, mode: str = "standard", cfg: Config = DEFAULT, rounds: int | None = None, only: DataFrame | None = None, stored: DataFrame | None = None, cut_every: int = 5) -> DataFrame:
    """(webpage_id, pagerank) of every act page.

    With ``only`` (webpage_id), just those pages are updated; all others keep
    the value in ``stored`` (webpage_id, pagerank; missing or null: 1).
    """
    d = cfg.damping
    n = cfg.pagerank_rounds if rounds is None else rounds
    start = act.select("webpage_id")
    if stored is not None:
        start = start.join(stored.select("webpage_id", F.col("pagerank").alias("rank")), "webpage_id", "left").select("webpage_id", F.coalesce("rank", F.lit(1.0)).alias("rank"))
    else:
        start = start.select("webpage_id", F.lit(1.0).alias("rank"))
    links = edges.join(out_degree(edges), "parent_id").select("parent_id", "child_id", (F.lit(1.0) / F.col("out_degree")).alias("share"))
    if only is not None:
        links = links.join(only.select(F.col("webpage_id").alias("child_id")).distinct(), "child_id", "left_semi")
    # what enters a round from pages that never change is constant: only the changing pages' ranks are carried
    links = materialize(links, "links")
    start = materialize(start, "ranks")
    changing = links.select(F.col("child_id").alias("webpage_id")).distinct()
    ranks = start.join(changing, "webpage_id", "left_semi")
    fixed = start.join(changing, "webpage_id", "left_anti")
    if n > 0:
        moving = materialize_by(links.join(changing.withColumnRenamed("webpage_id", "parent_id"), "parent_id", "left_semi"), "moving", "parent_id")
        constant = links.join(fixed.withColumnRenamed("webpage_id", "parent_id"), "parent_id").groupBy("child_id").agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        constant = materialize(constant.select(F.col("child_id").alias("webpage_id"), "in"), "constant")
        for i in range(n):
            sent = moving.join(ranks.withColumnRenamed("webpage_id", "parent_id"), "parent_id").select(F.col("child_id").alias("webpage_id"), (F.col("rank") * F.col("share") * d).alias("v"))
            base = constant.select("webpage_id", (F.col("in") * d).alias("v"))
            parts = sent.unionByName(base)
            if mode == "literal":
                parts = parts.unionByName(ranks.select("webpage_id", F.col("rank").alias("v")))
            ranks = parts.groupBy("webpage_id").agg((F.lit(1 - d) + F.sum("v")).alias("rank"))
            if (i + 1) % (1 if mode == "literal" else cut_every) == 0 and i + 1 < n:
                ranks = materialize(ranks, "ranks")
    return fixed.unionByName(ranks).select("webpage_id", F.col("rank").alias("pagerank"))


def min_max_scaled(ranks: DataFrame) -> DataFrame:
    """``ranks`` with ``scaled`` = (x - min) / (max - min), 0 for nulls and for an empty range; extrema computed once."""
    ends = ranks.agg(F.min("pagerank").alias("lo"), F.max("pagerank").alias("hi"))
    scaled = F.coalesce(F.try_divide(F.col("pagerank") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return ranks.crossJoin(F.broadcast(ends)).select(*ranks.columns, scaled.alias("scaled"))
