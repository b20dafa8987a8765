"""The offline jobs in one go: index, PMI and PageRank, written as durable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.config import DEFAULT, Config
from spindrift.operators import pagerank, pmi, storage
from spindrift.operators.index import SearchIndex
from spindrift.session import materialize


def build_offline(spark: SparkSession, d: str, path: str, pmi_mode: str = "literal", rank_mode: str = "standard", cfg: Config = DEFAULT) -> SearchIndex:
    """Builds everything over all words and pages of ``d`` and gives the written index; the PMI table is ``path``/pmi."""
    ix = SearchIndex.of(spark, d, cfg)
    act = materialize(ix.pages.select("webpage_id"), "act")
    edges = pagerank.live_edges(ix.edges, act)
    ix.pages = storage.set_values(ix.pages, pagerank.pagerank(edges, act, rank_mode, cfg), "webpage_id", "pagerank")
    ix.write(path)
    storage.write_table(pmi.build(SearchIndex.read(spark, path, cfg).postings, pmi_mode, cfg), f"{path}/pmi")
    return SearchIndex.read(spark, path, cfg)


def corpus_statistics(pages: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: act pages, average, lowest and highest PageRank, live postings and summed frequency per field."""
    p = pages.agg(F.count(F.lit(1)).alias("pages"), F.avg("pagerank").alias("avg_rank"), F.min("pagerank").alias("min_rank"), F.max("pagerank").alias("max_rank"))

    def of(field: str, value):
        return F.coalesce(F.sum(F.when(F.col("field") == field, value)), F.lit(0)).cast("long")

    t = postings.agg(*[of(f, v).alias(f"{f}_{n}") for f in ("title", "body") for n, v in (("postings", F.lit(1)), ("total", F.col("frequency")))])
    return p.crossJoin(F.broadcast(t))
