"""The search index's tables and how they are to be read.

* standing page: of the rows of one ``webpage_id`` the one with the latest
  ``last_modified_date`` (null is earliest); ``act`` = it is active and crawled.
* standing posting: of the rows of one (webpage_id, word_id) the one with the
  latest ``indexed_at``; exact copies count once.  If two rows carry the same
  latest time, the higher frequency stands.  Live = its frequency is above 0.
* rows with a null key name no page or posting and are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift import skew

FIELDS = ("title", "body")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns of a page in the order that decides between two versions of the same date; a query reads no further than it needs.
_PAGE = ("last_modified_date", "is_active", "is_crawled", "size", "pagerank", "title", "url")


def _latest_pages(webpage: DataFrame, n: int) -> DataFrame:
    cols = _PAGE[:n]
    latest = webpage.filter(F.col("webpage_id").isNotNull()).groupBy("webpage_id").agg(F.max(F.struct(*cols)).alias("v"))
    return latest.select("webpage_id", *[F.col(f"v.{c}").alias(c) for c in cols])


def standing_pages(webpage: DataFrame) -> DataFrame:
    """One row per webpage_id: url, title, last_modified_date, size, pagerank, is_active, is_crawled of its latest version."""
    return _latest_pages(webpage, len(_PAGE)).select("webpage_id", "url", "title", "last_modified_date", "size", "pagerank", "is_active", "is_crawled")


def act_pages(webpage: DataFrame, *keep: str) -> DataFrame:
    """webpage_id (and the columns ``keep``) of the pages whose standing row is active and crawled."""
    n = max([3, *[_PAGE.index(c) + 1 for c in keep]])
    return _latest_pages(webpage, n).filter(F.col("is_active") & F.col("is_crawled")).select("webpage_id", *keep)


def standing_postings(index: DataFrame, with_tf: bool = False) -> DataFrame:
    """webpage_id, word_id, frequency (and normalized_tf) of every standing posting, soft-deleted ones included.

    The maximum is taken before and after the shuffle, so copies of one posting
    collapse where they are read; the shuffle is on (page, word), which no
    large page or frequent word can skew.
    """
    cols = ["indexed_at", "frequency"] + ["normalized_tf"] * with_tf
    return (
        index.filter(F.col("webpage_id").isNotNull() & F.col("word_id").isNotNull())
        .groupBy("webpage_id", "word_id")
        .agg(F.max(F.struct(*cols)).alias("v"))
        .select("webpage_id", "word_id", *[F.col(f"v.{c}").alias(c) for c in cols[1:]])
    )


def live_postings(index: DataFrame, with_tf: bool = False) -> DataFrame:
    return standing_postings(index, with_tf).filter(F.col("frequency") > 0)


def on_act_pages(postings: DataFrame, act: DataFrame, raw_index: DataFrame, part_by: str = "word_id") -> DataFrame:
    """The postings of act pages.

    A semi join on webpage_id whose large pages (found in ``raw_index``, one
    column of one scan) are spread over several tasks by ``part_by``.  Rows of
    one (webpage_id, part_by) stay together.
    """
    hot = skew.hot_keys(raw_index, "webpage_id")
    return skew.salted_join(postings, act, "webpage_id", how="left_semi", hot=hot, spread=[part_by])


@dataclass
class ByPage:
    """Rows that lie in one task per page, or for a large page in several by the hash of one column.

    ``rows`` grouped by ``keys`` and that column, or by ``keys`` alone, needs no further shuffle.
    """

    rows: DataFrame
    keys: list[str]


def act_postings_by_page(
    spark: SparkSession, d: str, fields: Sequence[str] = FIELDS, with_tf: bool = False, act: DataFrame | None = None, rename: Callable[[DataFrame], DataFrame] | None = None, part_by: str = "word_id"
) -> ByPage:
    """Live postings of act pages (webpage_id, field, word_id, frequency, normalized_tf if asked for), in one shuffle of the raw rows.

    The raw rows of all ``fields`` are spread by page; which version of a
    posting stands, the semi join with the act pages and whatever is grouped by
    page afterwards happen where the page's rows then are.  Pages that hold much
    of all rows are spread further by ``part_by``.  ``rename`` may add columns to
    the raw rows before (``part_by`` may be one, if it depends on the word alone).
    """
    cols = ["indexed_at", "frequency"] + ["normalized_tf"] * with_tf
    raw = None
    for field in fields:
        own = table(spark, d, f"{field}_index").select("webpage_id", F.lit(field).alias("field"), "word_id", *cols)
        raw = own if raw is None else raw.unionByName(own)
    hot = skew.hot_keys(raw, "webpage_id")
    raw = raw.filter(F.col("webpage_id").isNotNull() & F.col("word_id").isNotNull())
    before = set(raw.columns)
    raw = raw if rename is None else rename(raw)
    added = [c for c in raw.columns if c not in before]
    pages = (act if act is not None else act_pages(table(spark, d, "webpage"))).select("webpage_id")
    keys = ["webpage_id"]
    if hot:
        keys.append("__salt")
        raw, pages = raw.withColumn("__salt", skew.salt(hot, "webpage_id", [part_by])), skew.repeated(pages, hot, "webpage_id")
    each = ["field"] if len(fields) > 1 else []
    latest = raw.repartition(*keys).groupBy(*keys, *each, "word_id", *added).agg(F.max(F.struct(*cols)).alias("v"))
    field_of = F.col("field") if each else F.lit(fields[0]).alias("field")
    live = latest.select(*keys, field_of, "word_id", *added, *[F.col(f"v.{c}").alias(c) for c in cols[1:]]).filter("frequency > 0")
    return ByPage(live.join(pages.hint("shuffle_hash"), keys, "left_semi"), keys)
