"""Text report: one block per act page with its keywords and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(edges: DataFrame, pages: DataFrame, k: int = 5, others: DataFrame | None = None) -> DataFrame:
    """(webpage_id, kind, rank, neighbour_id, url): the first k children and parents by id of the ``pages``; neighbours must be in ``others`` (default: ``pages``)."""
    e = edges.filter("is_active").select("parent_id", "child_id").distinct()
    both = e.select(F.col("parent_id").alias("webpage_id"), F.lit("child").alias("kind"), F.col("child_id").alias("neighbour_id")).unionByName(e.select(F.col("child_id").alias("webpage_id"), F.lit("parent").alias("kind"), F.col("parent_id").alias("neighbour_id")))
    near = (others if others is not None else pages).select(F.col("webpage_id").alias("neighbour_id"))
    both = both.join(pages.select("webpage_id"), "webpage_id", "left_semi").join(near, "neighbour_id", "left_semi")
    w = Window.partitionBy("webpage_id", "kind").orderBy("neighbour_id")
    first = both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    urls = (others if others is not None else pages).select(F.col("webpage_id").alias("neighbour_id"), "url")
    return first.join(urls, "neighbour_id").select("webpage_id", "kind", "rank", "neighbour_id", "url")


def _joined(kind: str, values: DataFrame, separator: str) -> DataFrame:
    """(webpage_id, kind) with the few values of each page joined in rank order."""
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]), separator)
    return values.groupBy("webpage_id").agg(items.alias(kind))


def report(
    pages: DataFrame, postings: DataFrame, keyword: DataFrame, edges: DataFrame, keywords: int = 10, relations: int = 5, others: DataFrame | None = None, with_parents: bool = True, limit: int | None = None
) -> DataFrame:
    """(webpage_id, block): title, url, date and size, title and body keywords by frequency, children, parents.

    Neighbours are of ``others`` (those that are active, crawled or not); parents
    may be left out; ``limit`` reports the pages of the lowest ids only.
    """
    if limit is not None:
        pages = pages.orderBy("webpage_id").limit(limit)
        postings = postings.join(pages.select("webpage_id"), "webpage_id", "left_semi")
    w = Window.partitionBy("webpage_id", "field").orderBy(F.desc("frequency"), "word_id")
    top = postings.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keywords)
    words = top.join(keyword.select("word_id", "word"), "word_id").select("webpage_id", "field", "rank", F.concat_ws(" ", "word", F.col("frequency").cast("string")).alias("value"))
    near = neighbours(edges, pages, relations, others).select("webpage_id", "kind", "rank", F.col("url").alias("value"))
    out = pages
    for kind, rows, sep in (
        ("title_words", words.filter("field = 'title'"), "; "),
        ("body_words", words.filter("field = 'body'"), "; "),
        ("children", near.filter("kind = 'child'"), "\n"),
        ("parents", near.filter("kind = 'parent'"), "\n"),
    ):
        out = out.join(_joined(kind, rows.select("webpage_id", "rank", "value"), sep), "webpage_id", "left")

    def shown(c: str, none: str) -> Column:
        return F.coalesce(F.col(c), F.lit(none))

    block = F.concat_ws(
        "\n",
        F.coalesce("title", F.lit("")),
        F.col("url"),
        F.concat_ws(", ", F.coalesce(F.date_format("last_modified_date", "yyyy-MM-dd HH:mm:ss"), F.lit("-")), F.coalesce("size", F.lit(0)).cast("string")),
        shown("title_words", "No Title Keyword Found"),
        shown("body_words", "No Body Keyword Found"),
        shown("children", "No Child Found"),
        *([shown("parents", "No Parent Found")] if with_parents else []),
    )
    return out.select("webpage_id", block.alias("block"))


def write_report(blocks: DataFrame, path: str) -> None:
    blocks.orderBy("webpage_id").select(F.concat("block", F.lit("\n" + "-" * 40)).alias("value")).write.mode("overwrite").text(path)
