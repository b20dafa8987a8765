"""Table maintenance: upsert, insert-only, soft delete, deactivation, identifiers.

Tables are immutable Parquet; each operation gives the new contents, which the
caller writes (``write_table`` swaps a folder by partition overwrite).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.skew import range_rank

#: Columns an upsert overwrites, by table.
UPDATES = {
    "relationship": ("is_active",),
    "title_index": ("frequency", "normalized_tf"),
    "body_index": ("frequency", "normalized_tf"),
    "webpage": ("title", "last_modified_date", "size", "pagerank", "is_active", "is_crawled"),
    "pmi": ("pmi",),
}


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``old`` with ``update`` columns (default: all) taken from ``new`` where the key is there, and the new keys.

    A new null overwrites.  Keys must be unique on either side; columns missing from ``new`` keep their value, null for new keys.
    """
    cols = [c for c in old.columns if c not in keys]
    update = [c for c in (update if update is not None else cols) if c in new.columns]
    o, n = old.withColumn("__old", F.lit(True)), new.withColumn("__new", F.lit(True))
    n = n.select(*keys, "__new", *[F.col(c).alias(f"__n_{c}") for c in cols if c in new.columns])
    both = o.join(n, list(keys), "full_outer")

    def value(c: str):
        if f"__n_{c}" not in both.columns:
            return F.col(c)
        fresh = F.col(f"__n_{c}").cast(old.schema[c].dataType)
        inserted = F.col("__old").isNull()
        return F.when(inserted | F.col("__new"), fresh).otherwise(F.col(c)) if c in update else F.when(inserted, fresh).otherwise(F.col(c))

    return both.select(*[F.col(c) if c in keys else value(c).alias(c) for c in old.columns])


def insert_new(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(all rows, only the inserted ones): existing keys stay as they are."""
    fresh = new.join(old.select(*keys), list(keys), "left_anti").select(*old.columns)
    return old.unionByName(fresh), fresh


def zero_absent(old: DataFrame, batch: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Soft delete: frequency 0 for postings not in ``batch`` (webpage_id, word_id); ``normalized_tf`` is left as it was.

    Only postings of the pages in ``touched`` (default: those of the batch); pass all pages for a global sweep.
    """
    pages = (touched if touched is not None else batch).select("webpage_id").distinct().withColumn("__page", F.lit(True))
    there = batch.select("webpage_id", "word_id").distinct().withColumn("__there", F.lit(True))
    marked = old.join(there, ["webpage_id", "word_id"], "left").join(pages, "webpage_id", "left")
    gone = F.col("__page") & F.col("__there").isNull()
    return marked.withColumn("frequency", F.when(gone, F.lit(0)).otherwise(F.col("frequency")).cast(old.schema["frequency"].dataType)).select(*old.columns)


def deactivate_absent(old: DataFrame, batch: DataFrame, keys: Sequence[str], within: str | None = None) -> DataFrame:
    """``is_active`` false for rows whose key isn't in ``batch``; with ``within`` only where that column's value occurs in the batch."""
    there = batch.select(*keys).distinct().withColumn("__there", F.lit(True))
    marked = old.join(there, list(keys), "left")
    gone = F.col("__there").isNull()
    if within is not None:
        marked = marked.join(batch.select(within).distinct().withColumn("__in", F.lit(True)), within, "left")
        gone = gone & F.col("__in")
    return marked.withColumn("is_active", F.when(gone, F.lit(False)).otherwise(F.col("is_active"))).select(*old.columns)


def assign_ids(old: DataFrame, new: DataFrame, natural: str, id_column: str) -> DataFrame:
    """(natural, id) for every natural key of ``new``: the stored id, or the next ones in key order after the highest stored id."""
    keys = new.select(natural).filter(F.col(natural).isNotNull()).distinct()
    known = keys.join(old.select(natural, id_column), natural)
    fresh = range_rank(keys.join(old.select(natural), natural, "left_anti"), [], [natural], label="ids").select(natural, "position")
    top = old.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("top"))
    return known.unionByName(fresh.crossJoin(F.broadcast(top)).select(natural, (F.col("position") + F.col("top")).alias(id_column)))


def set_values(old: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """Bulk update of one column by key; rows without a new value keep theirs."""
    v = values.select(key, F.col(column).alias("__v"))
    return old.join(v, key, "left").withColumn(column, F.coalesce("__v", column)).select(*old.columns)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Create or replace a table folder."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def apply_crawl(pages: DataFrame, keyword: DataFrame, postings: DataFrame, edges: DataFrame, crawled: DataFrame, links: DataFrame, terms: DataFrame) -> dict[str, DataFrame]:
    """One crawl batch written to all tables, as one plan over the whole batch.

    crawled (url, title, last_modified_date, size), links (url, child_url),
    terms (url, field, word, frequency, normalized_tf).  Unknown children become
    inactive, uncrawled stubs; absent edges of crawled parents are deactivated and
    absent postings of crawled pages zeroed.
    """
    urls = crawled.select("url").unionByName(links.select(F.col("child_url").alias("url"))).distinct()
    ids = assign_ids(pages, urls, "url", "webpage_id")
    stubs = links.select(F.col("child_url").alias("url")).distinct().join(ids, "url")
    stub_rows = stubs.select("webpage_id", "url", F.lit(None).cast("string").alias("title"), F.lit(None).cast("timestamp_ntz").alias("last_modified_date"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("double").alias("pagerank"), F.lit(False).alias("is_active"), F.lit(False).alias("is_crawled"))
    with_stubs, _ = insert_new(pages, stub_rows.select(*pages.columns), ["url"])
    page_rows = crawled.join(ids, "url").select("webpage_id", "url", "title", "last_modified_date", "size", F.lit(None).cast("double").alias("pagerank"), F.lit(True).alias("is_active"), F.lit(True).alias("is_crawled"))
    new_pages = upsert(with_stubs, page_rows.drop("webpage_id").withColumn("webpage_id", F.lit(None).cast("long")), ["url"], UPDATES["webpage"])
    new_pages = new_pages.join(ids.withColumnRenamed("webpage_id", "__id"), "url", "left").withColumn("webpage_id", F.coalesce("webpage_id", "__id")).select(*pages.columns)
    word_ids = assign_ids(keyword, terms.select("word"), "word", "word_id")
    new_keyword, _ = insert_new(keyword, word_ids.select(*keyword.columns), ["word"])
    batch = terms.join(ids, "url").join(word_ids, "word").select("webpage_id", "field", "word_id", "frequency", "normalized_tf")
    touched = crawled.join(ids, "url").select("webpage_id")
    fields = []
    for f in ("title", "body"):
        now = batch.filter(F.col("field") == f)
        merged = upsert(postings.filter(F.col("field") == f), now, ["webpage_id", "field", "word_id"], UPDATES["title_index"])
        fields.append(zero_absent(merged, now, touched))
    edge_batch = links.join(ids, "url").select(F.col("webpage_id").alias("parent_id"), "child_url").join(ids.select(F.col("url").alias("child_url"), F.col("webpage_id").alias("child_id")), "child_url").select("parent_id", "child_id", F.lit(True).alias("is_active")).distinct()
    parents = touched.select(F.col("webpage_id").alias("parent_id"))
    merged_edges = upsert(edges, edge_batch, ["parent_id", "child_id"], UPDATES["relationship"])
    kept = merged_edges.join(edge_batch.select("parent_id", "child_id").withColumn("__there", F.lit(True)), ["parent_id", "child_id"], "left").join(parents.distinct().withColumn("__in", F.lit(True)), "parent_id", "left")
    new_edges = kept.withColumn("is_active", F.when(F.col("__in") & F.col("__there").isNull(), F.lit(False)).otherwise(F.col("is_active"))).select(*edges.columns)
    return {"webpage": new_pages, "keyword": new_keyword, "postings": fields[0].unionByName(fields[1]), "relationship": new_edges, "touched_words": batch.select("word_id").distinct()}
