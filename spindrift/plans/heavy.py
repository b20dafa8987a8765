"""Per-key results of body_index.word_id and relationship.child_id, whose few heavy keys hold half of the rows (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift import skew
from spindrift.tables import table

#: field -> (table, key, secondary order)
KEYED = {
    "body_index.word_id": ("body_index", "word_id", "webpage_id"),
    "relationship.child_id": ("relationship", "child_id", "parent_id"),
}
SHARE = 1 / 40


def _live(name: str):
    return F.col("frequency") > 0 if name == "body_index" else F.col("is_active")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """(field, key_id) of the keys that hold at least a fortieth of all rows as they lie."""
    out = None
    for field, (name, key, order) in KEYED.items():
        rows = skew.heavy_keys(table(spark, d, name).select(key, order), key, [order], SHARE).select(F.lit(field).alias("field"), F.col(key).alias("key_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def p5_keys(spark: SparkSession, d: str) -> DataFrame:
    """Per key: rows, live rows, and the first and last partner id."""
    out = None
    for field, (name, key, order) in KEYED.items():
        aggs = [
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(_live(name).cast("long")).alias("n_live"),
            F.min(order).alias("first_partner"),
            F.max(order).alias("last_partner"),
        ]
        live = "frequency" if name == "body_index" else "is_active"
        rows = skew.range_aggregate(table(spark, d, name).select(key, order, live), key, [order], aggs)
        rows = rows.select(F.lit(field).alias("field"), F.col(key).alias("key_id"), "n_rows", "n_live", "first_partner", "last_partner")
        out = rows if out is None else out.unionByName(rows)
    return out


def p5_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Each posting's rank (ties share it) among the rows of its word by frequency, whatever the word's size."""
    rows = table(spark, d, "body_index").select("word_id", "webpage_id", "frequency")
    return skew.range_rank(rows, ["word_id"], ["frequency"]).select("word_id", "webpage_id", "frequency", "rank")


QUERIES = {"p5_found": p5_found, "p5_keys": p5_keys, "p5_ranks": p5_ranks}

ORACLE = {
    "p5_found": """SELECT 'body_index.word_id' AS field, word_id AS key_id FROM body_index GROUP BY word_id HAVING count(*) * 40 >= (SELECT count(*) FROM body_index)
UNION ALL SELECT 'relationship.child_id', child_id FROM relationship GROUP BY child_id HAVING count(*) * 40 >= (SELECT count(*) FROM relationship)""",
    "p5_keys": """SELECT 'body_index.word_id' AS field, word_id AS key_id, count(*) AS n_rows, CAST(sum(CASE WHEN frequency > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_live, min(webpage_id) AS first_partner, max(webpage_id) AS last_partner FROM body_index GROUP BY word_id
UNION ALL SELECT 'relationship.child_id', child_id, count(*), CAST(sum(CASE WHEN is_active THEN 1 ELSE 0 END) AS BIGINT), min(parent_id), max(parent_id) FROM relationship GROUP BY child_id""",
    "p5_ranks": "SELECT word_id, webpage_id, frequency, rank() OVER (PARTITION BY word_id ORDER BY frequency) AS rank FROM body_index",
}
