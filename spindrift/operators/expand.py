"""Query expansion: fuzzy words, co-occurring words, relevance feedback.

A query vector is a small table (word_id, weight); history is long form:
queries (query_id, word_id, weight) and interactions (query_id, webpage_id, relevance).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.config import DEFAULT, Config
from spindrift.functions.text import substring_probability
from spindrift.operators.pmi import both_directions
from spindrift.session import broadcast_if_small, materialize


def dense_top(df: DataFrame, value: str, n: int) -> DataFrame:
    """Rows whose ``value`` is among the ``n`` highest distinct values, ties kept; only n values travel.  The rows are written, as both steps read them."""
    df = materialize(df, "candidates")
    best = df.select(value).filter(F.col(value).isNotNull()).distinct().orderBy(F.desc(value)).limit(n)
    return df.join(F.broadcast(best), value, "left_semi").select(*df.columns)


def fuzzy_words(keyword: DataFrame, terms: dict[str, float], exact: Sequence[str] = ()) -> DataFrame:
    """(word_id, word, weight): stored words that contain a query term, by term weight times substring probability.

    A word that contains several terms takes the highest value; the query's own words are left out.  The
    terms are literals in one scan of the dictionary, so there is no join.
    """
    found: list[Column] = []
    for t, v in sorted(terms.items()):
        found.append(F.when(F.contains(F.col("word"), F.lit(t)), F.lit(float(v)) * substring_probability(F.lit(t), F.col("word"))))
    if not found:
        return keyword.select("word_id", "word", F.lit(0.0).alias("weight")).limit(0)
    value = F.greatest(*found, F.lit(None).cast("double")) if len(found) == 1 else F.greatest(*found)
    out = keyword.select("word_id", "word", F.round(value, 9).alias("weight")).filter(F.col("weight").isNotNull())
    return out.filter(~F.col("word").isin(sorted(set(exact) | set(terms))))


def top_fuzzy(keyword: DataFrame, terms: dict[str, float], cfg: Config = DEFAULT) -> DataFrame:
    return dense_top(fuzzy_words(keyword, terms), "weight", cfg.max_fuzzy_words)


def co_occurring(pmi: DataFrame, query_tf: DataFrame, idf: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """(word_id, weight): words paired with exactly one side in the query.

    tf(b) = pmi / max(pmi) * co-occurrence weight * tf(a), the highest over the query's words; times the
    word's idf where ``idf`` (word_id, idf) is given; words among the highest distinct values are kept.
    """
    highest = pmi.agg(F.max("pmi").alias("highest"))
    q = F.broadcast(query_tf.select("word_id", F.col("tf")))
    pairs = both_directions(pmi).join(q, "word_id").join(F.broadcast(query_tf.select(F.col("word_id").alias("other_id"))), "other_id", "left_anti")
    tf = F.try_divide(F.col("pmi"), F.col("highest")) * cfg.co_occurrence_weight * F.col("tf")
    out = pairs.crossJoin(F.broadcast(highest)).groupBy("other_id").agg(F.max(tf).alias("weight")).withColumnRenamed("other_id", "word_id")
    if idf is not None:
        out = out.join(idf.select("word_id", "idf"), "word_id").select("word_id", (F.col("weight") * F.col("idf")).alias("weight"))
    return dense_top(out.withColumn("weight", F.round("weight", 9)), "weight", cfg.max_co_occurrence_terms)


def similar_queries(past: DataFrame, query: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(query_id, similarity): past query vectors by cosine with ``query`` (word_id, weight), rounded to 3 digits, the highest distinct ones above 0."""
    norms = past.groupBy("query_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("pn"))
    qn = query.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("qn"))
    dot = past.join(F.broadcast(query.select("word_id", F.col("weight").alias("q"))), "word_id").groupBy("query_id").agg(F.sum(F.col("weight") * F.col("q")).alias("dot"))
    sim = F.round(F.coalesce(F.try_divide(F.col("dot"), F.col("pn") * F.col("qn")), F.lit(0.0)), 3)
    out = dot.join(norms, "query_id").crossJoin(F.broadcast(qn)).select("query_id", sim.alias("similarity")).filter("similarity > 0")
    return dense_top(out, "similarity", cfg.max_relevant_queries)


def relevance_feedback(query: DataFrame, similar: DataFrame, interactions: DataFrame, page_words: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(word_id, weight): the query moved towards words of liked pages and away from words of disliked ones.

    r = relevance * similarity per interaction with a page of a similar query; positive r are divided by their
    sum and weighted, negative ones likewise by the sum of their magnitudes.  A sum of 0 contributes nothing.
    """
    r = interactions.join(broadcast_if_small(similar)[0], "query_id").select("webpage_id", (F.col("relevance") * F.col("similarity")).alias("r"))
    sums = r.agg(F.sum(F.when(F.col("r") > 0, F.col("r"))).alias("pos"), F.sum(F.when(F.col("r") < 0, -F.col("r"))).alias("neg"))
    scale = F.when(F.col("r") > 0, F.try_divide(F.col("r") * cfg.relevant_weight, F.col("pos"))).when(F.col("r") < 0, F.try_divide(F.col("r") * cfg.non_relevant_weight, F.col("neg")))
    pages = r.crossJoin(F.broadcast(sums)).select("webpage_id", scale.alias("s")).filter("s is not null").groupBy("webpage_id").agg(F.sum("s").alias("s"))
    moved = page_words.join(pages, "webpage_id").select("word_id", (F.col("weight") * F.col("s")).alias("weight"))
    return query.select("word_id", "weight").unionByName(moved).groupBy("word_id").agg(F.sum("weight").alias("weight"))


def relevant_words(original: DataFrame, modified: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(word_id, weight): the words that feedback added with a weight of at least 0, the five highest (ties: the smaller id)."""
    new = modified.join(F.broadcast(original.select("word_id")), "word_id", "left_anti").withColumn("weight", F.round("weight", 9)).filter("weight >= 0")
    return new.orderBy(F.desc("weight"), "word_id").limit(cfg.max_ranked_words)


def average_vectors(vectors: DataFrame, n: int) -> DataFrame:
    """(word_id, weight): sum over the vectors divided by their number, whether or not a vector has the word."""
    return vectors.groupBy("word_id").agg((F.sum("weight") / F.lit(n)).alias("weight"))


def first_k(df: DataFrame, group: str, by: str, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(by)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
