"""The history of queries and interactions: filters, search, pagination, edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.skew import range_rank


def relevance(liked_state: Column) -> Column:
    """-1 for a dislike, else 1."""
    return F.when(F.coalesce(liked_state == "disliked", F.lit(False)), F.lit(-1)).otherwise(F.lit(1))


def interacted(pages: DataFrame, liked_state: str = "likeState", clicked: str = "clicked") -> DataFrame:
    """Pages that were liked, disliked or clicked, with their relevance; a dislike weighs more than a click."""
    state = F.col(liked_state)
    return pages.filter(state.isin("liked", "disliked") | F.coalesce(F.col(clicked), F.lit(False))).withColumn("relevance", relevance(state))


def display_score(score: Column) -> Column:
    """A score as a percentage of four significant digits, as a number; 0 stays 0."""
    percent = score * 100
    digits = F.lit(3) - F.floor(F.log10(F.abs(percent))).cast("int")
    return F.when(percent == 0, F.lit(0.0)).otherwise(F.round(percent * F.pow(F.lit(10.0), digits), 0) / F.pow(F.lit(10.0), digits))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows in the given order, with the running number ``row``; only rows up to the page are sorted out."""
    top = df.orderBy(*order).limit((number + 1) * size)
    w = Window.orderBy(*order)
    return top.withColumn("row", F.row_number().over(w)).filter(F.col("row") > number * size)


def of_types(df: DataFrame, types: Sequence[str], column: str = "type") -> DataFrame:
    return df.filter(F.col(column).isin(list(types)))


def containing(df: DataFrame, needle: str) -> DataFrame:
    """Rows whose JSON text holds the needle, both lower-cased."""
    return df.filter(F.contains(F.lower(F.to_json(F.struct(*df.columns))), F.lit(needle.lower())))


def not_chosen(df: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(chosen.select(*keys).distinct(), list(keys), "left_anti")


def chosen(df: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(others.select(*keys).distinct(), list(keys), "left_semi")


def containing_query(df: DataFrame, needle: Column | str, kind: str, json: str = "json", type_column: str = "type") -> DataFrame:
    """Rows of that type whose query, as JSON text, holds the needle's JSON text (what tells whether a row is the chosen one)."""
    return df.filter((F.col(type_column) == kind) & F.contains(F.col(json), needle if isinstance(needle, Column) else F.lit(needle)))


def not_containing_query(df: DataFrame, needle: Column | str, kind: str, json: str = "json", type_column: str = "type") -> DataFrame:
    """The rows that :func:`containing_query` leaves out."""
    held = (F.col(type_column) == kind) & F.contains(F.col(json), needle if isinstance(needle, Column) else F.lit(needle))
    return df.filter(~F.coalesce(held, F.lit(False)))


def index_of(df: DataFrame, order: Sequence[str], condition: Column) -> int:
    """Zero-based position, in ascending ``order``, of the first row that meets the condition, or -1; any size (range-partitioned)."""
    ranked = range_rank(df.select(*order, condition.alias("__hit")), [], order, label="history")
    first = ranked.filter("__hit").agg(F.min("position")).first()[0]
    return -1 if first is None else int(first) - 1


def append(history: DataFrame, rows: DataFrame) -> DataFrame:
    return history.unionByName(rows, allowMissingColumns=True)


def replace_at(history: DataFrame, key: str, value: object, row: DataFrame) -> DataFrame:
    """The row with that key replaced."""
    return history.filter(F.col(key) != F.lit(value)).unionByName(row.select(*history.columns))


def without_results(history: DataFrame) -> DataFrame:
    """A history row as a query: its result, vector and date columns dropped."""
    return history.drop("webpages", "original_query_vector", "modified_query_vector", "date", "ts")


def by_user(events: DataFrame) -> DataFrame:
    """Interactions from an event stream table: (query_id = user_id, event_id, ts, relevance); other events aren't interactions."""
    r = F.when(F.col("event_type").isin("click", "purchase"), 1).when(F.col("event_type") == "error", -1)
    return events.select(F.col("user_id").alias("query_id"), "event_id", "ts", r.alias("relevance")).filter("relevance is not null")
