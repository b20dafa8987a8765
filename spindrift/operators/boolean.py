"""Boolean retrieval: pages by any / all / none of some words, per field or on the whole page."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_view(postings: DataFrame, view: str) -> DataFrame:
    """Postings of one field, or for ``page`` of either; live ones only."""
    live = postings.filter(F.col("frequency") >= 1)
    if view == "page":
        return live.select("webpage_id", "word_id").distinct()
    return live.filter(F.col("field") == view).select("webpage_id", "word_id")


def having_any(view: DataFrame, words: Iterable[int]) -> DataFrame:
    return view.filter(F.col("word_id").isin(sorted(words))).select("webpage_id").distinct()


def having_all(view: DataFrame, words: Iterable[int]) -> DataFrame:
    """Relational division: pages that have every one of the words."""
    w = sorted(set(words))
    return view.filter(F.col("word_id").isin(w)).groupBy("webpage_id").agg(F.countDistinct("word_id").alias("n")).filter(F.col("n") == len(w)).select("webpage_id")


def having_other(view: DataFrame, words: Iterable[int]) -> DataFrame:
    """Pages that have some word outside the set (what the literal form of ``not`` excludes)."""
    return view.filter(~F.col("word_id").isin(sorted(words))).select("webpage_id").distinct()


def literal_page_view(title: DataFrame, body: DataFrame) -> DataFrame:
    """Title and body postings merged by a full outer join with the liveness test in its condition: soft-deleted ones stay in."""
    t, b = title.alias("t"), body.alias("b")
    on = (F.col("t.webpage_id") == F.col("b.webpage_id")) & (F.col("t.word_id") == F.col("b.word_id")) & (F.col("t.frequency") >= 1) & (F.col("b.frequency") >= 1)
    return t.join(b, on, "full_outer").select(F.coalesce("t.webpage_id", "b.webpage_id").alias("webpage_id"), F.coalesce("t.word_id", "b.word_id").alias("word_id"))


@dataclass
class WordSets:
    """Nine sets of word ids; ``reduced`` applies the set algebra that drops redundant and contradicting words."""

    title_any: set[int] = field(default_factory=set)
    title_all: set[int] = field(default_factory=set)
    title_not: set[int] = field(default_factory=set)
    body_any: set[int] = field(default_factory=set)
    body_all: set[int] = field(default_factory=set)
    body_not: set[int] = field(default_factory=set)
    page_any: set[int] = field(default_factory=set)
    page_all: set[int] = field(default_factory=set)
    page_not: set[int] = field(default_factory=set)

    def reduced(self) -> "WordSets":
        out = {}
        for v in ("title", "body", "page"):
            some, every, none = (set(getattr(self, f"{v}_{k}")) for k in ("any", "all", "not"))
            every -= none
            out |= {f"{v}_any": some - every - none, f"{v}_all": every, f"{v}_not": none}
        out["page_any"] -= out["body_any"] | out["body_all"] | out["title_any"] | out["title_all"]
        return WordSets(**out)

    def wanted(self) -> set[int]:
        return self.title_any | self.title_all | self.body_any | self.body_all | self.page_any | self.page_all

    def unwanted(self) -> set[int]:
        return self.title_not | self.body_not | self.page_not


def candidates(pages: DataFrame, postings: DataFrame, sets: WordSets, dates: Column | None = None, literal_not: bool = False, closed: bool = False) -> DataFrame:
    """webpage_id of the pages that satisfy every non-empty set and the date condition; a chain of semi and anti joins.

    ``closed`` says that ``postings`` are of ``pages`` only: then the chain begins with the first set of wanted words, and the
    pages are read for dates or for want of such a set alone.
    """
    s = sets.reduced()
    views = {v: field_view(postings, v) for v in ("title", "body", "page")}
    wanted = [of(views[v], getattr(s, f"{v}_{kind}")) for v in views for kind, of in (("any", having_any), ("all", having_all)) if getattr(s, f"{v}_{kind}")]
    if closed and dates is None and wanted:
        out = wanted.pop(0)
    else:
        out = (pages if dates is None else pages.filter(dates)).select("webpage_id")
    for rows in wanted:
        out = out.join(rows, "webpage_id", "left_semi")
    for v in views:
        words = getattr(s, f"{v}_not")
        if words:
            out = out.join((having_other if literal_not else having_any)(views[v], words), "webpage_id", "left_anti")
    return out


def date_range(column: str, since: str | None = None, until: str | None = None) -> Column:
    """Whole days from ``since`` to ``until`` inclusive (ISO dates), each optional; a null date is in no limited range."""
    c, out = F.col(column), F.lit(True)
    if since:
        out = out & (c >= F.lit(since).cast("date").cast("timestamp_ntz"))
    if until:
        out = out & (c < F.date_add(F.lit(until).cast("date"), 1).cast("timestamp_ntz"))
    return out
