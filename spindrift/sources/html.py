"""Pages from HTML: title, text, links, header metadata."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import url as fu

_SILENT = {"script", "style", "template", "noscript"}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] = []
        self.links: list[str] = []
        self._silent = 0
        self._title = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SILENT:
            self._silent += 1
        elif tag == "title":
            self._title += 1
        elif tag == "a":
            href = dict(attrs).get("href")
            if href:
                self.links.append(href)

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT and self._silent:
            self._silent -= 1
        elif tag == "title" and self._title:
            self._title -= 1

    def handle_data(self, data: str) -> None:
        if self._silent:
            return
        self.parts.append(data)
        if self._title:
            self.title.append(data)


def parse_html(html: str | None) -> tuple[str, str, list[str]]:
    """(title, text of the whole page with its title, link targets in order); script, style and comments are left out."""
    p = _Text()
    p.feed(html or "")
    p.close()
    return "".join(p.title).strip(), "".join(p.parts), p.links


def parse_pages(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, title, text, links) by Arrow batches."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = [parse_html(h) for h in b[html]]
            yield pd.DataFrame({key: b[key], "title": [p[0] for p in parsed], "text": [p[1] for p in parsed], "links": [p[2] for p in parsed]})

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, title string, text string, links array<string>")


def title_of(html: Column) -> Column:
    """The <title> of a page, '' if there is none; native, for pages without markup inside the title."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(pages: DataFrame, page_url: str = "url", html: str = "html") -> DataFrame:
    """(url, child_url): distinct normalised link targets of every <a href>, self-links left out; read by the HTML parser, whatever the quotes and case."""
    raw = parse_pages(pages, page_url, html).select(F.col(page_url).alias("url"), F.explode("links").alias("href"))
    out = raw.select("url", fu.normalize(F.col("href"), F.col("url")).alias("child_url"))
    return out.filter("child_url is not null and child_url <> url").distinct()


def metadata(last_modified: Column, date: Column, content_length: Column, html: Column) -> tuple[Column, Column]:
    """(last_modified_date, size): the Last-Modified header or else Date; Content-Length or else the length in characters."""
    return F.coalesce(fu.http_date(last_modified), fu.http_date(date)), F.coalesce(content_length.try_cast("long") if hasattr(content_length, "try_cast") else content_length.cast("long"), F.length(html).cast("long"))


def read_pages(spark, path: str) -> DataFrame:
    """Fetched pages (url, html, headers ...) stored as Parquet; fetching itself is outside the engine."""
    return spark.read.parquet(path)


#: A stored query with its result: what the history source yields.
HISTORY = (
    "type string, query string, "
    + ", ".join(f"{v}_{k} array<struct<word:string,word_id:bigint>>" for v in ("title", "body", "page") for k in ("any", "all", "not"))
    + ", from_date string, to_date string, date string, original_query_vector map<string,struct<word_id:bigint,weight:double>>, modified_query_vector map<string,struct<word_id:bigint,weight:double>>"
    + ", webpages array<struct<webpage_id:bigint,url:string,relevance:int,clicked:boolean,likeState:string>>, queries array<struct<type:string,query:string>>"
)


def read_history(spark, path: str, array: bool = False) -> DataFrame:
    """History rows with the schema HISTORY, from JSON lines, or from files of one JSON array each."""
    if not array:
        return spark.read.schema(HISTORY).json(path)
    return history_rows(spark.read.text(path, wholetext=True), "value")


def history_rows(texts: DataFrame, column: str) -> DataFrame:
    """The rows of JSON arrays in a text column; texts that are none give no rows."""
    return texts.select(F.explode(F.from_json(column, f"array<struct<{HISTORY_FIELDS}>>")).alias("h")).select("h.*")


HISTORY_FIELDS = ", ".join(f"{name}:{kind}" for name, kind in (f.split(" ", 1) for f in HISTORY.split(", ")))
