"""Query descriptions and their validation, before any plan is built."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, replace
from urllib.parse import quote, unquote

from spindrift.config import DEFAULT, Config
from spindrift.operators.boolean import WordSets

LISTS = tuple(f"{v}_{k}" for v in ("title", "body", "page") for k in ("any", "all", "not"))


@dataclass(frozen=True)
class Query:
    """One search: free text, nine lists of words, an optional range of days (ISO)."""

    text: str = ""
    title_any: tuple[str, ...] = ()
    title_all: tuple[str, ...] = ()
    title_not: tuple[str, ...] = ()
    body_any: tuple[str, ...] = ()
    body_all: tuple[str, ...] = ()
    body_not: tuple[str, ...] = ()
    page_any: tuple[str, ...] = ()
    page_all: tuple[str, ...] = ()
    page_not: tuple[str, ...] = ()
    from_date: str | None = None
    to_date: str | None = None

    @property
    def kind(self) -> str:
        return "single" if any(getattr(self, n) for n in LISTS) or self.from_date or self.to_date else "simple"

    def is_admissible(self) -> bool:
        """Text or at least one word; dates alone are no query."""
        return bool(self.text.strip()) or any(getattr(self, n) for n in LISTS)

    def with_word(self, name: str, word: str) -> "Query":
        have = getattr(self, name)
        return self if word in have else replace(self, **{name: (*have, word)})

    def without_word(self, name: str, word: str) -> "Query":
        return replace(self, **{name: tuple(w for w in getattr(self, name) if w != word)})

    def with_dates(self, since: str | None, until: str | None) -> "Query":
        """A stored range counts only when both ends exist."""
        return replace(self, from_date=since, to_date=until) if since and until else self

    def words(self) -> set[str]:
        return {w for n in LISTS for w in getattr(self, n)}

    def sets(self, ids: Mapping[str, int]) -> WordSets:
        """Word ids by list; an unknown word gets -1, which no page has."""
        return WordSets(**{n: {ids.get(w, -1) for w in getattr(self, n)} for n in LISTS})

    def label(self) -> str:
        parts = [self.text] if self.text else []
        if self.from_date or self.to_date:
            parts.append(f"{self.from_date or ''}..{self.to_date or ''}")
        parts += [f"{n}: {', '.join(getattr(self, n))}" for n in LISTS if getattr(self, n)]
        return "; ".join(parts)


@dataclass(frozen=True)
class JoinedQuery:
    """Several searches combined: ``merged`` (union) or ``subquery`` (search within a result)."""

    queries: tuple["Query | JoinedQuery", ...]
    kind: str = "merged"

    def is_admissible(self, cfg: Config = DEFAULT) -> bool:
        most = cfg.max_merged_queries if self.kind == "merged" else cfg.max_sub_queries
        return self.kind in ("merged", "subquery") and 1 <= len(self.queries) <= most and all(q.is_admissible() for q in self.queries)

    def simplified(self) -> "Query | JoinedQuery":
        """A join of one query is that query."""
        return self.queries[0] if len(self.queries) == 1 else self

    def with_query(self, q: "Query", cfg: Config = DEFAULT) -> "JoinedQuery":
        most = cfg.max_merged_queries if self.kind == "merged" else cfg.max_sub_queries
        return self if len(self.queries) >= most else replace(self, queries=(*self.queries, q))

    def without_query(self, index: int) -> "JoinedQuery":
        return replace(self, queries=tuple(q for i, q in enumerate(self.queries) if i != index))


def from_history(rows: Iterable[Mapping], cfg: Config = DEFAULT) -> JoinedQuery:
    """A merged query of up to five history rows; a row that was itself a join becomes an empty search."""
    out = []
    for r in list(rows)[: cfg.max_merged_queries]:
        joined = r.get("type") in ("merged", "subquery")
        out.append(Query() if joined else Query(text=r.get("query") or "", **{n: tuple(r.get(n) or ()) for n in LISTS}, from_date=r.get("from_date"), to_date=r.get("to_date")))
    return JoinedQuery(tuple(out), "merged")


def similar_page(top_words: Iterable[str]) -> Query:
    """The search for pages like one page: any of its top words."""
    return Query(page_any=tuple(top_words))


def remaining_choices(words: Iterable[str], q: Query, view: str) -> list[str]:
    """Words still offered for a list: for the page lists those in no list, for a field's lists those not in its own."""
    names = LISTS if view == "page" else [n for n in LISTS if n.startswith(view)]
    taken = {w for n in names for w in getattr(q, n)}
    return [w for w in words if w not in taken]


def apply_suggestion(text: str, word: str, kind: str) -> str:
    """fuzzy: replaces the last token; co_occurring and relevant: appended; similar: the whole query."""
    if kind == "similar":
        return word
    tokens = text.rstrip().split(" ") if text.strip() else []
    if kind == "fuzzy":
        return " ".join([*tokens[:-1], word])
    return " ".join([*tokens, word])


def encode(q: Query) -> str:
    return quote(json.dumps(asdict(q), ensure_ascii=False))


def decode(s: str) -> Query:
    d = json.loads(unquote(s))
    return Query(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})
