"""Query descriptions."""

from spindrift.plans import spec
from spindrift.plans.spec import JoinedQuery, Query


def test_admissible():
    assert Query("x").is_admissible() and Query(title_any=("a",)).is_admissible()
    assert not Query().is_admissible() and not Query(from_date="2025-01-01").is_admissible()
    assert JoinedQuery((Query("a"),) * 5).is_admissible() and not JoinedQuery((Query("a"),) * 6).is_admissible()
    assert not JoinedQuery((Query("a"),) * 3, "subquery").is_admissible() and not JoinedQuery(()).is_admissible()
    assert not JoinedQuery((Query("a"), Query())).is_admissible()


def test_editing():
    q = Query("x").with_word("title_any", "a").with_word("title_any", "a").with_word("page_not", "b")
    assert q.title_any == ("a",) and q.without_word("title_any", "a").title_any == () and q.kind == "single" and Query("x").kind == "simple"
    assert q.with_dates("2025-01-01", None).from_date is None and q.with_dates("2025-01-01", "2025-01-02").to_date == "2025-01-02"
    j = JoinedQuery((Query("a"), Query("b")), "subquery")
    assert j.with_query(Query("c")) == j and j.without_query(0).simplified() == Query("b")
    assert spec.decode(spec.encode(q)) == q and "title_any: a" in q.label()


def test_from_history():
    j = spec.from_history([{"type": "simple", "query": "a"}, {"type": "merged"}, {"type": "single", "title_any": ["t"]}] + [{"query": "z"}] * 5)
    assert [q.text for q in j.queries] == ["a", "", "", "z", "z"] and j.queries[2].title_any == ("t",)


def test_choices_and_suggestions():
    q = Query(title_any=("a",), body_any=("b",))
    assert spec.remaining_choices(["a", "b", "c"], q, "page") == ["c"] and spec.remaining_choices(["a", "b", "c"], q, "title") == ["b", "c"]
    assert spec.apply_suggestion("red fo", "fox", "fuzzy") == "red fox" and spec.apply_suggestion("red", "fox", "relevant") == "red fox" and spec.apply_suggestion("x", "whole", "similar") == "whole"
    assert spec.similar_page(["a", "b"]).page_any == ("a", "b")


def test_unknown_words_match_nothing():
    assert Query(page_all=("nowhere",)).sets({}).page_all == {-1}
