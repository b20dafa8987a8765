"""Retrieval operators on four pages: p1 spark spark join, p2 spark sort, p3 join join sort, p4 graph."""

import math

import pytest
from pyspark.sql import functions as F

from spindrift.functions import vector as vec
from spindrift.operators import boolean, expand, history, index, joined, pagerank, pmi, report

SPARK, JOIN, SORT, GRAPH = 1, 2, 3, 4
DOCS = [(1, "Spark spark join"), (2, "spark, sort"), (3, "join join sort"), (4, "graph"), (5, ""), (6, None), (7, "the and of")]
IDS = {"spark": SPARK, "join": JOIN, "sort": SORT, "graph": GRAPH}


@pytest.fixture(scope="module")
def posts(spark):
    p = index.text_postings(spark.createDataFrame(DOCS, "webpage_id long, t string"), "webpage_id", "t", "body")
    ids = spark.createDataFrame(list(IDS.items()), "term string, word_id long")
    return p.join(ids, "term").select("webpage_id", "field", "word_id", "frequency", "normalized_tf").cache()


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i,) for i in range(1, 5)], "webpage_id long")


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_normalized_tf(posts):
    assert rows(posts, "webpage_id", "word_id", "normalized_tf") == {(1, SPARK, 1.0), (1, JOIN, 0.5), (2, SPARK, 1.0), (2, SORT, 1.0), (3, JOIN, 1.0), (3, SORT, 0.5), (4, GRAPH, 1.0)}


def test_phrases_take_the_smallest_frequency(spark):
    d = spark.createDataFrame([(1, "red fox and red fox and red hat")], "d long, t string")
    got = {r.term: r.frequency for r in index.text_postings(d, "d", "t", "body", with_phrases=True).collect()}
    assert got == {"red": 3, "fox": 2, "hat": 1, "red fox": 2, "red hat": 1}


def test_idf(posts):
    got = {r.word_id: r.idf for r in index.idf(posts, 4).collect()}
    assert got == pytest.approx({SPARK: math.log10(2), JOIN: math.log10(2), SORT: math.log10(2), GRAPH: math.log10(4)})


def test_word_on_every_page_has_no_weight(posts):
    assert GRAPH not in {r.word_id for r in index.combined_idf(index.idf(posts.filter("webpage_id = 4"), 1)).collect()}


def test_cosine(spark, posts):
    v = index.document_vectors(posts, index.idf(posts, 4))
    n = {r.webpage_id: r.norm for r in index.norms(v, "webpage_id").collect()}
    q = spark.createDataFrame([(SPARK, 1.0)], "word_id long, q double")
    got = {r.webpage_id: r.dot / n[r.webpage_id] for r in vec.dots(v, "webpage_id", q).collect()}
    assert got == pytest.approx({1: 1 / math.sqrt(1.25), 2: 1 / math.sqrt(2)})


@pytest.mark.parametrize("kind, words, want", [("any", {SPARK, GRAPH}, {1, 2, 4}), ("all", {SPARK, JOIN}, {1}), ("not", {SPARK}, {3, 4}), ("any", {-1}, set())])
@pytest.mark.parametrize("view", ["body", "page"])
def test_boolean(pages, posts, view, kind, words, want):
    got = boolean.candidates(pages, posts, boolean.WordSets(**{f"{view}_{kind}": words}))
    assert {r[0] for r in got.collect()} == want


def test_literal_not_excludes_pages_with_other_words(pages, posts):
    got = boolean.candidates(pages, posts, boolean.WordSets(body_not={SPARK}), literal_not=True)
    assert got.count() == 0


def test_set_algebra():
    s = boolean.WordSets(title_any={1, 2, 3}, title_all={2, 4}, title_not={3, 4}, page_any={1, 2, 5}).reduced()
    assert (s.title_any, s.title_all, s.title_not, s.page_any) == ({1}, {2}, {3, 4}, {5})


def test_soft_deleted_postings_only_in_the_literal_view(spark):
    t = spark.createDataFrame([(1, 1, 0)], "webpage_id long, word_id long, frequency long")
    b = spark.createDataFrame([(1, 2, 3)], "webpage_id long, word_id long, frequency long")
    assert rows(boolean.literal_page_view(t, b), "webpage_id", "word_id") == {(1, 1), (1, 2)}
    both = t.withColumn("field", F.lit("title")).unionByName(b.withColumn("field", F.lit("body")))
    assert rows(boolean.field_view(both, "page"), "word_id") == {(2,)}


def test_whole_days(spark):
    d = spark.createDataFrame([(1, "2025-01-01 00:00:00"), (2, "2025-03-31 23:59:59"), (3, "2025-04-01 00:00:00"), (4, None)], "i long, s string").withColumn("d", F.col("s").cast("timestamp_ntz"))
    assert rows(d.filter(boolean.date_range("d", "2025-01-01", "2025-03-31")), "i") == {(1,), (2,)}
    assert rows(d.filter(boolean.date_range("d", None, "2025-01-01")), "i") == {(1,)}


def test_joined_lists(spark):
    a = spark.createDataFrame([(1, 0.8), (2, 0.4)], "webpage_id long, score double")
    b = spark.createDataFrame([(2, 0.6), (3, 0.2)], "webpage_id long, score double")
    as_dict = lambda df: {r.webpage_id: pytest.approx(r.score) for r in df.collect()}
    assert as_dict(joined.merged([a, b])) == {1: 0.4, 2: 0.5, 3: 0.1}
    assert as_dict(joined.within(a, b)) == {1: 0.4, 2: 0.5}
    assert as_dict(joined.within(a, b, strict=True)) == {2: 0.5}
    assert joined.within(a.limit(0), b).count() == 0


def test_pmi_of_one_pair(spark):
    p = spark.createDataFrame([(1, "body", 1, 5), (1, "body", 2, 4), (2, "body", 3, 3), (2, "body", 4, 28)], "webpage_id long, field string, word_id long, frequency long")
    got = pmi.page_values(p, "body").collect()
    assert [(r.word1_id, r.word2_id) for r in got] == [(1, 2)] and got[0].pmi == pytest.approx(math.log10(8), abs=1e-9)
    t = pmi.page_values(p, "title")
    assert t.count() == 0
    assert pmi.combine_fields(t, pmi.page_values(p, "body")).first().pmi == pytest.approx(0.632163, abs=1e-6)


def test_pmi_tops_and_refresh(spark):
    v = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (2, 3, 0.7), (4, 5, 0.6)], "word1_id long, word2_id long, pmi double")
    assert rows(pmi.top_literal(v, 2), "word1_id", "word2_id") == {(1, 2), (1, 3)}
    assert rows(pmi.top_per_term(v, 1), "word1_id", "word2_id") == {(1, 2), (1, 3), (4, 5)}
    rest, affected = pmi.delete_words(v, spark.createDataFrame([(3,)], "word_id long"))
    assert rows(rest, "word1_id", "word2_id") == {(1, 2), (4, 5)} and rows(affected, "word_id") == {(1,), (2,), (3,)}
    new = spark.createDataFrame([(1, 2, 0.5), (4, 5, 0.1)], "word1_id long, word2_id long, pmi double")
    assert rows(pmi.refresh(v, new, spark.createDataFrame([(3,)], "word_id long")), "word1_id", "word2_id", "pmi") == {(1, 2, 0.5), (4, 5, 0.6)}


EDGES = [(1, 2), (1, 3), (2, 3)]


@pytest.mark.parametrize("mode, want", [("standard", {1: 1.0, 2: 0.575, 3: 1.425}), ("literal", {1: 1.0, 2: 1.575, 3: 2.425})])
def test_pagerank_one_round(spark, mode, want):
    e = spark.createDataFrame(EDGES, "parent_id long, child_id long")
    act = spark.createDataFrame([(1,), (2,), (3,)], "webpage_id long")
    assert {r.webpage_id: r.pagerank for r in pagerank.pagerank(e, act, mode, rounds=1).collect()} == pytest.approx(want)


def test_pagerank_rounds_match_a_plain_loop(spark):
    edges = [(i, (i * 7 + j) % 23) for i in range(23) for j in (1, 5, 11) if (i * 7 + j) % 23 != i]
    e = spark.createDataFrame(edges, "parent_id long, child_id long")
    act = spark.createDataFrame([(i,) for i in range(24)], "webpage_id long")
    r = {i: 1.0 for i in range(24)}
    out = {i: sum(a == i for a, _ in edges) for i in r}
    for _ in range(7):
        r = {i: 0.15 + 0.85 * sum(r[a] / out[a] for a, b in edges if b == i) if any(b == i for _, b in edges) else r[i] for i in r}
    assert {x.webpage_id: x.pagerank for x in pagerank.pagerank(e, act, rounds=7).collect()} == pytest.approx(r)


def test_pagerank_subset_keeps_the_others(spark):
    e = spark.createDataFrame(EDGES, "parent_id long, child_id long")
    act = spark.createDataFrame([(1,), (2,), (3,)], "webpage_id long")
    stored = spark.createDataFrame([(1, 4.0), (2, None)], "webpage_id long, pagerank double")
    got = pagerank.pagerank(e, act, rounds=1, only=act.filter("webpage_id = 3"), stored=stored)
    assert {r.webpage_id: r.pagerank for r in got.collect()} == pytest.approx({1: 4.0, 2: 1.0, 3: 0.15 + 0.85 * 3.0})


def test_live_edges_need_both_ends(spark):
    rel = spark.createDataFrame([(1, 2, True), (1, 2, True), (1, 9, True), (2, 1, False), (2, 2, True)], "parent_id long, child_id long, is_active boolean")
    assert rows(pagerank.live_edges(rel, spark.createDataFrame([(1,), (2,)], "webpage_id long")), "parent_id", "child_id") == {(1, 2)}


def test_min_max_of_an_empty_range(spark):
    d = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None)], "webpage_id long, pagerank double")
    assert {r.scaled for r in pagerank.min_max_scaled(d).collect()} == {0.0}


@pytest.mark.parametrize("relevance, want", [(1, 0.2), (-1, -0.1)])
def test_feedback(spark, relevance, want):
    q = spark.createDataFrame([], "word_id long, weight double")
    similar = spark.createDataFrame([(1, 0.5)], "query_id long, similarity double")
    inter = spark.createDataFrame([(1, 7, relevance)], "query_id long, webpage_id long, relevance long")
    words = spark.createDataFrame([(7, 3, 0.4)], "webpage_id long, word_id long, weight double")
    got = expand.relevance_feedback(q, similar, inter, words).collect()
    assert [(r.word_id, pytest.approx(r.weight)) for r in got] == [(3, want)]


def test_feedback_without_history_is_the_query(spark):
    q = spark.createDataFrame([(1, 0.5)], "word_id long, weight double")
    e = lambda s: spark.createDataFrame([], s)
    got = expand.relevance_feedback(q, e("query_id long, similarity double"), e("query_id long, webpage_id long, relevance long"), e("webpage_id long, word_id long, weight double"))
    assert [(r.word_id, r.weight) for r in got.collect()] == [(1, 0.5)]


def test_similar_queries_keep_ties(spark):
    past = spark.createDataFrame([(i, 1, 1.0) for i in range(8)] + [(9, 2, 1.0)], "query_id long, word_id long, weight double")
    q = spark.createDataFrame([(1, 2.0)], "word_id long, weight double")
    assert rows(expand.similar_queries(past, q), "query_id", "similarity") == {(i, 1.0) for i in range(8)}


def test_co_occurring_words_need_one_end_outside(spark):
    p = spark.createDataFrame([(1, 2, 1.0), (1, 3, 0.5), (3, 4, 0.9)], "word1_id long, word2_id long, pmi double")
    q = spark.createDataFrame([(1, 1.0), (2, 0.5)], "word_id long, tf double")
    assert rows(expand.co_occurring(p, q), "word_id", "weight") == {(3, 0.25)}


def test_fuzzy_words(spark):
    k = spark.createDataFrame([(1, "abcab"), (2, "ab"), (3, "xyz"), (4, None)], "word_id long, word string")
    assert rows(expand.fuzzy_words(k, {"ab": 1.0}), "word_id", "weight") == {(1, 0.5)}
    assert expand.fuzzy_words(k, {}).count() == 0


def test_neighbours_are_the_lowest_ids(spark):
    rel = spark.createDataFrame([(1, c, True) for c in range(9, 1, -1)] + [(1, 10, False)], "parent_id long, child_id long, is_active boolean")
    pages = spark.createDataFrame([(i, f"u{i}") for i in range(1, 11)], "webpage_id long, url string")
    got = report.neighbours(rel, pages, 5).filter("webpage_id = 1 and kind = 'child'")
    assert rows(got, "rank", "neighbour_id") == {(i, i + 1) for i in range(1, 6)}


def test_history(spark):
    h = spark.createDataFrame([(i, "simple" if i % 2 else "single", f"Query {i}") for i in range(12)], "n long, type string, query string")
    assert [r.n for r in history.page(h, [F.desc("n")], 1, 5).orderBy("row").collect()] == [6, 5, 4, 3, 2]
    assert history.page(h, [F.desc("n")], 9, 5).count() == 0
    assert history.of_types(h, ["simple"]).count() == 6
    assert rows(history.containing(h, "QUERY 11"), "n") == {(11,)}
    assert history.index_of(h, ["n"], F.col("type") == "simple") == 1
    assert history.index_of(h, ["n"], F.col("type") == "none") == -1
    assert history.not_chosen(h, h.filter("n < 10"), ["n"]).count() == 2 and history.chosen(h, h.filter("n < 10"), ["n"]).count() == 10
    assert history.replace_at(h, "n", 3, spark.createDataFrame([(3, "x", "y")], h.schema)).filter("type = 'x'").count() == 1
    assert history.append(h, h.limit(1)).count() == 13


def test_interacted_pages_and_display(spark):
    p = spark.createDataFrame([(1, "liked", False), (2, "disliked", True), (3, None, True), (4, None, None), (5, "neutral", False)], "webpage_id long, likeState string, clicked boolean")
    assert rows(history.interacted(p), "webpage_id", "relevance") == {(1, 1), (2, -1), (3, 1)}
    d = spark.createDataFrame([(0.123456,), (0.0,), (0.00012344,)], "s double")
    assert [r[0] for r in d.select(history.display_score(F.col("s"))).collect()] == pytest.approx([12.35, 0.0, 0.01234])


def test_bucketed_tables_join_without_a_shuffle(spark):
    from spindrift.session import drop_materialized, materialize_by

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = materialize_by(spark.range(400).selectExpr("id % 20 as parent_id", "id as child_id"), "edges", "parent_id")
        ranks = spark.range(20).selectExpr("id as webpage_id", "1.0 as rank").groupBy("webpage_id").sum("rank").withColumnRenamed("webpage_id", "parent_id")
        joined = edges.join(ranks, "parent_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and joined.count() == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert drop_materialized() >= 1
