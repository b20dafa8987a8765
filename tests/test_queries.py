"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = "q_tokenize q_postings_title q_keyword_totals q_phrases_rake q_idf_combined q_doc_norm q_top_tfidf_words q_bool_title_any q_bool_body_all q_bool_page_not q_bool_page_view_literal q_bool_combined q_query_vector q_search_ranked q_search_quoted q_search_modified_score q_joined_merged q_joined_subquery q_pmi_combined q_pmi_top_literal q_pagerank_literal q_pagerank_subset q_relevance_feedback q_suggest q_history_page q_upsert q_soft_delete_postings q_deactivate_edges q_extract_links q_report p5_found p5_keys p5_ranks "
NAMES += (
    "q_porter_stem q_postings_body q_keyword_dict q_assign_ids q_soft_delete_body q_report_limited q_text_index q_text_search q_text_search_vector q_text_search_quoted q_admissible q_query_label q_apply_suggestion q_remaining_choices "
    "q_query_builder q_merged_from_history q_query_codec q_bool_set_algebra q_dispatch q_joined_nested q_history_source q_interacted q_history_as_query q_history_containing q_history_not_containing q_history_edit q_display_score "
    "q_http_date q_page_metadata q_stopwords_file q_tokenize_contractions q_write_table q_upsert_lists q_crawl_batch q_pmi_refresh q_offline_build q_crawl_frontier"
)
NAMES = NAMES.split()


@pytest.fixture(scope="module")
def sql(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{small}/{f}'")
    return c


def _plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, small, sql, name):
    df = entry.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(_plain(v) for v in r)) for r in df.select(*cols).collect())
    cur = sql.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert sorted(d[0] for d in cur.description) == cols
    assert got == sorted(repr(tuple(_plain(r[i]) for i in at)) for r in cur.fetchall())


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, small):
    assert entry.entry(spark).columns == ["position", "webpage_id", "modified_score"]


def test_index_survives_writing(spark, small, tmp_path):
    from spindrift.operators.index import SearchIndex
    from spindrift.plans.engine import Engine
    from spindrift.plans.spec import Query

    ix = SearchIndex.of(spark, small)
    ix.write(str(tmp_path / "ix"))
    a = Engine(SearchIndex.read(spark, str(tmp_path / "ix"))).search(Query("crawler")).hits
    b = Engine(ix).search(Query("crawler")).hits
    r = lambda df: {(x.webpage_id, round(x.original_score, 9), round(x.modified_score, 9)) for x in df.collect()}
    assert r(a) == r(b) and r(a)


def test_unknown_query_has_no_hits(spark, small):
    from spindrift.operators.index import SearchIndex
    from spindrift.plans.engine import Engine
    from spindrift.plans.spec import Query

    e = Engine(SearchIndex.of(spark, small))
    assert e.search(Query("qqqqzzzz")).hits.count() == 0
    assert e.search(Query('crawler "qqqqzzzz"')).hits.count() == 0


def test_offline_build_feeds_the_engine(spark, small, tmp_path):
    from spindrift.plans.engine import Engine
    from spindrift.plans.offline import build_offline
    from spindrift.plans.spec import Query

    ix = build_offline(spark, small, str(tmp_path / "built"))
    e = Engine(ix, spark.read.parquet(str(tmp_path / "built" / "pmi")))
    hits = e.search(Query("crawler")).hits.collect()
    assert hits and all(0 <= r.modified_score <= 1.0000001 for r in hits)
    assert ix.pages.filter("pagerank is null").count() == 0
