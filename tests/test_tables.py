"""Standing pages and postings."""

import datetime as dt

from spindrift.tables import act_pages, live_postings, on_act_pages, standing_pages, standing_postings

T = lambda d: dt.datetime(2025, 1, d)
PAGE = "webpage_id long, url string, title string, last_modified_date timestamp_ntz, size long, pagerank double, is_active boolean, is_crawled boolean"
POST = "webpage_id long, word_id long, frequency long, normalized_tf double, indexed_at timestamp_ntz"


def test_latest_version_stands_whatever_the_order(spark):
    rows = [(1, "u", "b", T(2), 2, 0.2, False, True), (1, "u", "a", T(1), 1, 0.1, True, True), (2, "v", None, None, None, None, True, True), (2, "v", None, None, None, None, True, True), (None, "x", None, T(1), 1, 1.0, True, True), (3, "w", "c", T(1), 1, 0.1, True, False)]
    df = spark.createDataFrame(rows, PAGE)
    got = {r.webpage_id: (r.title, r.is_active) for r in standing_pages(df).collect()}
    assert got == {1: ("b", False), 2: (None, True), 3: ("c", True)}
    assert [r.webpage_id for r in act_pages(df).collect()] == [2]


def test_soft_deleted_and_stale_postings(spark):
    rows = [(1, 1, 5, 0.5, T(1)), (1, 1, 0, 0.5, T(2)), (1, 2, 3, None, T(1)), (1, 2, 3, None, T(1)), (1, 3, 4, 0.1, T(3)), (1, 3, 9, 0.9, T(2)), (1, 4, 1, 0.1, T(1)), (1, 4, 2, 0.2, T(1)), (None, 1, 1, 1.0, T(1))]
    df = spark.createDataFrame(rows, POST)
    assert {(r.word_id, r.frequency) for r in standing_postings(df).collect()} == {(1, 0), (2, 3), (3, 4), (4, 2)}
    assert {(r.word_id, r.frequency, r.normalized_tf) for r in live_postings(df, True).collect()} == {(2, 3, None), (3, 4, 0.1), (4, 2, 0.2)}


def test_one_page_with_most_rows_meets_the_act_pages(spark):
    rows = [(1, w, 1, 1.0, T(1)) for w in range(300)] + [(p, 1, 1, 1.0, T(1)) for p in range(2, 40)]
    df = spark.createDataFrame(rows, POST)
    act = spark.createDataFrame([(1,), (3,)], "webpage_id long")
    got = on_act_pages(live_postings(df), act, df)
    assert got.count() == 301 and got.distinct().count() == 301


def test_empty_tables(spark):
    assert standing_pages(spark.createDataFrame([], PAGE)).count() == 0
    assert live_postings(spark.createDataFrame([], POST)).count() == 0


def test_postings_by_page_are_those_of_the_plain_way(spark, tmp_path, monkeypatch):
    """With and without large pages, and with columns added before the shuffle."""
    from pyspark.sql import functions as F

    from spindrift import skew
    from spindrift.tables import act_postings_by_page

    rows = [(1, w, 1 + w % 3, 1.0, T(1)) for w in range(300)] + [(1, w, 0, 1.0, T(2)) for w in range(0, 300, 7)] + [(p, p % 5, 2, 0.5, T(1)) for p in range(2, 40)] * 2 + [(None, 1, 1, 1.0, T(1)), (1, None, 1, 1.0, T(1))]
    for f in ("body", "title"):
        spark.createDataFrame(rows, POST).write.parquet(str(tmp_path / f"{f}_index.parquet"))
    spark.createDataFrame([(p, "u", None, T(1), 1, 1.0, p != 3, True) for p in range(1, 30)], PAGE).write.parquet(str(tmp_path / "webpage.parquet"))
    d = str(tmp_path)
    body = spark.read.parquet(f"{d}/body_index.parquet")
    want = {(r.webpage_id, r.word_id, r.frequency) for r in on_act_pages(live_postings(body), act_pages(spark.read.parquet(f"{d}/webpage.parquet")), body).collect()}
    got = act_postings_by_page(spark, d)
    assert got.keys == ["webpage_id", "__salt"]
    rows_ = got.rows.collect()
    assert len(rows_) == 2 * len(want) and {(r.webpage_id, r.word_id, r.frequency) for r in rows_ if r.field == "title"} == want
    assert sum(r["count"] for r in got.rows.groupBy(*got.keys, "word_id").count().collect()) == 2 * len(want)
    named = act_postings_by_page(spark, d, ("body",), with_tf=True, rename=lambda r: r.withColumn("term", F.col("word_id") % 10), part_by="term")
    by_term = {(r.webpage_id, r.term): r.f for r in named.rows.groupBy(*named.keys, "term").agg(F.sum("frequency").alias("f")).collect()}
    plain: dict = {}
    for p, w, f in want:
        plain[p, w % 10] = plain.get((p, w % 10), 0) + f
    assert by_term == plain
    monkeypatch.setattr(skew, "hot_keys", lambda *a, **k: skew.HotKeys())
    cold = act_postings_by_page(spark, d, ("body",))
    assert cold.keys == ["webpage_id"] and {(r.webpage_id, r.word_id, r.frequency) for r in cold.rows.collect()} == want
