"""Upsert, soft delete, deactivation, identifiers, a whole crawl batch, streaming maintenance, crawl and report."""

import datetime as dt

from spindrift.operators import crawl, storage
from spindrift.operators.report import report, write_report
from spindrift.streaming.incremental import maintain


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_upsert_and_ignore(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, s string, n long")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "k long, s string, n long")
    assert rows(storage.upsert(old, new, ["k"]), "k", "s", "n") == {(1, "a", 1), (2, None, 9), (3, "c", 3)}
    assert rows(storage.upsert(old, new, ["k"], ["n"]), "k", "s", "n") == {(1, "a", 1), (2, "b", 9), (3, "c", 3)}
    every, fresh = storage.insert_new(old, new, ["k"])
    assert rows(every, "k", "s", "n") == {(1, "a", 1), (2, "b", 2), (3, "c", 3)} and rows(fresh, "k") == {(3,)}
    again = storage.upsert(storage.upsert(old, new, ["k"]), new, ["k"])
    assert rows(again, "k", "s", "n") == rows(storage.upsert(old, new, ["k"]), "k", "s", "n")
    assert storage.upsert(old.limit(0), new.limit(0), ["k"]).count() == 0


def test_soft_delete_zeroes_exactly_the_absent_posting(spark):
    old = spark.createDataFrame([(1, 1, 3, 0.5), (1, 2, 4, 0.7), (2, 2, 1, 1.0)], "webpage_id long, word_id long, frequency long, normalized_tf double")
    batch = spark.createDataFrame([(1, 1)], "webpage_id long, word_id long")
    assert rows(storage.zero_absent(old, batch), *old.columns) == {(1, 1, 3, 0.5), (1, 2, 0, 0.7), (2, 2, 1, 1.0)}
    everywhere = storage.zero_absent(old, batch, old.select("webpage_id"))
    assert rows(everywhere, *old.columns) == {(1, 1, 3, 0.5), (1, 2, 0, 0.7), (2, 2, 0, 1.0)}


def test_deactivation(spark):
    old = spark.createDataFrame([(1, 2, True), (1, 3, True), (2, 3, True)], "parent_id long, child_id long, is_active boolean")
    batch = spark.createDataFrame([(1, 2)], "parent_id long, child_id long")
    assert rows(storage.deactivate_absent(old, batch, ["parent_id", "child_id"], "parent_id"), *old.columns) == {(1, 2, True), (1, 3, False), (2, 3, True)}
    assert rows(storage.deactivate_absent(old, batch, ["parent_id", "child_id"]), *old.columns) == {(1, 2, True), (1, 3, False), (2, 3, False)}


def test_ids_continue_after_the_highest(spark):
    old = spark.createDataFrame([("b", 7)], "word string, word_id long")
    new = spark.createDataFrame([("c",), ("a",), ("b",), ("a",), (None,)], "word string")
    assert rows(storage.assign_ids(old, new, "word", "word_id"), "word", "word_id") == {("b", 7), ("a", 8), ("c", 9)}


def test_bulk_update(spark):
    old = spark.createDataFrame([(1, 0.1), (2, 0.2)], "k long, v double")
    assert rows(storage.set_values(old, spark.createDataFrame([(2, 0.9)], "k long, v double"), "k", "v"), "k", "v") == {(1, 0.1), (2, 0.9)}


def test_crawl_batch(spark):
    when = dt.datetime(2025, 1, 1)
    pages = spark.createDataFrame([(1, "u1", "old", when, 1, 0.5, True, True), (2, "u2", None, None, 0, None, False, False)], "webpage_id long, url string, title string, last_modified_date timestamp_ntz, size long, pagerank double, is_active boolean, is_crawled boolean")
    keyword = spark.createDataFrame([(1, "x"), (2, "y")], "word_id long, word string")
    posts = spark.createDataFrame([(1, "body", 1, 3, 1.0), (1, "body", 2, 1, 0.3)], "webpage_id long, field string, word_id long, frequency long, normalized_tf double")
    edges = spark.createDataFrame([(1, 2, True)], "parent_id long, child_id long, is_active boolean")
    crawled = spark.createDataFrame([("u1", "new", when, 5)], "url string, title string, last_modified_date timestamp_ntz, size long")
    links = spark.createDataFrame([("u1", "u3")], "url string, child_url string")
    terms = spark.createDataFrame([("u1", "body", "x", 4, 1.0), ("u1", "title", "z", 1, 1.0)], "url string, field string, word string, frequency long, normalized_tf double")
    out = storage.apply_crawl(pages, keyword, posts, edges, crawled, links, terms)
    assert rows(out["webpage"], "webpage_id", "url", "title", "pagerank", "is_active", "is_crawled") == {(1, "u1", "new", None, True, True), (2, "u2", None, None, False, False), (3, "u3", None, None, False, False)}
    assert rows(out["keyword"], "word_id", "word") == {(1, "x"), (2, "y"), (3, "z")}
    assert rows(out["postings"], "webpage_id", "field", "word_id", "frequency") == {(1, "body", 1, 4), (1, "body", 2, 0), (1, "title", 3, 1)}
    assert rows(out["relationship"], "parent_id", "child_id", "is_active") == {(1, 2, False), (1, 3, True)}


def test_frontier_stops_at_the_limit(spark):
    links = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5)], "parent_id long, child_id long")
    seed = spark.createDataFrame([(1,)], "page_id long")
    assert rows(crawl.frontier(links, seed, 10), "page_id", "depth") == {(1, 0), (2, 1), (3, 1), (4, 2), (5, 3)}
    assert rows(crawl.frontier(links, seed, 2), "page_id") == {(1,), (2,)}


def test_report(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u1", None, None, None), (2, "u2", "T", dt.datetime(2025, 1, 2), 9)], "webpage_id long, url string, title string, last_modified_date timestamp_ntz, size long")
    posts = spark.createDataFrame([(2, "body", w, w, 1.0) for w in range(1, 13)], "webpage_id long, field string, word_id long, frequency long, normalized_tf double")
    kw = spark.createDataFrame([(w, f"w{w}") for w in range(1, 13)], "word_id long, word string")
    edges = spark.createDataFrame([(2, 1, True)], "parent_id long, child_id long, is_active boolean")
    got = {r.webpage_id: r.block for r in report(pages, posts, kw, edges).collect()}
    assert "No Body Keyword Found" in got[1] and "No Child Found" in got[1] and "u2" in got[1]
    assert got[2].startswith("T\nu2\n2025-01-02 00:00:00, 9") and "w12 12; w11 11" in got[2] and "w2 2" not in got[2].replace("w12 12", "")
    write_report(report(pages, posts, kw, edges), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() > 8


def test_stream_maintenance(spark, tmp_path):
    schema = "webpage_id long, word_id long, indexed_at timestamp, frequency long"
    state = {"t": spark.createDataFrame([(1, 1, None, 9)], schema)}
    t = lambda h: dt.datetime(2025, 1, 1, h)
    for i, batch in enumerate([[(1, 1, t(1), 2), (1, 1, t(3), 5)], [(2, 2, t(2), 1)]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def write(df, number):
        path = str(tmp_path / f"out-{number}")
        df.write.mode("overwrite").parquet(path)
        state["t"] = spark.read.parquet(path)

    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    maintain(stream, lambda: state["t"], write, ["webpage_id", "word_id"], str(tmp_path / "ck")).awaitTermination()
    assert rows(state["t"], "webpage_id", "word_id", "frequency") == {(1, 1, 5), (2, 2, 1)}


def test_stream_counts(spark, tmp_path):
    from spindrift.streaming.incremental import interaction_counts, read_stream

    t = lambda h, m: dt.datetime(2025, 1, 1, h, m)
    src = str(tmp_path / "events")
    spark.createDataFrame([(t(1, 5), "click"), (t(1, 50), "click"), (t(2, 10), "view"), (t(9, 0), "click")], "ts timestamp, event_type string").write.parquet(src)
    counts = interaction_counts(read_stream(spark, src, "ts timestamp, event_type string"))
    q = counts.writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.start.hour, r.event_type, r.n) for r in spark.table("counted").collect()} == {(1, "click", 2), (2, "view", 1), (9, "click", 1)}


def test_written_tables_can_be_dropped(spark):
    from spindrift.session import broadcast_if_small, drop_materialized, materialize, shared_dir

    df = materialize(spark.range(5).toDF("x"), "t")
    assert df.count() == 5 and shared_dir(spark)
    assert broadcast_if_small(df, 5)[1] and not broadcast_if_small(df, 4)[1]
    assert drop_materialized() >= 1 and drop_materialized() == 0


def test_crawl_follows_a_long_chain(spark):
    from spindrift.operators import crawl

    links = spark.createDataFrame([(i, i + 1) for i in range(55)], "parent_id long, child_id long").coalesce(1)
    seed = spark.createDataFrame([(0,)], "page_id long")
    assert {(r.page_id, r.depth) for r in crawl.frontier(links, seed, 1000).collect()} == {(i, i) for i in range(56)}
    assert crawl.frontier(links, seed, 1000, max_depth=2).count() == 3


def test_scratch_tables_last_as_long_as_their_block(spark):
    import os

    from spindrift.session import drop_materialized, materialize, scratch, shared_dir

    drop_materialized()
    outer = materialize(spark.range(3).toDF("x"), "outer")
    with scratch():
        inner = materialize(spark.range(4).toDF("x"), "inner")
        assert inner.count() == 4
    assert outer.count() == 3 and not [f for f in os.listdir(shared_dir(spark)) if "-inner-" in f]
    assert drop_materialized() == 1


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    import pytest

    from spindrift import session

    class Spark:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        session.shared_dir(Spark)


def test_built_once_is_built_again_only_for_other_data(spark, tmp_path):
    from spindrift.session import built_once

    made = []

    def build(path: str) -> None:
        made.append(path)
        spark.range(2).write.parquet(f"{path}/t")

    src = tmp_path / "src"
    src.mkdir()
    (src / "a").write_text("1")
    first = built_once(spark, str(src), "try", build)
    assert built_once(spark, str(src), "try", build) == first and len(made) == 1
    (src / "a").write_text("12")
    assert built_once(spark, str(src), "try", build) != first and len(made) == 2
