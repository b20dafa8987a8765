"""The queries p1 to p9 (but p5, which is in the core) over the search index and its documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift import skew
from spindrift.llm import distinct, encode, frequency, leximin, packing, pairs, residue, terms, topn
from spindrift.session import broadcast_if_small, materialize
from spindrift.tables import act_pages, act_postings_by_page, live_postings, table


def _act(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """(webpage_id) of the act pages, written, and their number."""
    act = materialize(act_pages(table(spark, d, "webpage")), "act")
    return act, act.count()


def _act_terms(spark: SparkSession, d: str, field: str, act: DataFrame, variants: DataFrame) -> DataFrame:
    """(record, term, frequency) over act pages, written: one row per page and term, a term's spellings added up.

    The words are replaced by their terms before the one shuffle of the raw rows, so a page's spellings meet in it.
    """
    raw = table(spark, d, f"{field}_index")

    def named(rows: DataFrame) -> DataFrame:
        known = skew.lookup_join(rows, variants, "word_id", "left", hot_in=raw, spread=["webpage_id"])
        return known.withColumn("term", F.coalesce("term_id", "word_id")).drop("term_id")

    lying = act_postings_by_page(spark, d, (field,), act=act, rename=named, part_by="term")
    sums = lying.rows.groupBy(*lying.keys, "term").agg(F.sum("frequency").alias("frequency"))
    return materialize(sums.select(F.col("webpage_id").alias("record"), "term", "frequency"), f"terms-{field}")


def _variants(spark: SparkSession, d: str) -> DataFrame:
    return materialize(terms.variants(table(spark, d, "keyword")), "variants")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """For each probe page the one term of its body with the highest score against all act pages (ties: the smaller id)."""
    act, n = _act(spark, d)
    rows = _act_terms(spark, d, "body", act, _variants(spark, d))
    probes = table(spark, d, "probe_page").select(F.col("webpage_id").alias("record")).filter("record is not null").distinct()
    side, small = broadcast_if_small(probes)
    asked = rows.join(side, "record", "left_semi") if small else skew.salted_join(rows, probes, "record", "left_semi", skew.hot_keys(rows, "record"), ["term"])
    scored = distinct.distinctiveness(materialize(asked, "asked"), distinct.document_frequency(rows), n)
    best = topn.top_n(scored.select("record", "term", "score"), ["record"], [("score", "desc"), ("term", "asc")], 1)
    return best.select(F.col("record").alias("webpage_id"), F.col("term").alias("word_id"))


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every term of every act page, body and title apart, with its score."""
    act, n = _act(spark, d)
    variants = _variants(spark, d)
    out = []
    for field in ("body", "title"):
        rows = _act_terms(spark, d, field, act, variants)
        scored = distinct.distinctiveness(rows, distinct.document_frequency(rows), n)
        out.append(scored.select(F.lit(field).alias("field"), F.col("record").alias("webpage_id"), F.col("term").alias("word_id"), "frequency", "df", F.round("score", 9).alias("score")))
    return out[0].unionByName(out[1])


def _asked_items(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, webpage_id, pagerank, body_tf, title_tf) of the act pages that have the query's word live."""
    asked = table(spark, d, "probe_query").filter("query_id is not null and word_id is not null").select("query_id", "word_id").distinct()
    words, small = broadcast_if_small(asked.select("word_id").distinct())

    def field(name: str) -> DataFrame:
        raw = table(spark, d, f"{name}_index")
        rows = raw.join(words, "word_id", "left_semi") if small else skew.salted_join(raw, words, "word_id", "left_semi", skew.hot_keys(raw, "word_id"), ["webpage_id"])
        live = live_postings(rows, with_tf=True)
        null = F.lit(None).cast("double")
        return live.select("webpage_id", "word_id", (F.col("normalized_tf") if name == "body" else null).alias("body_tf"), (F.col("normalized_tf") if name == "title" else null).alias("title_tf"))

    both = field("body").unionByName(field("title")).groupBy("webpage_id", "word_id").agg(F.max("body_tf").alias("body_tf"), F.max("title_tf").alias("title_tf"))
    both = materialize(both, "asked")
    pages = act_pages(table(spark, d, "webpage"), "pagerank")
    on_act = skew.salted_join(both, pages, "webpage_id", hot=skew.hot_keys(both, "webpage_id"), spread=["word_id"])
    queries, few = broadcast_if_small(asked)
    joined = on_act.join(queries, "word_id") if few else skew.salted_join(on_act, asked, "word_id", hot=skew.hot_keys(both, "word_id"), spread=["webpage_id"])
    return joined.select("query_id", "webpage_id", "pagerank", "body_tf", "title_tf")


_SCORES = ("pagerank", "body_tf", "title_tf")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """For each probe query its first three pages."""
    ranked = leximin.leximin(_asked_items(spark, d), "query_id", "webpage_id", _SCORES)
    return topn.top_n(ranked, ["query_id"], leximin.order(3, "webpage_id"), 3).select("query_id", "webpage_id")


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The whole ranking's percentiles for each probe query."""
    r = leximin.leximin(_asked_items(spark, d), "query_id", "webpage_id", _SCORES)
    return r.select("query_id", "webpage_id", *[F.round(c, 9).alias(c) for c in r.columns[2:]])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """For each act page its five live body postings of highest frequency (ties: the smaller word_id).

    The rows lie by page when the heaps are formed, so a page's heap leaves its task with five rows.
    """
    lying = act_postings_by_page(spark, d, ("body",))
    best = topn.top_n(lying.rows.select("webpage_id", "word_id", "frequency"), ["webpage_id"], [("frequency", "desc"), ("word_id", "asc")], 5)
    return best.select("webpage_id", "word_id")


def _n_act(spark: SparkSession, d: str) -> int:
    return act_pages(table(spark, d, "webpage")).count()


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    """(basket, item, size): the distinct words live in body or title of each act page; ``size`` orders the pages by their words (of a page in several tasks, one task's share)."""
    lying = act_postings_by_page(spark, d)
    words = lying.rows.groupBy(*lying.keys, "word_id").agg(F.count(F.lit(1)).alias("fields"))
    sized = words.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(*lying.keys)))
    return sized.select(F.col("webpage_id").alias("basket"), F.col("word_id").alias("item"), "size")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of words live on at least 7 act pages that share a page, with counts, null expectation and significance at a false-discovery rate of 5 %."""
    found = pairs.significant(_baskets(spark, d), _n_act(spark, d), share=(0, 1), max_share=(1, 1), min_shared=1)
    return found.select("word1_id", "word2_id", "n1", "n2", "n12", F.round("expected", 6).alias("expected"), F.round("log10_p", 6).alias("log10_p"), "significant")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The operator's pairs, of which an exact check keeps those of the stated counts: the fitted null judges words of large pages otherwise than n1 * n2 / N does."""
    n = _n_act(spark, d)
    found = pairs.co_occurrence(_baskets(spark, d), n, min_count=7, share=(3, 4), max_share=(1, 5))
    return found.filter(F.col("n12") * n >= F.col("n1") * F.col("n2") * 5).select("word1_id", "word2_id")


def _term_frequencies(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Occurrences and act pages of every term, and the number of act pages."""
    act, n = _act(spark, d)
    spelled = materialize(terms.spellings(table(spark, d, "keyword")), "spellings")
    rows = _act_terms(spark, d, "body", act, spelled.filter("word_id <> term_id"))
    return frequency.frequencies(rows, spelled.select(F.col("term_id").alias("term"))), n


def p6_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and act pages of every term, with its mark (null: useful)."""
    m = frequency.marks(*_term_frequencies(spark, d))
    return m.select(F.col("term").alias("word_id"), "occurrences", "records", "mark")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_frequencies(spark, d).filter("mark is not null").select("word_id", "mark")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents").select("doc_id", "text"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """For each document whether its ids decode to its own text."""
    texts = table(spark, d, "documents").select("doc_id", "text", F.coalesce("text", F.lit("")).alias("given"))
    back = encode.decode(encode.encode(texts), out="back")
    return back.select("doc_id", (F.col("back") == F.col("given")).alias("same"))


def p7_offsets(spark: SparkSession, d: str) -> DataFrame:
    """For each document that isn't empty where its tokens begin and end, in code points, and whether they are numbered without a gap."""
    o = encode.offsets(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    rows = o.groupBy("doc_id").agg(F.max("end").cast("long").alias("reach"), F.min("start").cast("long").alias("first"), (F.count(F.lit(1)) == F.max("position") + 1).alias("numbered"))
    return rows.select("doc_id", "reach", "first", "numbered")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = encode.token_counts(table(spark, d, "documents").select("doc_id", "text"))
    return packing.pack(sizes, "doc_id", "n_tokens")


def p8_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Every part of every non-empty document with its container."""
    return _packed(spark, d).select(F.col("item").alias("doc_id"), "part", "start", F.col("size").alias("n_tokens"), "container")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """One row: whether every token is placed once, no container holds more than its capacity, and all but one of them are full to 0.98 on average."""
    sizes = encode.token_counts(table(spark, d, "documents").select("doc_id", "text"))
    placed = materialize(packing.pack(sizes, "doc_id", "n_tokens"), "placed")
    each = placed.groupBy("container").agg(F.sum("size").alias("held"))
    held = each.agg(F.sum("held").alias("held"), F.max("held").alias("most"), F.count(F.lit(1)).alias("containers"))
    whole = sizes.agg(F.sum("n_tokens").alias("tokens"))
    return held.crossJoin(F.broadcast(whole)).select((F.col("held") == F.col("tokens")).alias("whole"), (F.col("most") <= packing.CAPACITY).alias("fits"), ((F.col("containers") - 1) * 0.98 * packing.CAPACITY <= F.col("tokens")).alias("tight"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packing cuts; part 1 exists for just those."""
    return _packed(spark, d).filter("part = 1").select(F.col("item").alias("doc_id"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.flagged(table(spark, d, "documents").select("doc_id", "source", "text"))


def p9_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every suspicious document with its kind, how widely its rest recurs, and the verdict."""
    return residue.judge(table(spark, d, "documents").select("doc_id", "source", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_scores, p2_found, p2_percentiles, p3_found, p4_found, p4_pairs, p6_found, p6_frequencies, p7_ids, p7_roundtrip, p7_offsets, p8_found, p8_assignment, p8_fill, p9_found, p9_verdicts)}
