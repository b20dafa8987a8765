"""The queries of the search engine's own operators over the index tables, documents and events."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift import skew
from spindrift.config import DEFAULT
from spindrift.functions import porter, url as fu
from spindrift.functions import text as tx
from spindrift.functions.vector import combine
from spindrift.operators import boolean, cooccur, crawl, expand, history, index, joined, pagerank, pmi, report, storage
from spindrift.plans.engine import Engine, History
from spindrift.plans.offline import corpus_statistics
from spindrift.plans.spec import JoinedQuery, Query
from spindrift.session import built_once, materialize
from spindrift.sources import html as src
from spindrift.tables import act_pages, act_postings_by_page, live_postings, standing_pages, standing_postings, table

Spark = SparkSession
QUERIES: dict[str, Callable[[Spark, str], DataFrame]] = {}

#: Words that the fixed example queries use.
ANY = ("crawler", "museum")
ALL = ("search", "crawler")
NOT = ("search",)
TEXT = "the crawler and a museum, crawler curator"
SINCE, UNTIL = "2025-01-01", "2025-03-31"


def query(f: Callable[[Spark, str], DataFrame]) -> Callable[[Spark, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _ids(spark: Spark, d: str, words) -> dict[str, int]:
    k = table(spark, d, "keyword").filter(F.col("word").isin(list(words))).groupBy("word").agg(F.min("word_id").alias("i"))
    return {r.word: r.i for r in k.collect()}


def _n(spark: Spark, d: str) -> int:
    return act_pages(table(spark, d, "webpage")).count()


def _docs(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


# -------------------------------------------------------------------- text


@query
def q_tokenize(spark: Spark, d: str) -> DataFrame:
    t = _docs(spark, d).select("doc_id", tx.without_stopwords(tx.tokens(F.col("text"))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), F.array_join("t", " ").alias("tokens"))


def _posted(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, "field", "term", "frequency", F.round("normalized_tf", 9).alias("normalized_tf"))


@query
def q_postings_body(spark: Spark, d: str) -> DataFrame:
    """Stemmed words and phrases of the documents."""
    return _posted(index.text_postings(_docs(spark, d), "doc_id", "text", "body", with_phrases=True, stemmed=True), "doc_id")


@query
def q_postings_title(spark: Spark, d: str) -> DataFrame:
    """Stemmed words and phrases of the standing pages' titles."""
    titles = standing_pages(table(spark, d, "webpage")).select("webpage_id", "title")
    return _posted(index.text_postings(titles, "webpage_id", "title", "title", with_phrases=True, stemmed=True), "webpage_id")


@query
def q_normalized_tf(spark: Spark, d: str) -> DataFrame:
    """normalized_tf of the live postings of act pages computed anew from their frequencies (stored values of old rows are stale)."""
    p = index.act_postings(spark, d)
    top = p.groupBy("webpage_id", "field").agg(F.max("frequency").alias("top"))
    return p.join(top, ["webpage_id", "field"]).select("webpage_id", "field", "word_id", F.round(F.col("frequency") / F.col("top"), 9).alias("normalized_tf"))


@query
def q_keyword_dict(spark: Spark, d: str) -> DataFrame:
    """Ids of the stemmed words and phrases of the documents."""
    return index.word_dictionary(index.text_postings(_docs(spark, d), "doc_id", "text", "body", with_phrases=True, stemmed=True))


@query
def q_keyword_totals(spark: Spark, d: str) -> DataFrame:
    t, b = (live_postings(table(spark, d, f"{f}_index")) for f in ("title", "body"))
    return index.keyword_totals(t, b, table(spark, d, "keyword"))


@query
def q_phrases_rake(spark: Spark, d: str) -> DataFrame:
    p = _docs(spark, d).select("doc_id", F.explode(tx.phrases(tx.tokens(F.col("text")))).alias("phrase"))
    return p.groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("n"))


@query
def q_quoted_phrases(spark: Spark, d: str) -> DataFrame:
    q = _docs(spark, d).select("doc_id", F.posexplode(tx.quoted(F.col("text"))).alias("i", "phrase"))
    return q.select("doc_id", F.col("i").cast("long").alias("i"), "phrase")


@query
def q_porter_stem(spark: Spark, d: str) -> DataFrame:
    """Stem of every word of the dictionary."""
    return porter.stem_terms(table(spark, d, "keyword").select("word_id", "word"), "word").select("word_id", "word", "stem")


@query
def q_substring_probability(spark: Spark, d: str) -> DataFrame:
    k = table(spark, d, "keyword").select("word_id", "word")
    return k.select("word_id", F.round(tx.substring_probability(F.lit("er"), F.col("word")), 9).alias("p"), tx.occurrences(F.col("word"), F.lit("er")).alias("n"), F.array_join(F.transform(tx.positions(F.col("word"), F.lit("er")), lambda x: x.cast("string")), ",").alias("at"))


# -------------------------------------------------------------------- sources


def _html_pages(spark: Spark, d: str) -> DataFrame:
    """The act pages rendered as HTML: title, a heading, and a link to each live child."""
    pages = standing_pages(table(spark, d, "webpage")).filter("is_active and is_crawled").select("webpage_id", "url", "title")
    e = table(spark, d, "relationship").filter("is_active").select("parent_id", "child_id").distinct()
    child = standing_pages(table(spark, d, "webpage")).select(F.col("webpage_id").alias("child_id"), F.col("url").alias("child_url"))
    forms = F.array(*[F.lit(f) for f in ('<li><a class="l" href="%s">to</a></li>', "<li><A HREF='%s' title=x>to</A></li>", "<li><a target=_blank\nhref=%s >to</a></li>")])
    link = F.replace(F.get(forms, F.pmod("child_id", F.lit(3)).cast("int")), F.lit("%s"), "child_url")
    links = e.join(child, "child_id").groupBy("parent_id").agg(F.array_join(F.array_sort(F.collect_list(link)), "").alias("links"))
    body = F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title><style>p{}</style></head><body><h1>On "), F.col("webpage_id").cast("string"), F.lit("</h1><ul>"), F.coalesce("links", F.lit("")), F.lit("</ul></body></html>"))
    return pages.join(links, pages.webpage_id == links.parent_id, "left").select("webpage_id", "url", body.alias("html"))


@query
def q_page_title(spark: Spark, d: str) -> DataFrame:
    return _html_pages(spark, d).select("webpage_id", src.title_of(F.col("html")).alias("title"))


@query
def q_extract_links(spark: Spark, d: str) -> DataFrame:
    return src.links(_html_pages(spark, d))


@query
def q_html_text(spark: Spark, d: str) -> DataFrame:
    p = src.parse_pages(_html_pages(spark, d), "webpage_id")
    return p.select("webpage_id", "title", F.length("text").cast("long").alias("n_chars"), F.size("links").cast("long").alias("n_links"))


@query
def q_url_valid(spark: Spark, d: str) -> DataFrame:
    """Validity and parts of every stored URL, and of each without its scheme."""
    u = table(spark, d, "webpage").select("webpage_id", "url").distinct()
    cut = F.regexp_replace("url", "^https?:", "")
    return u.select("webpage_id", fu.is_valid(F.col("url")).alias("valid"), fu.host(F.col("url")).alias("host"), fu.is_valid(cut).alias("cut_valid"))


@query
def q_normalize_url(spark: Spark, d: str) -> DataFrame:
    """Relative forms resolved against every act page's URL."""
    pages = standing_pages(table(spark, d, "webpage")).filter("is_active and is_crawled").select("webpage_id", "url")
    forms = F.array(*[F.lit(x) for x in ("next.htm", "../up.htm", "/root/x.htm?q=1#f", "//other.example/p", "mailto:a@b", "http://abs.example/y?z#w", "./a/../b/", "")])
    r = pages.select("webpage_id", "url", F.posexplode(forms).alias("form", "href"))
    return r.select("webpage_id", F.col("form").cast("long").alias("form"), fu.normalize(F.col("href"), F.col("url")).alias("resolved"))


@query
def q_crawl_frontier(spark: Spark, d: str) -> DataFrame:
    """Breadth-first levels over active links from the lowest act page, half of all pages at most."""
    act = act_pages(table(spark, d, "webpage"))
    seed = act.agg(F.min("webpage_id").alias("page_id"))
    links = table(spark, d, "relationship").filter("is_active").select("parent_id", "child_id").distinct()
    return crawl.frontier(links, seed, max(1, act.count() // 2)).select("page_id", F.col("depth").cast("long").alias("depth"))


@query
def q_neighbors_topk(spark: Spark, d: str) -> DataFrame:
    pages = standing_pages(table(spark, d, "webpage")).filter("is_active and is_crawled")
    return report.neighbours(table(spark, d, "relationship"), pages, DEFAULT.max_relations).select("webpage_id", "kind", F.col("rank").cast("long").alias("rank"), "neighbour_id", "url")


# -------------------------------------------------------------------- index


@query
def q_standing_pages(spark: Spark, d: str) -> DataFrame:
    return standing_pages(table(spark, d, "webpage")).select("webpage_id", "url", "last_modified_date", "size", F.round("pagerank", 6).alias("pagerank"), "is_active", "is_crawled")


@query
def q_live_postings(spark: Spark, d: str) -> DataFrame:
    return index.act_postings(spark, d).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("webpage_id").alias("pages"), F.countDistinct("word_id").alias("words"), F.sum("frequency").alias("total"))


@query
def q_corpus_statistics(spark: Spark, d: str) -> DataFrame:
    pages = act_pages(table(spark, d, "webpage"), "pagerank")
    r = corpus_statistics(pages, index.act_postings(spark, d))
    return r.select("pages", *[F.round(c, 4).alias(c) for c in ("avg_rank", "min_rank", "max_rank")], "title_postings", "title_total", "body_postings", "body_total")


def _idf(spark: Spark, d: str) -> DataFrame:
    return index.idf(index.act_postings(spark, d), _n(spark, d))


@query
def q_df(spark: Spark, d: str) -> DataFrame:
    return _idf(spark, d).select("field", "word_id", "df")


@query
def q_idf_title(spark: Spark, d: str) -> DataFrame:
    return _idf(spark, d).filter("field = 'title'").select("word_id", F.round("idf", 9).alias("idf"))


@query
def q_idf_body(spark: Spark, d: str) -> DataFrame:
    return _idf(spark, d).filter("field = 'body'").select("word_id", F.round("idf", 9).alias("idf"))


@query
def q_idf_combined(spark: Spark, d: str) -> DataFrame:
    return index.combined_idf(_idf(spark, d)).select("word_id", F.round("idf", 9).alias("idf"))


def _version() -> str:
    """A digest of the library's sources: tables built by another version aren't taken for this one's."""
    root = Path(__file__).parent.parent
    own = sorted(f for part in ("", "functions", "operators", "plans", "sources") for f in (root / part).glob("*.py"))
    return hashlib.blake2b(b"".join(f.read_bytes() for f in own), digest_size=6).hexdigest()


BUILT = _version()


def _index(spark: Spark, d: str) -> index.SearchIndex:
    """The search index of a data folder: built once, then read; a query reads the row groups of its words."""
    return index.SearchIndex.read(spark, built_once(spark, d, f"index-{BUILT}", lambda path: index.SearchIndex.of(spark, d).write(path)))


def _built(spark: Spark, d: str, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from the data of a folder, made once."""
    return spark.read.parquet(built_once(spark, d, f"{label}-{BUILT}", lambda path: make().write.parquet(f"{path}/t")) + "/t")


def _vectors(spark: Spark, d: str) -> DataFrame:
    ix = _index(spark, d)
    return index.document_vectors(ix.postings, index.idf(ix.postings, ix.n_pages))


@query
def q_doc_tfidf(spark: Spark, d: str) -> DataFrame:
    return _vectors(spark, d).select("webpage_id", "word_id", F.round("weight", 9).alias("weight"))


@query
def q_doc_norm(spark: Spark, d: str) -> DataFrame:
    return index.norms(_vectors(spark, d), "webpage_id").select("webpage_id", F.round("norm", 6).alias("norm"))


@query
def q_top_tf_words(spark: Spark, d: str) -> DataFrame:
    t = index.top_words(index.combined_tf(index.act_postings(spark, d)))
    return t.select("webpage_id", "word_id", "weight", F.col("rank").cast("long").alias("rank"))


@query
def q_top_tfidf_words(spark: Spark, d: str) -> DataFrame:
    return index.top_words(_vectors(spark, d)).select("webpage_id", "word_id", "weight", F.col("rank").cast("long").alias("rank"))


# -------------------------------------------------------------------- boolean retrieval


def _boolean(view: str, kind: str) -> Callable[[Spark, str], DataFrame]:
    words = {"any": ANY, "all": ALL, "not": NOT}[kind]

    def run(spark: Spark, d: str) -> DataFrame:
        ids = set(_ids(spark, d, words).values())
        sets = boolean.WordSets(**{f"{view}_{kind}": ids})
        return boolean.candidates(act_pages(table(spark, d, "webpage")), index.act_postings(spark, d), sets)

    run.__doc__ = f"Act pages with {kind} of {words} in {view}."
    return run


for _v in ("title", "body", "page"):
    for _k in ("any", "all", "not"):
        QUERIES[f"q_bool_{_v}_{_k}"] = _boolean(_v, _k)


@query
def q_bool_not_literal(spark: Spark, d: str) -> DataFrame:
    sets = boolean.WordSets(title_not=set(_ids(spark, d, ALL).values()))
    return boolean.candidates(act_pages(table(spark, d, "webpage")), index.act_postings(spark, d), sets, literal_not=True)


@query
def q_bool_page_view_literal(spark: Spark, d: str) -> DataFrame:
    """Pages with any of the words in the literal merged view, which lets soft-deleted postings through."""
    ids = sorted(_ids(spark, d, ANY).values())
    t, b = (standing_postings(table(spark, d, f"{f}_index")).filter(F.col("word_id").isin(ids)) for f in ("title", "body"))
    return boolean.literal_page_view(t, b).select("webpage_id").distinct().join(act_pages(table(spark, d, "webpage")), "webpage_id", "left_semi")


@query
def q_bool_combined(spark: Spark, d: str) -> DataFrame:
    i = _ids(spark, d, (*ANY, *ALL, "curator"))
    sets = boolean.WordSets(page_any={i["crawler"], i["museum"], i["search"]}, body_all={i["search"]}, title_not={i["crawler"]}, page_not={i["curator"]})
    pages = standing_pages(table(spark, d, "webpage")).filter("is_active and is_crawled")
    return boolean.candidates(pages, index.act_postings(spark, d), sets, boolean.date_range("last_modified_date", SINCE, UNTIL))


@query
def q_date_range(spark: Spark, d: str) -> DataFrame:
    pages = standing_pages(table(spark, d, "webpage")).filter("is_active and is_crawled")
    return pages.filter(boolean.date_range("last_modified_date", SINCE, UNTIL)).select("webpage_id", "last_modified_date")


# -------------------------------------------------------------------- ranking


def _engine(spark: Spark, d: str, with_pmi: bool = False) -> Engine:
    ix = _index(spark, d)
    return Engine(ix, _built(spark, d, "pmi", lambda: pmi.build(ix.postings, "literal")) if with_pmi else None)


def _pmi_per_term(spark: Spark, d: str) -> DataFrame:
    """Made anew where it is read: written, it would be larger than all the data."""
    return pmi.pair_values_top(_index(spark, d).postings, "body")


def _history(e: Engine, spark: Spark, d: str) -> History:
    """From the event table: user u's past query is the top words of the act page u mod n; click and purchase like, error dislikes page event_id mod n."""
    numbered = _built(spark, d, "numbered", lambda: skew.range_rank(e.ix.pages.select("webpage_id"), [], ["webpage_id"], label="numbered").select("webpage_id", (F.col("position") - 1).alias("k")))
    n = F.lit(e.ix.n_pages)
    seen = history.by_user(table(spark, d, "events"))
    pages = seen.withColumn("k", F.pmod("event_id", n)).join(numbered, "k").select("query_id", "webpage_id", "relevance")
    users = seen.select("query_id").distinct().withColumn("k", F.pmod("query_id", n)).join(numbered, "k")
    past = users.join(e.ix.tops, "webpage_id").select("query_id", "word_id", "weight")
    return History(past, pages, users.select("query_id", F.concat(F.lit("pages like "), F.col("webpage_id").cast("string")).alias("text")))


@query
def q_query_vector(spark: Spark, d: str) -> DataFrame:
    e = _engine(spark, d)
    tf, _ = e.query_tf(Query(TEXT, page_not=("gallery",)))
    return e.with_words(e.query_vector(tf)).select("word", "word_id", F.round("weight", 9).alias("weight"))


@query
def q_cosine(spark: Spark, d: str) -> DataFrame:
    return _engine(spark, d).search(Query(TEXT)).hits.select("webpage_id", F.round("original_score", 6).alias("original_score"))


@query
def q_search_ranked(spark: Spark, d: str) -> DataFrame:
    """The first fifty hits of the example text (a top-k report)."""
    e = _engine(spark, d)
    return e.top(e.search(Query(TEXT)).hits, 50).select(F.col("position").cast("long").alias("position"), "webpage_id", F.round("modified_score", 6).alias("modified_score"))


@query
def q_search_quoted(spark: Spark, d: str) -> DataFrame:
    """A quoted word must be on the page."""
    return _engine(spark, d).search(Query('search "crawler"')).hits.select("webpage_id", F.round("original_score", 6).alias("original_score"))


@query
def q_search_similar_pages(spark: Spark, d: str) -> DataFrame:
    """Pages like the first probe page: any of its five top words by tf."""
    e = _engine(spark, d)
    page = table(spark, d, "probe_page").filter("probe_id = 1").select("webpage_id")
    top = index.top_words(index.combined_tf(e.ix.postings.join(F.broadcast(page), "webpage_id", "left_semi")))
    words = [r.word for r in top.join(e.ix.keyword, "word_id").select("word").collect()]  # five at most
    return e.search(Query(page_any=tuple(words))).hits.select("webpage_id", F.round("original_score", 6).alias("original_score"))


@query
def q_search_modified_score(spark: Spark, d: str) -> DataFrame:
    """Scores of a query moved by feedback and co-occurring words, blended with PageRank."""
    e = _engine(spark, d, with_pmi=True)
    return e.search(Query("crawler museum"), _history(e, spark, d)).hits.select("webpage_id", F.round("original_score", 6).alias("original_score"), F.round("modified_score", 6).alias("modified_score"))


@query
def q_search_hits(spark: Spark, d: str) -> DataFrame:
    """The first ten hits with page attributes, top words and neighbours (a top-k report)."""
    e = _engine(spark, d)
    h = e.assemble(e.top(e.search(Query(TEXT)).hits, 10))
    words = lambda c: F.array_join(F.transform(F.col(c), lambda s: s["word"]), "|")
    return h.select(F.col("position").cast("long").alias("position"), "webpage_id", "url", words("top_tfs").alias("top_tfs"), words("top_tfidfs").alias("top_tfidfs"), F.array_join("parents", "|").alias("parents"), F.array_join("children", "|").alias("children"))


# -------------------------------------------------------------------- joined search


def _two(spark: Spark, d: str, kind: str, strict: bool = False) -> DataFrame:
    j = JoinedQuery((Query("crawler museum"), Query("museum curator")), kind)
    h = _engine(spark, d).joined_search(j, strict=strict).hits
    return h.select("webpage_id", F.round("original_score", 6).alias("original_score"), F.round("modified_score", 6).alias("modified_score"))


@query
def q_joined_merged(spark: Spark, d: str) -> DataFrame:
    return _two(spark, d, "merged")


@query
def q_joined_subquery(spark: Spark, d: str) -> DataFrame:
    return _two(spark, d, "subquery")


@query
def q_joined_subquery_strict(spark: Spark, d: str) -> DataFrame:
    return _two(spark, d, "subquery", strict=True)


@query
def q_joined_vectors(spark: Spark, d: str) -> DataFrame:
    e = _engine(spark, d)
    r = e.joined_search(JoinedQuery((Query("crawler museum"), Query("museum curator"))))
    return e.with_words(r.original_vector).select("word", "word_id", F.round("weight", 9).alias("weight"))


# -------------------------------------------------------------------- PMI


def _posts(spark: Spark, d: str) -> DataFrame:
    return _index(spark, d).postings


def _body_strong(spark: Spark, d: str) -> cooccur.Strong:
    """From the body's rows alone: the whole index takes longer to build than the pairs of its words do to make."""
    return pmi.page_strong(act_postings_by_page(spark, d, ["body"]), "body")


def _six(pmi: DataFrame) -> DataFrame:
    """Values of nine digits with six: on whole numbers, as rounding a decimal takes longer than all else that a pair needs."""
    return pmi.withColumn("pmi", F.expr("((CAST(rint(pmi * 1e9) AS BIGINT) + 500) DIV 1000) / 1e6"))


@query
def q_pmi_title(spark: Spark, d: str) -> DataFrame:
    return _six(pmi.page_values(_posts(spark, d), "title"))


@query
def q_pmi_body(spark: Spark, d: str) -> DataFrame:
    return _six(pmi.page_values(_body_strong(spark, d), "body"))


@query
def q_pmi_combined(spark: Spark, d: str) -> DataFrame:
    return _six(pmi.combined_pair_values(_posts(spark, d)))


@query
def q_pmi_top_literal(spark: Spark, d: str) -> DataFrame:
    return _six(pmi.page_values_top(_posts(spark, d), "body"))


@query
def q_pmi_top_per_term(spark: Spark, d: str) -> DataFrame:
    return _six(pmi.pair_values_top(_posts(spark, d), "body"))


@query
def q_pmi_expand(spark: Spark, d: str) -> DataFrame:
    """Words that expand the query 'crawler museum' by the per-term table of the body."""
    e = _engine(spark, d)
    e.pmi = _pmi_per_term(spark, d)
    tf, _ = e.query_tf(Query("crawler museum"))
    return e.co_occurring(tf).select("word_id", F.round("weight", 6).alias("weight"))


@query
def q_pmi_delete_affected(spark: Spark, d: str) -> DataFrame:
    """Pairs left, and words affected, when the postings of two words change."""
    s = _body_strong(spark, d)
    words = table(spark, d, "keyword").filter(F.col("word").isin(*ANY)).select("word_id")
    rest, affected = pmi.delete_words(lambda w: pmi.page_values(s, "body", without=w), words, pmi.page_values(s, "body", touching=words))
    return rest.select(F.lit("rest").alias("kind"), F.col("word1_id").alias("a"), F.col("word2_id").alias("b")).unionByName(affected.select(F.lit("affected").alias("kind"), F.col("word_id").alias("a"), F.lit(0).cast("long").alias("b")))


# -------------------------------------------------------------------- PageRank


def _graph(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    act = materialize(act_pages(table(spark, d, "webpage"), "pagerank"), "act")
    return act, materialize(pagerank.live_edges(table(spark, d, "relationship"), act), "edges")


def _shown(c: str):
    """Six digits; the small addend keeps sums that are exact decimals off the rounding border, where engines differ."""
    return F.round(F.col(c) + 1e-9, 6).alias(c)


@query
def q_outdegree(spark: Spark, d: str) -> DataFrame:
    return pagerank.out_degree(_graph(spark, d)[1])


@query
def q_pagerank_standard(spark: Spark, d: str) -> DataFrame:
    act, edges = _graph(spark, d)
    return pagerank.pagerank(edges, act).select("webpage_id", _shown("pagerank"))


@query
def q_pagerank_literal(spark: Spark, d: str) -> DataFrame:
    """Accumulating rounds, as many as the bounded form has."""
    act, edges = _graph(spark, d)
    return pagerank.pagerank(edges, act, "literal").select("webpage_id", F.round(F.col("pagerank") + 1e-7, 3).alias("pagerank"))


@query
def q_pagerank_subset(spark: Spark, d: str) -> DataFrame:
    """All rounds for the pages of the title word 'search' alone; all others keep their stored value."""
    act, edges = _graph(spark, d)
    word = F.lit(_ids(spark, d, NOT)["search"])
    only = live_postings(table(spark, d, "title_index")).filter(F.col("word_id") == word).select("webpage_id").distinct()
    stored = act.select("webpage_id", (F.col("pagerank") / 1000).alias("pagerank"))
    return pagerank.pagerank(edges, act, only=only, stored=stored).select("webpage_id", _shown("pagerank"))


@query
def q_pagerank_minmax(spark: Spark, d: str) -> DataFrame:
    return pagerank.min_max_scaled(act_pages(table(spark, d, "webpage"), "pagerank")).select("webpage_id", F.round("scaled", 9).alias("scaled"))


# -------------------------------------------------------------------- expansion and suggestion


@query
def q_fuzzy_terms(spark: Spark, d: str) -> DataFrame:
    return expand.fuzzy_words(table(spark, d, "keyword"), {"craw": 1.0, "use": 0.5}).select("word_id", "word", F.round("weight", 9).alias("weight"))


@query
def q_fuzzy_top(spark: Spark, d: str) -> DataFrame:
    return expand.top_fuzzy(table(spark, d, "keyword"), {"craw": 1.0, "use": 0.5}).select("word_id", "word", F.round("weight", 9).alias("weight"))


def _query_and_history(spark: Spark, d: str, words: str = "crawler museum"):
    e = _engine(spark, d)
    tf, _ = e.query_tf(Query(words))
    return e, e.query_vector(tf), _history(e, spark, d)


@query
def q_similar_queries(spark: Spark, d: str) -> DataFrame:
    e, q, h = _query_and_history(spark, d)
    return expand.similar_queries(h.past, q)


@query
def q_relevance_feedback(spark: Spark, d: str) -> DataFrame:
    e, q, h = _query_and_history(spark, d)
    moved = e.moved(q, e.similar(q, h), h)
    return moved.select("word_id", F.round("weight", 6).alias("weight"))


@query
def q_relevant_words(spark: Spark, d: str) -> DataFrame:
    e, q, h = _query_and_history(spark, d)
    moved = e.moved(q, e.similar(q, h), h)
    return expand.relevant_words(q, moved).select("word_id", F.round("weight", 6).alias("weight"))


@query
def q_suggest(spark: Spark, d: str) -> DataFrame:
    """All four kinds of suggestions for 'museum craw'."""
    e = _engine(spark, d)
    e.pmi = _pmi_per_term(spark, d)
    s = e.suggest("museum craw", _history(e, spark, d))
    out = None
    for kind, rows in s.items():
        name = "text" if kind == "similar" else "word"
        part = rows.select(F.lit(kind).alias("kind"), F.col(name).alias("suggestion"), F.round("value", 6).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


# -------------------------------------------------------------------- history


@query
def q_interactions(spark: Spark, d: str) -> DataFrame:
    return history.by_user(table(spark, d, "events")).select("query_id", "event_id", F.col("relevance").cast("long").alias("relevance"))


@query
def q_history_page(spark: Spark, d: str) -> DataFrame:
    """The third page of five events, newest first."""
    e = table(spark, d, "events")
    return history.page(e, [F.desc("ts"), F.desc("event_id")], 2, 5).select(F.col("row").cast("long").alias("row"), "event_id", "user_id", "event_type")


@query
def q_history_filter_type(spark: Spark, d: str) -> DataFrame:
    return history.of_types(table(spark, d, "events"), ["click", "purchase"], "event_type").select("event_id", "event_type")


@query
def q_history_search(spark: Spark, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type", "props")
    return history.containing(e.select(F.col("event_type"), "props", F.lit("").alias("x"), "event_id"), '{\\"K\\": 7').select("event_id")


@query
def q_history_antijoin(spark: Spark, d: str) -> DataFrame:
    """Clicks by users without a purchase above 60."""
    e = table(spark, d, "events")
    return history.not_chosen(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase' and value > 60"), ["user_id"]).select("event_id", "user_id")


@query
def q_history_index_of(spark: Spark, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type")
    at = history.index_of(e.filter("event_type <> 'view'"), ["event_id"], F.col("event_type") == "purchase")
    return spark.createDataFrame([(at,)], "first_purchase long")


# -------------------------------------------------------------------- maintenance


def _split_pages(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored pages, and a batch: the pages with an even id changed, and new ones."""
    old = standing_pages(table(spark, d, "webpage")).select("webpage_id", "url", "title", "size", "is_active")
    batch = old.filter("webpage_id % 2 = 0").select("webpage_id", "url", F.upper("title").alias("title"), (F.coalesce("size", F.lit(0)) + 1).alias("size"), F.lit(True).alias("is_active"))
    new = old.filter("webpage_id % 5 = 0").select((F.col("webpage_id") + 10_000_000).alias("webpage_id"), F.concat("url", F.lit("?new")).alias("url"), "title", "size", F.lit(False).alias("is_active"))
    return old, batch.unionByName(new)


@query
def q_upsert(spark: Spark, d: str) -> DataFrame:
    old, new = _split_pages(spark, d)
    return storage.upsert(old, new, ["webpage_id"], ["title", "size"])


@query
def q_upsert_ignore(spark: Spark, d: str) -> DataFrame:
    old, new = _split_pages(spark, d)
    return storage.insert_new(old, new, ["webpage_id"])[0]


@query
def q_insert_returning(spark: Spark, d: str) -> DataFrame:
    old, new = _split_pages(spark, d)
    return storage.insert_new(old, new, ["webpage_id"])[1].select("url", "webpage_id")


@query
def q_assign_ids(spark: Spark, d: str) -> DataFrame:
    """Ids for all words of the documents: stored ones where known, the next ones otherwise."""
    words = index.text_postings(_docs(spark, d), "doc_id", "text", "body").select(F.col("term").alias("word"))
    return storage.assign_ids(table(spark, d, "keyword"), words, "word", "word_id")


@query
def q_soft_delete_postings(spark: Spark, d: str) -> DataFrame:
    """A re-index of every page in the title index that lost its odd words."""
    return _reindexed(spark, d, "title_index")


@query
def q_soft_delete_body(spark: Spark, d: str) -> DataFrame:
    """The same in the body index."""
    return _reindexed(spark, d, "body_index")


def _reindexed(spark: Spark, d: str, name: str) -> DataFrame:
    old = standing_postings(table(spark, d, name), with_tf=True)
    batch = old.filter("word_id % 2 = 0").select("webpage_id", "word_id")
    return storage.zero_absent(old, batch, old.select("webpage_id")).select("webpage_id", "word_id", "frequency", F.round("normalized_tf", 9).alias("normalized_tf"))


@query
def q_deactivate_edges(spark: Spark, d: str) -> DataFrame:
    """A batch with the edges to even children of some parents: their other edges retire."""
    old = table(spark, d, "relationship").groupBy("parent_id", "child_id").agg(F.max("is_active").alias("is_active"))
    batch = old.filter("parent_id % 4 = 0 and child_id % 2 = 0").select("parent_id", "child_id")
    return storage.deactivate_absent(old, batch, ["parent_id", "child_id"], within="parent_id")


@query
def q_deactivate_pages(spark: Spark, d: str) -> DataFrame:
    old = standing_pages(table(spark, d, "webpage")).select("webpage_id", "is_active")
    return storage.deactivate_absent(old, old.filter("webpage_id % 7 <> 0").select("webpage_id"), ["webpage_id"])


@query
def q_bulk_update(spark: Spark, d: str) -> DataFrame:
    act = act_pages(table(spark, d, "webpage"), "pagerank")
    values = act.filter("webpage_id % 2 = 1").select("webpage_id", F.lit(0.5).alias("pagerank"))
    return storage.set_values(act, values, "webpage_id", "pagerank").select("webpage_id", F.round("pagerank", 6).alias("pagerank"))


@query
def q_report(spark: Spark, d: str) -> DataFrame:
    """One text block per act page."""
    return _report(spark, d)


@query
def q_report_limited(spark: Spark, d: str) -> DataFrame:
    """The report's options: the first twenty pages (the limit is the feature), three keywords, two children, no parents."""
    return _report(spark, d, limit=20, keywords=3, relations=2, with_parents=False)


def _report(spark: Spark, d: str, **options) -> DataFrame:
    active = standing_pages(table(spark, d, "webpage")).filter("is_active")
    ix = _index(spark, d)
    return report.report(active.filter("is_crawled"), ix.postings, ix.keyword, ix.edges, others=active, **options).select("webpage_id", "block")


@query
def q_combine_weight(spark: Spark, d: str) -> DataFrame:
    """Title and body normalized_tf by weight, as a full outer join of the two indexes."""
    t, b = (live_postings(table(spark, d, f"{f}_index"), with_tf=True).select("webpage_id", "word_id", F.col("normalized_tf").alias(f)) for f in ("title", "body"))
    return t.join(b, ["webpage_id", "word_id"], "full_outer").select("webpage_id", "word_id", F.round(combine(F.col("title"), F.col("body")), 9).alias("weight"))


# -------------------------------------------------------------------- text search, from texts to hits


def _text_index(spark: Spark, d: str) -> index.SearchIndex:
    """An index of stemmed words and phrases built from the act pages' titles and their latest documents."""

    def build(path: str) -> None:
        pages = standing_pages(table(spark, d, "webpage")).filter("is_active and is_crawled")
        docs = table(spark, d, "documents").filter("webpage_id is not null").groupBy("webpage_id").agg(F.max_by("text", F.struct("fetched_at", "doc_id")).alias("text"))
        docs = materialize(docs.join(pages.select("webpage_id"), "webpage_id", "left_semi"), "texts")
        held = pages.join(docs.select("webpage_id"), "webpage_id", "left_semi")
        texts = {"title": held.select("webpage_id", F.col("title").alias("text")), "body": docs}
        index.SearchIndex.of_texts(held, texts, table(spark, d, "relationship")).write(path)

    return index.SearchIndex.read(spark, built_once(spark, d, f"text-index-{BUILT}", build))


TEXT_QUERY = "searching for the museums and crawlers"


@query
def q_text_index(spark: Spark, d: str) -> DataFrame:
    """Postings of the index built from texts."""
    ix = _text_index(spark, d)
    return ix.postings.join(ix.keyword, "word_id").select("webpage_id", "field", "word", "frequency", F.round("normalized_tf", 9).alias("normalized_tf"))


@query
def q_text_search(spark: Spark, d: str) -> DataFrame:
    """Inflected words find the pages of their stems."""
    h = Engine(_text_index(spark, d)).search(Query(TEXT_QUERY)).hits
    return h.select("webpage_id", F.round("original_score", 6).alias("original_score"), F.round("modified_score", 6).alias("modified_score"))


@query
def q_text_search_vector(spark: Spark, d: str) -> DataFrame:
    e = Engine(_text_index(spark, d))
    tf, _ = e.query_tf(Query(TEXT_QUERY, page_not=("engravings",)))
    return e.with_words(e.query_vector(tf)).select("word", F.round("weight", 9).alias("weight"))


@query
def q_text_search_quoted(spark: Spark, d: str) -> DataFrame:
    """A quoted word must be on the page, by its stem."""
    h = Engine(_text_index(spark, d)).search(Query('searched pages "crawlers"')).hits
    return h.select("webpage_id", F.round("original_score", 6).alias("original_score"))


def flagship(spark: Spark, d: str) -> DataFrame:
    return q_search_ranked(spark, d)
