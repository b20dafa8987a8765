"""Search, joined search and suggestions over a :class:`SearchIndex`.

A query becomes a few literals (word ids and weights) on the driver; everything
that grows with the collection is one Spark plan: candidates by semi and anti
joins, dot products with the broadcast query, precomputed norms, PageRank extrema.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as tx
from spindrift.functions import vector as vec
from spindrift.functions.porter import stem
from spindrift.operators import boolean, expand, joined
from spindrift.operators.index import SearchIndex, combined_idf, combined_tf, top_words
from spindrift.operators.report import neighbours
from spindrift.plans.spec import LISTS, JoinedQuery, Query
from spindrift.session import materialize

MISSING_WORD = -1
#: Words up to which a query vector is put into the plan as literals.
LITERAL_WORDS = 1000


@dataclass
class History:
    """past (query_id, word_id, weight), interactions (query_id, webpage_id, relevance), texts (query_id, text)."""

    past: DataFrame
    interactions: DataFrame
    texts: DataFrame | None = None


@dataclass
class Result:
    hits: DataFrame
    original_vector: DataFrame
    modified_vector: DataFrame


class Engine:
    def __init__(self, index: SearchIndex, pmi: DataFrame | None = None, stopwords=tx.STOPWORDS) -> None:
        self.ix, self.pmi, self.stopwords = index, pmi, stopwords
        self.spark = index.pages.sparkSession

    # ---------------------------------------------------------------- query vectors

    def analysed(self, text: str) -> tuple[dict[str, int], list[str], set[str]]:
        """Words, phrases and musts of a text as the index has them: stemmed where its dictionary is."""
        stemmed = self.ix.stemmed
        return tx.analyse_query(text, self.stopwords, tx.PHRASE_STOPWORDS if stemmed else None, stemmed)

    def rooted(self, q: Query) -> Query:
        """The query with the words of its lists as the index has them."""
        if not self.ix.stemmed:
            return q
        return replace(q, **{n: tuple(" ".join(stem(w) for w in x.lower().split()) for x in getattr(q, n)) for n in LISTS})

    def word_ids(self, words) -> dict[str, int]:
        """Ids of exactly these words (a handful, bounded by the query)."""
        w = sorted(set(words))
        return {r.word: r.word_id for r in self.ix.keyword.filter(F.col("word").isin(w)).groupBy("word").agg(F.min("word_id").alias("word_id")).collect()} if w else {}

    def query_tf(self, q: Query) -> tuple[dict[int, float], boolean.WordSets]:
        """(word_id -> normalised tf, the word sets with the text's words and quoted words added)."""
        terms, phrases, must = self.analysed(q.text)
        q = self.rooted(q)
        ids = self.word_ids({*terms, *phrases, *must, *q.words()})
        counts: dict[int, float] = {}
        for t, n in [*terms.items(), *[(p, min(terms.get(w, 0) for w in p.split())) for p in phrases]]:
            if t in ids and n > 0:
                counts[ids[t]] = counts.get(ids[t], 0) + n
        sets = q.sets(ids)
        for i in sets.wanted() - sets.unwanted() - {MISSING_WORD}:
            counts[i] = counts.get(i, 0) + 1
        for i in sets.unwanted() - {MISSING_WORD}:
            counts[i] = -1
        top = max([1, *counts.values()])
        sets.page_all |= {ids.get(m, MISSING_WORD) for m in must}
        text_ids = {ids[t] for t in [*terms, *phrases] if t in ids}
        sets.page_any |= text_ids
        return {i: n / top for i, n in counts.items()}, sets

    def _small(self, weights: dict[int, float], name: str) -> DataFrame:
        rows = [(int(i), float(w)) for i, w in sorted(weights.items())]
        return self.spark.createDataFrame(rows, f"word_id long, {name} double")

    def idf_of(self, words) -> DataFrame:
        """(word_id, idf) combined over the fields, for a few words only: the postings scan prunes by word."""
        w = sorted(words)
        return combined_idf(self.ix.idf.filter(F.col("word_id").isin(w)), self.ix.cfg)

    def query_weights(self, tf: dict[int, float]) -> dict[int, float]:
        """word_id -> tf * idf of the query's own few words; words on no or on every page are dropped."""
        return {r.word_id: tf[r.word_id] * r.idf for r in self.idf_of(tf).collect()} if tf else {}

    def query_vector(self, tf: dict[int, float]) -> DataFrame:
        """(word_id, weight)."""
        return self._small(self.query_weights(tf), "weight")

    def co_occurring(self, tf: dict[int, float]) -> DataFrame:
        if self.pmi is None or not tf:
            return self._small({}, "weight")
        return expand.co_occurring(self.pmi, self._small(tf, "tf"), combined_idf(self.ix.idf, self.ix.cfg), self.ix.cfg)

    def modified_vector(self, tf: dict[int, float], vector: DataFrame, history: History | None) -> DataFrame:
        """The query after relevance feedback, plus co-occurring words."""
        moved = vector
        if history is not None:
            moved = self.moved(vector, self.similar(vector, history), history)
        return materialize(vec.merge_sum(moved, self.co_occurring(tf)), "query")

    def similar(self, vector: DataFrame, history: History) -> DataFrame:
        """Past queries like this one; written, as both feedback and suggestions read it."""
        return materialize(expand.similar_queries(history.past, vector, self.ix.cfg), "similar")

    def moved(self, vector: DataFrame, similar: DataFrame, history: History) -> DataFrame:
        return expand.relevance_feedback(vector, similar, history.interactions, self.ix.tops, self.ix.cfg)

    # ---------------------------------------------------------------- search

    def scores(self, vector: DataFrame, pages: DataFrame, weights: dict[int, float] | None = None) -> DataFrame:
        """(webpage_id, cosine) for each candidate page that has postings; the joins with norms and pages are inner ones, so that few candidates are broadcast.

        ``weights`` has the vector as literals where it is known on the driver;
        so has this a vector of up to LITERAL_WORDS counted rows.  Then only the
        row groups of its words are read.
        """
        if weights is None:
            rows = vector.limit(LITERAL_WORDS + 1).collect()
            weights = {r.word_id: r.weight for r in rows} if len(rows) <= LITERAL_WORDS else None
        vectors = self.ix.vectors
        if weights is not None:
            vectors = vectors.filter(F.col("word_id").isin(sorted(weights)))
        q = vector.groupBy("word_id").agg(F.sum("weight").alias("q"))
        if weights is not None:
            q = self._small(weights, "q")
            norm = math.sqrt(sum(w * w for w in weights.values()))
            dots = vectors.join(F.broadcast(q), "word_id").groupBy("webpage_id").agg(F.sum(F.col("weight") * F.col("q")).alias("dot"))
            both = pages.join(dots, "webpage_id", "left").join(self.ix.norms, "webpage_id")
            return both.select("webpage_id", vec.cosine(F.col("dot"), F.col("norm"), F.lit(norm)).alias("cosine"))
        qn = q.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
        dots = vec.dots(vectors, "webpage_id", q)
        c = vec.cosine(F.col("dot"), F.col("norm"), F.col("qn"))
        return pages.join(dots, "webpage_id", "left").join(self.ix.norms, "webpage_id").crossJoin(F.broadcast(qn)).select("webpage_id", c.alias("cosine"))

    def rank_ends(self) -> tuple[float | None, float | None]:
        """Lowest and highest PageRank of all pages, act or not."""
        if self.ix.ranks is None:
            r = self.ix.pages.agg(F.min("pagerank").alias("lo"), F.max("pagerank").alias("hi")).first()
            self.ix.ranks = (r.lo, r.hi)
        return self.ix.ranks

    def search(self, q: Query, history: History | None = None, literal_not: bool = False) -> Result:
        """Hits (webpage_id, original_score, modified_score); none for a query without known words.  The modified score has the scaled PageRank in it."""
        cfg = self.ix.cfg
        tf, sets = self.query_tf(q)
        weights = self.query_weights(tf)
        original = self._small(weights, "weight")
        plain = not weights or (history is None and self.pmi is None)
        modified = original if plain else self.modified_vector(tf, original, history)
        # words that every page has can't tell pages apart, and words marked "not" are no candidates
        sets.page_any = {i for i in sets.page_any if weights.get(i, -1) >= 0 or i == MISSING_WORD}
        pages = boolean.candidates(self.ix.pages, self.ix.postings, sets, boolean.date_range("last_modified_date", q.from_date, q.to_date) if q.from_date or q.to_date else None, literal_not, closed=True)
        if not weights:
            pages = pages.limit(0)
        o = self.scores(original, pages, weights).withColumnRenamed("cosine", "original_score")
        m = o if plain else self.scores(modified, pages).withColumnRenamed("cosine", "m")
        both = o.withColumn("m", F.col("original_score")) if m is o else o.join(m, "webpage_id")
        lo, hi = (F.lit(x).cast("double") for x in self.rank_ends())
        scaled = vec.min_max(F.col("pagerank"), lo, hi)
        score = (1 - cfg.pagerank_weight) * F.col("m") + cfg.pagerank_weight * scaled
        hits = both.join(self.ix.pages.select("webpage_id", "pagerank"), "webpage_id").select("webpage_id", "original_score", score.alias("modified_score"))
        return Result(hits, original, modified)

    def ranked(self, hits: DataFrame, score: str = "modified_score") -> DataFrame:
        """Hits in order; scores equal to nine digits are a tie, which the smaller id wins."""
        return hits.orderBy(F.round(score, 9).desc(), "webpage_id")

    def top(self, hits: DataFrame, n: int, score: str = "modified_score") -> DataFrame:
        """The first ``n`` hits with their ``position``."""
        first = self.ranked(hits, score).limit(n)
        return first.withColumn("position", F.row_number().over(Window.orderBy(F.round(score, 9).desc(), "webpage_id")))

    def joined_search(self, j: JoinedQuery | Query, history: History | None = None, strict: bool = False) -> Result:
        """Both scores averaged over the lists, query vectors averaged likewise; joins may be nested."""
        if isinstance(j, Query):
            return self.search(j, history)
        parts = [self.joined_search(p, history, strict) for p in j.queries]
        names = ("original_score", "modified_score")
        if j.kind == "merged":
            hits = joined.merged([p.hits for p in parts], names)
        else:
            hits = parts[0].hits
            for p in parts[1:]:
                hits = joined.within(hits, p.hits, names, strict)

        def average(vectors: list[DataFrame]) -> DataFrame:
            out = vectors[0]
            for v in vectors[1:]:
                out = out.unionByName(v)
            return expand.average_vectors(out, len(vectors))

        return Result(hits, average([p.original_vector for p in parts]), average([p.modified_vector for p in parts]))

    def assemble(self, hits: DataFrame) -> DataFrame:
        """Hits with page attributes, top words by tf and by tf-idf, and up to five parents and children; batch joins, no lookups per page."""
        cfg = self.ix.cfg
        words = self.ix.keyword.select("word_id", "word")
        ids = hits.select("webpage_id")

        def tops(vectors: DataFrame, name: str) -> DataFrame:
            t = top_words(vectors.join(ids, "webpage_id", "left_semi"), cfg.max_ranked_words).join(words, "word_id")
            return t.groupBy("webpage_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word", "word_id", F.col("weight").alias("value")))), lambda s: F.struct(s["word"].alias("word"), s["word_id"].alias("word_id"), s["value"].alias("value"))).alias(name))

        near = neighbours(self.ix.edges, self.ix.pages, cfg.max_relations).join(ids, "webpage_id", "left_semi")
        urls = F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda s: s["url"])
        parents = near.filter("kind = 'parent'").groupBy("webpage_id").agg(urls.alias("parents"))
        children = near.filter("kind = 'child'").groupBy("webpage_id").agg(urls.alias("children"))
        pages = self.ix.pages.select("webpage_id", "url", "title", "last_modified_date", "size")
        out = hits.join(pages, "webpage_id")
        for side in (tops(combined_tf(self.ix.postings, cfg), "top_tfs"), tops(self.ix.vectors, "top_tfidfs"), parents, children):
            out = out.join(side, "webpage_id", "left")
        return out

    def with_words(self, vector: DataFrame) -> DataFrame:
        """(word, word_id, weight) of a query vector."""
        return vector.join(self.ix.keyword.select("word_id", "word"), "word_id").select("word", "word_id", "weight")

    # ---------------------------------------------------------------- suggestions

    def suggest(self, text: str, history: History | None = None) -> dict[str, DataFrame]:
        """fuzzy, co_occurring, relevant (word, value) and similar (text, value), each in descending order."""
        cfg = self.ix.cfg
        q = Query(text)
        tf, _ = self.query_tf(q)
        terms, _, _ = self.analysed(text)
        top = max([1, *terms.values()])
        fuzzy = expand.top_fuzzy(self.ix.keyword, {t: n / top for t, n in terms.items()}, cfg).select("word", F.col("weight").alias("value")).filter("value > 0")
        vector = self.query_vector(tf)
        co = self.with_words(self.co_occurring(tf)).select("word", F.col("weight").alias("value")).filter("value > 0")
        out = {"fuzzy": fuzzy.orderBy(F.desc("value"), "word"), "co_occurring": co.orderBy(F.desc("value"), "word")}
        if history is not None:
            similar = self.similar(vector, history)
            moved = self.moved(vector, similar, history)
            out["relevant"] = self.with_words(expand.relevant_words(vector, moved, cfg)).select("word", F.col("weight").alias("value")).orderBy(F.desc("value"), "word")
            texts = history.texts if history.texts is not None else history.past.select("query_id", F.col("query_id").cast("string").alias("text")).distinct()
            out["similar"] = similar.join(texts, "query_id").groupBy("text").agg(F.max("similarity").alias("value")).orderBy(F.desc("value"), "text")
        return out
