"""The inverted index: postings from text, document frequency, idf, document vectors, and its durable form."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift import skew
from spindrift.config import DEFAULT, Config
from spindrift.functions import text as tx
from spindrift.functions.porter import stem
from spindrift.functions.vector import norms
from spindrift.session import materialize
from spindrift.tables import act_postings_by_page, standing_pages, table


def _count_terms(stopwords: Sequence[str], parting: Sequence[str], stemmed: bool, with_phrases: bool):
    """Arrow iterator from (doc, tokens) to (doc, term, frequency, normalized_tf), on the codes of a batch's distinct words."""
    stop, part = frozenset(stopwords), frozenset(parting)

    def counted(b: pa.RecordBatch) -> pa.RecordBatch | None:
        tokens = b.column(1)
        flat = pc.dictionary_encode(tokens.flatten())
        if not len(flat):
            return None
        words = flat.dictionary.to_pylist()
        roots = [stem(w) for w in words] if stemmed else words
        numbers: dict[str, int] = {}
        root = np.array([numbers.setdefault(r, len(numbers)) for r in roots], np.int64)
        names, n = list(numbers), len(numbers)
        is_stop, is_part = (np.array([w in s for w in words]) for s in (stop, part))
        codes = flat.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        kept = ~is_stop[codes]
        # a document's words: its row and the word's number in one key
        keys, counts = np.unique(row[kept] * n + root[codes[kept]], return_counts=True)
        rows, terms = [keys // n], [pa.array(names, pa.string()).take(pa.array(keys % n))]
        freqs = [counts]
        if with_phrases:
            run = np.cumsum(is_part[codes] | (np.diff(row, prepend=-1) != 0))
            inside = kept & ~is_part[codes]
            run, at, word = run[inside], row[inside], root[codes[inside]]
            first = np.flatnonzero(np.diff(run, prepend=-1))
            size = np.diff(np.append(first, len(run)))
            first, size = first[(size == 2) | (size == 3)], size[(size == 2) | (size == 3)]
            third = np.where(size == 3, word[np.minimum(first + 2, len(word) - 1)], -1) if len(first) else np.zeros(0, np.int64)
            found = np.unique(np.stack([at[first], word[first], word[first + 1], third], 1), axis=0) if len(first) else np.zeros((0, 4), np.int64)
            least = np.full(len(found), np.iinfo(np.int64).max)
            for k in (1, 2, 3):
                there = found[:, k] >= 0
                least[there] = np.minimum(least[there], counts[np.searchsorted(keys, found[there, 0] * n + found[there, k])])
            rows.append(found[:, 0])
            freqs.append(least)
            terms.append(pa.array([" ".join(names[x] for x in f[1:] if x >= 0) for f in found], pa.string()))
        of, freq = np.concatenate(rows), np.concatenate(freqs).astype(np.int64)
        top = np.zeros(b.num_rows, np.int64)
        np.maximum.at(top, of, freq)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.concat_arrays(terms), pa.array(freq), pa.array(freq / top[of])], names=["doc", "term", "frequency", "normalized_tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                made = counted(whole.slice(at, 512))
                if made is not None:
                    yield made

    return run


def text_postings(
    docs: DataFrame, doc: str, text: str, field: str, with_phrases: bool = False, stopwords: Sequence[str] = tx.STOPWORDS, stemmed: bool = False, phrase_stopwords: Sequence[str] = tx.PHRASE_STOPWORDS
) -> DataFrame:
    """(doc, field, term, frequency, normalized_tf) of a text column; one row per document, which is counted by itself, without a shuffle.

    Words are counted without ``stopwords``, by their stems if ``stemmed``.  A
    phrase is a run between parting words of which two or three words are left
    without the stop words; with stems they are ``phrase_stopwords``, else the stop
    words.  Its frequency is the smallest of its words' frequencies.  The
    normalising maximum is taken over the text's words and phrases.  Texts
    without tokens have no postings.
    """
    kind = docs.schema[doc].dataType.simpleString()
    parting = phrase_stopwords if stemmed else stopwords
    tokens = docs.select(F.col(doc).alias("doc"), tx.tokens(F.col(text)).alias("t"))
    terms = tokens.mapInArrow(_count_terms(stopwords, parting, stemmed, with_phrases), f"doc {kind}, term string, frequency long, normalized_tf double")
    return terms.select(F.col("doc").alias(doc), F.lit(field).alias("field"), "term", "frequency", "normalized_tf")


def word_dictionary(terms: DataFrame, term: str = "term") -> DataFrame:
    """(word, word_id) with ids 1, 2, ... in the order of the words; range-partitioned, so of any size."""
    words = terms.filter(F.col(term).isNotNull()).select(F.col(term).alias("word")).distinct()
    return skew.range_rank(words, [], ["word"], label="words").select("word", F.col("position").alias("word_id"))


def idf(postings: DataFrame, n_pages: int) -> DataFrame:
    """(field, word_id, df, idf): idf = log10(pages / pages having the word in that field)."""
    df = postings.groupBy("field", "word_id").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log10(F.lit(float(max(n_pages, 1))) / F.col("df")))


def combined_idf(idfs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(word_id, idf): title and body idf by weight; words with 0 (on every page of both fields) are dropped."""
    w = F.when(F.col("field") == "title", cfg.title_weight).otherwise(cfg.body_weight)
    return idfs.groupBy("word_id").agg(F.sum(w * F.col("idf")).alias("idf")).filter(F.col("idf") > 0)


def _field_weight(cfg: Config) -> Column:
    return F.when(F.col("field") == "title", cfg.title_weight).otherwise(cfg.body_weight)


def document_vectors(postings: DataFrame, idfs: DataFrame, cfg: Config = DEFAULT, hot: Sequence = ()) -> DataFrame:
    """(webpage_id, word_id, weight): title and body tf-idf by weight; a null normalized_tf counts as 0."""
    # idf depends on (field, word): one dictionary row per word, so that the join needs one key
    per_word = idfs.groupBy("word_id").agg(F.max(F.when(F.col("field") == "title", F.col("idf"))).alias("idf_t"), F.max(F.when(F.col("field") == "body", F.col("idf"))).alias("idf_b"))
    both = skew.lookup_join(postings, per_word, "word_id", hot_in=postings, spread=["webpage_id"])
    value = _field_weight(cfg) * F.coalesce("normalized_tf", F.lit(0.0)) * F.when(F.col("field") == "title", F.col("idf_t")).otherwise(F.col("idf_b"))
    return both.groupBy("webpage_id", "word_id").agg(F.sum(value).alias("weight"))


def combined_tf(postings: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(webpage_id, word_id, weight): title and body normalized_tf by weight."""
    return postings.groupBy("webpage_id", "word_id").agg(F.sum(_field_weight(cfg) * F.coalesce("normalized_tf", F.lit(0.0))).alias("weight"))


def top_words(vectors: DataFrame, n: int = DEFAULT.max_ranked_words, digits: int = 9) -> DataFrame:
    """The ``n`` words of highest weight per page (rounded to ``digits``; ties: the smaller id), with ``rank``.

    Spark keeps n rows a page before the shuffle already (window group limit).
    """
    rounded = vectors.withColumn("weight", F.round("weight", digits))
    w = Window.partitionBy("webpage_id").orderBy(F.desc("weight"), "word_id")
    return rounded.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def keyword_totals(title: DataFrame, body: DataFrame, keyword: DataFrame) -> DataFrame:
    """(word_id, word, title_total, body_total, total) over live postings of all pages, active or not."""
    rows = title.select("word_id", F.col("frequency").alias("t"), F.lit(0).cast("long").alias("b")).unionByName(body.select("word_id", F.lit(0).cast("long").alias("t"), F.col("frequency").alias("b")))
    sums = rows.groupBy("word_id").agg(F.sum("t").alias("title_total"), F.sum("b").alias("body_total"))
    return sums.join(keyword.select("word_id", "word"), "word_id").withColumn("total", F.col("title_total") + F.col("body_total"))


@dataclass
class SearchIndex:
    """What queries read: act pages, their live postings, idf, document vectors, norms and top words, the keyword dictionary.

    ``stemmed``: the dictionary's words are stems, so queries are stemmed too.
    """

    pages: DataFrame
    postings: DataFrame
    keyword: DataFrame
    edges: DataFrame
    n_pages: int
    idf: DataFrame
    vectors: DataFrame
    norms: DataFrame
    tops: DataFrame
    cfg: Config = DEFAULT
    stemmed: bool = False
    #: lowest and highest PageRank of all pages, act or not
    ranks: tuple[float | None, float | None] | None = None

    TABLES = ("pages", "postings", "keyword", "edges", "idf", "vectors", "norms", "tops")

    @classmethod
    def of(cls, spark: SparkSession, d: str, cfg: Config = DEFAULT) -> "SearchIndex":
        """Defined lazily over the tables in ``d``; nothing but the page count and the PageRank extrema is computed here."""
        webpage = table(spark, d, "webpage")
        standing = standing_pages(webpage)
        pages = standing.filter(F.col("is_active") & F.col("is_crawled"))
        ends = standing.agg(F.min("pagerank").alias("lo"), F.max("pagerank").alias("hi"), F.count(F.when(F.col("is_active") & F.col("is_crawled"), 1)).alias("n")).first()
        return cls._over(pages, act_postings(spark, d), table(spark, d, "keyword"), table(spark, d, "relationship"), ends.n, (ends.lo, ends.hi), cfg, False)

    @classmethod
    def of_texts(cls, pages: DataFrame, texts: dict[str, DataFrame], edges: DataFrame, cfg: Config = DEFAULT, stemmed: bool = True) -> "SearchIndex":
        """Built from texts: ``texts`` has, by field, (webpage_id, text); words and phrases are analysed, by default stemmed, and numbered."""
        terms = None
        for field, docs in texts.items():
            own = text_postings(docs, "webpage_id", "text", field, with_phrases=True, stemmed=stemmed)
            terms = own if terms is None else terms.unionByName(own)
        terms = materialize(terms, "terms")
        keyword = materialize(word_dictionary(terms), "keyword")
        hot = skew.hot_keys(terms, "term")
        posts = skew.salted_join(terms, keyword.withColumnRenamed("word", "term"), "term", hot=hot, spread=["webpage_id"]).select("webpage_id", "field", "word_id", "frequency", "normalized_tf")
        ends = pages.agg(F.min("pagerank").alias("lo"), F.max("pagerank").alias("hi"), F.count(F.lit(1)).alias("n")).first()
        return cls._over(pages, materialize(posts, "postings"), keyword, edges, ends.n, (ends.lo, ends.hi), cfg, stemmed)

    @classmethod
    def _over(cls, pages, posts, keyword, edges, n: int, ranks: tuple, cfg: Config, stemmed: bool) -> "SearchIndex":
        idfs = idf(posts, n)
        vectors = document_vectors(posts, idfs, cfg)
        return cls(pages, posts, keyword, edges, n, idfs, vectors, norms(vectors, "webpage_id"), top_words(vectors, cfg.max_ranked_words), cfg, stemmed, ranks)

    def write(self, path: str) -> None:
        """Durable form: one Parquet table each; postings and vectors clustered by word, so that a query's words prune row groups.

        Each is computed from the tables written before it, so the raw rows are read once.
        """
        ix = self
        for name in ("pages", "postings", "keyword", "edges", "idf", "vectors", "norms", "tops"):
            if name == "idf":
                ix = SearchIndex._over(ix.pages, ix.postings, ix.keyword, ix.edges, ix.n_pages, ix.ranks, ix.cfg, ix.stemmed)
            elif name == "vectors":
                ix.vectors = document_vectors(ix.postings, ix.idf, ix.cfg)
            elif name == "norms":
                ix.norms, ix.tops = norms(ix.vectors, "webpage_id"), top_words(ix.vectors, ix.cfg.max_ranked_words)
            df: DataFrame = getattr(ix, name)
            if name in ("postings", "vectors"):
                df = df.repartitionByRange("word_id", "webpage_id").sortWithinPartitions("word_id", "webpage_id")
            elif name in ("idf", "tops", "norms", "keyword"):
                df = df.repartitionByRange("webpage_id" if name in ("tops", "norms") else "word_id")
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            if ix is self:
                ix = replace(self)
            setattr(ix, name, df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}"))
        about = [(self.n_pages, self.stemmed, *(self.ranks or (None, None)))]
        self.pages.sparkSession.createDataFrame(about, "n_pages long, stemmed boolean, lo double, hi double").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def read(cls, spark: SparkSession, path: str, cfg: Config = DEFAULT) -> "SearchIndex":
        t = {n: spark.read.parquet(f"{path}/{n}") for n in cls.TABLES}
        about = spark.read.parquet(f"{path}/about").first()
        return cls(n_pages=about.n_pages, cfg=cfg, stemmed=about.stemmed, ranks=(about.lo, about.hi), **t)


def act_postings(spark: SparkSession, d: str) -> DataFrame:
    """(webpage_id, field, word_id, frequency, normalized_tf): live postings of act pages, both fields."""
    return act_postings_by_page(spark, d, with_tf=True).rows.select("webpage_id", "field", "word_id", "frequency", "normalized_tf")
