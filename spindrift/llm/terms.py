"""One term per spelling class: words equal after NFKC, lower-casing, trimming and white-space folding.

The smallest word_id of a class stands for it.  Null words belong to no term;
an empty word is the term ''.  Repeated rows count once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift import skew
from spindrift.session import materialize


def normal_word(word: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", word).lower().split())


def _normal_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [None if w is None else normal_word(w) for w in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.string())], names=["word_id", "term"])


def spellings(keyword: DataFrame) -> DataFrame:
    """(word_id, term_id) of every word; term_id is the smallest word_id of its term.

    The minimum is formed before and after the shuffle and joined back with
    terms of very many spellings salted.
    """
    plain = keyword.filter(F.col("word").isNotNull() & F.col("word_id").isNotNull()).select("word_id", "word")
    words = materialize(plain.mapInArrow(_normal_words, "word_id long, term string"), "terms")
    classes = words.groupBy("term").agg(F.min("word_id").alias("term_id"))
    return skew.salted_join(words, classes, "term", hot=skew.hot_keys(words, "term"), spread=["word_id"]).select("word_id", "term_id").distinct()


def variants(keyword: DataFrame) -> DataFrame:
    """The rows of :func:`spellings` whose word is not the one that stands for its term."""
    return spellings(keyword).filter("word_id <> term_id")
