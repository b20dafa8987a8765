"""How distinctive a term is for a record: length-normalised term frequency times smoothed inverse document frequency.

    score = frequency / (sum of the record's frequencies) * ln((1 + N) / (1 + df))

N is the number of records, df the number of distinct records that have the
term.  A term of every record scores 0; a term of one record in N the most.

Null record or term ids, and frequencies that are null or not positive, are
left out.  Rows repeated for one (record, term) add up their frequencies and
count the record once.  An empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift import skew


def per_record(rows: DataFrame) -> DataFrame:
    """(record, term, frequency): one row per pair, frequencies added up."""
    return rows.filter("record is not null and term is not null and frequency > 0").groupBy("record", "term").agg(F.sum("frequency").alias("frequency"))


def document_frequency(pairs: DataFrame) -> DataFrame:
    """(term, df) over rows that are distinct in (record, term); partial counts are formed before the shuffle."""
    return pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def distinctiveness(pairs: DataFrame, df: DataFrame, n_records: int, hot: list | None = None) -> DataFrame:
    """(record, term, frequency, tf, df, idf, score) for each row of ``pairs`` (as :func:`per_record` gives them).

    ``df`` has (term, df) over the whole collection, ``pairs`` may be all of
    its records or those asked about.  Terms in ``hot`` (default: found by
    counting) are spread over several tasks when the counts are joined back.
    """
    if hot is None:
        hot = skew.hot_keys(pairs, "term")
    length = pairs.groupBy("record").agg(F.sum("frequency").alias("length"))
    hot_records = skew.hot_keys(pairs, "record")
    with_length = skew.salted_join(pairs, length, "record", hot=hot_records, spread=["term"])
    scored = skew.salted_join(with_length, df, "term", hot=hot, spread=["record"])
    idf = F.ln((F.lit(1.0) + F.lit(n_records)) / (F.lit(1.0) + F.col("df")))
    tf = F.col("frequency") / F.col("length")
    return scored.select("record", "term", "frequency", tf.alias("tf"), "df", idf.alias("idf"), (tf * idf).alias("score"))
