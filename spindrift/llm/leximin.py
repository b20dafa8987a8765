"""One ranking from scores on different scales, by leximin over percentiles.

Within each group (a query) every score becomes a percentile: the share of the
group's other items with a lower value, so that only the order of a score
matters and no score's range.  A missing score is lower than any other.  Each
item's percentiles are sorted ascending and compared as arrays, higher first:
the worst score decides, then the second worst, and so on, so that a weak score
can't be hidden behind a strong one.  Items with equal arrays follow the item id.

A group of one item has percentile 0.  NaN counts as missing.  Rows with a null
group or item are left out; of rows repeated for one (group, item) the highest
value of each score counts.  An empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift import skew


def percentiles(items: DataFrame, group: str, item: str, scores: Sequence[str], n: int | None = None) -> DataFrame:
    """(group, item, p_<score> ...).

    All scores are ranked in one range-partitioned pass over (group, score,
    value), which splits groups of any size; see ``skew.range_rank``.
    """
    one = items.filter(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group, item).agg(*[F.max(F.when(~F.isnan(s), F.col(s))).alias(s) for s in scores])
    tall = one.select(group, item, F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(s).cast("double").alias("value")) for i, s in enumerate(scores)])).alias("s")).select(group, item, "s.kind", "s.value")
    ranked = skew.range_rank(tall, [group, "kind"], ["value"], n, label="leximin")
    wide = ranked.groupBy(group, item).agg(*[F.max(F.when(F.col("kind") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(scores))])
    sizes = ranked.filter("kind = 0").groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    both = skew.lookup_join(wide, sizes, group, hot_in=ranked.filter("kind = 0").select(group), spread=[item])
    pct = [F.when(F.col("size") > 1, (F.col(f"r{i}") - 1) / (F.col("size") - 1)).otherwise(F.lit(0.0)).alias(f"p_{s}") for i, s in enumerate(scores)]
    return both.select(group, item, *pct)


def leximin(items: DataFrame, group: str, item: str, scores: Sequence[str], n: int | None = None) -> DataFrame:
    """:func:`percentiles` and the sorted vector as columns worst, then v1, v2, ... (``v0`` is the worst)."""
    p = percentiles(items, group, item, scores, n)
    v = F.sort_array(F.array(*[F.col(f"p_{s}") for s in scores]))
    return p.withColumn("__v", v).select(*p.columns, *[F.col("__v")[i].alias(f"v{i}") for i in range(len(scores))])


def order(n_scores: int, item: str) -> list[tuple[str, str]]:
    """The comparison of :func:`leximin`'s rows, for ``topn.top_n``."""
    return [(f"v{i}", "desc") for i in range(n_scores)] + [(item, "asc")]
