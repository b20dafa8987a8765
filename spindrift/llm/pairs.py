"""Items that appear together, and how far beyond chance.

``pair_counts`` gives the exact number of shared baskets of every pair that can
reach a wanted share of the rarer item's baskets; ``surprise`` compares the
counts with a bipartite configuration null.

Counting.  With item a the rarer one (ties: the smaller id), a pair counts when
n12 >= SHARE * n1.  Of a's n1 baskets, sorted by size, the first
n1 - ceil(SHARE * n1) + t must then hold b at least t times (t = ceil(n1 / 4)).
Only these small baskets are opened for a; they yield candidates, whose exact
counts come from the remaining baskets.  A basket is never paired with itself:
one with very many items is opened for the few items that have nothing smaller.
Items in fewer than ``min_count`` baskets, or in more than ``max_share`` of all,
can't be in a result and are left out first.

Null.  P(item i in basket p) = x_i y_p / (1 + x_i y_p), with x and y fitted so
that every item's frequency and every basket's size are met on average (fitted
on degree classes: at most ``classes`` each, whatever the data size).  A pair's
count is then a sum of independent Bernoulli variables (Poisson-binomial); its
upper tail is computed by a saddlepoint approximation with lattice correction,
and false discoveries are controlled by Benjamini-Hochberg over all pairs of
eligible items.

Rows with a null basket or item are left out; repeated rows count once.  No rows, or
no eligible item, give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift import skew
from spindrift.session import materialize

_PAIR = "word1_id long, word2_id long, n1 long, n2 long, n12 long"


def _degree_class(n: "F.Column", exact: int, per_octave: int) -> "F.Column":
    return F.when(n <= exact, n.cast("int")).otherwise((F.lit(exact) + F.floor(F.log2(n / F.lit(float(exact))) * per_octave) + 1).cast("int"))


def degree_histogram(counts: DataFrame, n: str, exact: int = 256, per_octave: int = 16) -> list[tuple[float, int]]:
    """(mean degree, how many) by degree class: each degree up to ``exact`` by itself, then ``per_octave`` classes a doubling (under 1,000 classes in all)."""
    c = _degree_class(F.col(n), exact, per_octave)
    rows = counts.groupBy(c.alias("c")).agg(F.avg(F.col(n).cast("double")).alias("d"), F.count(F.lit(1)).alias("m")).collect()
    return sorted((r.d, r.m) for r in rows)


def fit_null(items: list[tuple[float, int]], baskets: list[tuple[float, int]], rounds: int = 200, tol: float = 1e-9):
    """(degree, x) of item classes and (y, how many) of basket classes: the bipartite configuration model with these mean degrees."""
    import numpy as np

    ni, mi = (np.array([t[k] for t in items], float) for k in (0, 1))
    nb, mb = (np.array([t[k] for t in baskets], float) for k in (0, 1))
    edges = max(float((ni * mi).sum()), 1.0)
    x, y = ni / math.sqrt(edges), nb / math.sqrt(edges)
    for _ in range(rounds):
        x1 = ni / ((mb * y)[None, :] / (1 + x[:, None] * y[None, :])).sum(1)
        y1 = nb / ((mi * x1)[None, :] / (1 + y[:, None] * x1[None, :])).sum(1)
        done = np.max(np.abs(x1 / x - 1)) < tol and np.max(np.abs(y1 / y - 1)) < tol
        x, y = x1, y1
        if done:
            break
    return ni, x, y, mb


def log10_upper_tail(k: "np.ndarray", q: "np.ndarray", m: "np.ndarray") -> "np.ndarray":
    """log10 P(X >= k) for X = sum over classes c of Binomial(m_c, q_c), row by row.

    ``k`` has one entry per row, ``q`` one row of probabilities per entry.
    Lugannani-Rice with the second continuity correction.  A count of less than
    half above the mean is no surprise and gets 0 (p = 1); just above the mean,
    where the formula is singular, its normal limit is used.
    """
    import numpy as np

    k = np.asarray(k, float)
    mean = (m * q).sum(1)
    var = np.maximum((m * q * (1 - q)).sum(1), 1e-300)
    kk = np.minimum(k, (m * (q > 0)).sum(1)) - 0.5
    out = np.zeros(len(k))
    up = kk > mean
    if not up.any():
        return out
    qu, ku = q[up], kk[up]
    s = np.log(np.maximum(ku, 1e-12) / np.maximum(mean[up], 1e-300))
    s = np.clip(s, 0, 60)
    for _ in range(60):
        e = np.exp(s)[:, None] * qu
        p = e / (1 - qu + e)
        k1 = (m * p).sum(1)
        k2 = np.maximum((m * p * (1 - p)).sum(1), 1e-300)
        step = (ku - k1) / k2
        s = np.clip(s + np.clip(step, -1, 1), 1e-9, 80)
        if np.max(np.abs(step)) < 1e-10:
            break
    e = np.exp(s)[:, None] * qu
    p = e / (1 - qu + e)
    k0 = (m * np.log1p(qu * np.expm1(s)[:, None])).sum(1)
    k2 = np.maximum((m * p * (1 - p)).sum(1), 1e-300)
    expo = s * ku - k0
    w = np.sqrt(2 * np.maximum(expo, 0))
    u = 2 * np.sinh(s / 2) * np.sqrt(k2)
    near = w < 1e-3
    # tail = Phi(-w) + phi(w) (1/u - 1/w), kept in logarithms: Phi(-w) = phi(w) R(w)
    ratio = _mills(w) + 1 / np.maximum(u, 1e-300) - 1 / np.maximum(w, 1e-300)
    log_tail = -expo - 0.5 * math.log(2 * math.pi) + np.log(np.maximum(ratio, 1e-300))
    z = (ku - mean[up]) / np.sqrt(var[up])
    log_tail = np.where(near, np.log(_mills(np.maximum(z, 0))) - z * z / 2 - 0.5 * math.log(2 * math.pi), log_tail)
    out[up] = np.minimum(log_tail, 0) / math.log(10)
    return out


def _mills(w: "np.ndarray") -> "np.ndarray":
    """(1 - Phi(w)) / phi(w) for w >= 0: erfc for small, a continued fraction for large w."""
    import numpy as np

    w = np.asarray(w, float)
    small = np.array([math.erfc(min(v, 8.0) / math.sqrt(2)) / 2 for v in w]) * np.exp(np.minimum(w, 8.0) ** 2 / 2) * math.sqrt(2 * math.pi)
    t = np.zeros_like(w)
    for i in range(60, 0, -1):
        t = i / (w + t)
    return np.where(w < 3, small, 1 / (w + t))


def item_counts(rows: DataFrame) -> DataFrame:
    """(item, n), written; rows distinct in (basket, item)."""
    return materialize(rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "pairs-items")


def eligible(counts: DataFrame, n_baskets: int, min_count: int, max_share: tuple[int, int]) -> DataFrame:
    """(item, n) of the items in at least ``min_count`` and at most ``max_share`` of all baskets."""
    num, den = max_share
    return counts.filter((F.col("n") >= min_count) & (F.col("n") * den <= F.lit(n_baskets * num)))


def _sized(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``size`` of their baskets, which orders baskets; large baskets are spread over several tasks."""
    if "size" in rows.columns:
        return rows.select("basket", "item", "size")
    sizes = rows.groupBy("basket").agg(F.count(F.lit(1)).alias("size"))
    return skew.salted_join(rows.select("basket", "item"), sizes, "basket", hot=skew.hot_keys(rows, "basket"), spread=["item"])


def pair_counts(
    rows: DataFrame, n_baskets: int, min_count: int = 7, share: tuple[int, int] = (3, 4), max_share: tuple[int, int] = (1, 5), min_shared: int | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """(word1_id, word2_id, n1, n2, n12), word1_id < word2_id, of all pairs with n12 >= min_count and n12 >= share * min(n1, n2).

    ``min_shared`` is the least n12 where it isn't the items' ``min_count``.  With a share of 0 every basket is opened.
    ``rows`` (basket, item, and size if known) must be distinct and stable (a written table).
    """
    num, den = share
    least = min_count if min_shared is None else min_shared
    counts = item_counts(rows) if counts is None else counts
    # the joins below spread large baskets, and items with many candidates, over several tasks
    sized = _sized(rows)
    kept = skew.lookup_join(sized, eligible(counts, n_baskets, min_count, max_share), "item", hot_in=rows, spread=["basket"])
    need = F.ceil(F.col("n") * num / F.lit(den))
    t = F.ceil(F.col("n") / F.lit(4))
    ranked = skew.range_rank(kept.select("basket", "item", "n", "size"), ["item"], ["size", "basket"], label="pairs-order")
    ranked = materialize(ranked.select("basket", "item", "n", (F.col("position") <= F.least(F.col("n"), F.col("n") - need + t)).alias("opens")), "pairs-rows")
    hot = skew.hot_keys(ranked, "basket")
    opened = ranked.filter("opens").select(F.col("item").alias("a"), F.col("n").alias("na"), "basket")
    other = ranked.select(F.col("item").alias("b"), F.col("n").alias("nb"), "basket")
    rarer = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    found = skew.salted_join(opened, other, "basket", hot=hot, spread=["a"]).filter(rarer).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    needs = F.ceil(F.col("na") * num / F.lit(den))
    opens = F.least(F.col("na"), F.col("na") - needs + F.ceil(F.col("na") / F.lit(4)))
    # what the unopened baskets can add at most
    found = found.filter(F.col("c") + F.col("na") - opens >= F.greatest(needs, F.lit(least)))
    candidates = materialize(found, "pairs-candidates")
    # the baskets of a beyond the opened ones, for the candidates that have any
    closed = ranked.filter("not opens").select(F.col("item").alias("a"), "basket")
    shared = skew.salted_join(candidates.filter(F.col("na") > opens).select("a", "b"), closed, "a", hot=skew.hot_keys(candidates, "a"), spread=["b"])
    more = shared.join(ranked.select(F.col("item").alias("b"), "basket"), ["b", "basket"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("d"))
    exact = candidates.join(more, ["a", "b"], "left").withColumn("n12", F.col("c") + F.coalesce("d", F.lit(0).cast("long")))
    exact = exact.filter((F.col("n12") >= least) & (F.col("n12") * den >= F.col("na") * num))
    swap = F.col("a") > F.col("b")
    return exact.select(
        F.least("a", "b").alias("word1_id"),
        F.greatest("a", "b").alias("word2_id"),
        F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("n1"),
        F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("n2"),
        "n12",
    )


def surprise(pairs: DataFrame, items: list[tuple[float, int]], baskets: list[tuple[float, int]]) -> DataFrame:
    """``pairs`` (as :func:`pair_counts` gives them) with ``expected`` shared baskets and ``log10_p`` under the fitted null."""
    if not items or not baskets:
        return pairs.withColumns({"expected": F.lit(0.0), "log10_p": F.lit(0.0)})
    degree, x, y, m = fit_null(items, baskets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                n1, n2, n12 = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                p = [np.interp(n, degree, x)[:, None] * y[None, :] for n in (n1, n2)]
                q = (p[0] / (1 + p[0])) * (p[1] / (1 + p[1]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((m * q).sum(1)), pa.array(log10_upper_tail(n12, q, m))], names=[*b.schema.names, "expected", "log10_p"])

    return pairs.mapInArrow(run, _PAIR + ", expected double, log10_p double")


def false_discovery_cut(scored: DataFrame, n_tests: int, rate: float = 0.05, step: float = 0.01) -> float:
    """The log10 p-value up to which pairs are significant at false-discovery rate ``rate`` (Benjamini-Hochberg over ``n_tests``).

    The p-values are counted on a grid of ``step`` in log10 (at most 32,000 cells),
    rounded up, so that the cut is never too generous.
    """
    cells = scored.groupBy(F.ceil(F.greatest(F.col("log10_p"), F.lit(-320.0)) / step).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
    cut, seen = -math.inf, 0
    for cell, n in sorted((r.cell, r.n) for r in cells):
        seen += n
        if cell * step <= math.log10(rate * seen / max(n_tests, 1)):
            cut = cell * step
    return cut


def _scored(rows: DataFrame, n_baskets: int, min_count: int, share: tuple[int, int], max_share: tuple[int, int], min_shared: int | None, counts: DataFrame) -> DataFrame:
    item_degrees = degree_histogram(counts, "n")
    basket_degrees = degree_histogram(rows.groupBy("basket").agg(F.count(F.lit(1)).alias("n")), "n")
    return surprise(pair_counts(rows, n_baskets, min_count, share, max_share, min_shared, counts), item_degrees, basket_degrees)


def _stable(rows: DataFrame) -> DataFrame:
    if "size" in rows.columns:
        return materialize(rows, "pairs-input")
    return materialize(rows.filter("basket is not null and item is not null").select("basket", "item").distinct(), "pairs-input")


def co_occurrence(rows: DataFrame, n_baskets: int, min_count: int = 7, share: tuple[int, int] = (3, 4), max_share: tuple[int, int] = (1, 5)) -> DataFrame:
    """(word1_id, word2_id, n1, n2, n12, expected, log10_p): :func:`pair_counts` and :func:`surprise` of (basket, item) ``rows``.

    Rows that carry the ``size`` of their basket (which only orders the baskets) are taken to be distinct and without nulls.
    """
    kept = _stable(rows)
    return _scored(kept, n_baskets, min_count, share, max_share, None, item_counts(kept))


def significant(rows: DataFrame, n_baskets: int, min_count: int = 7, share: tuple[int, int] = (3, 4), max_share: tuple[int, int] = (1, 5), rate: float = 0.05, min_shared: int | None = None) -> DataFrame:
    """:func:`co_occurrence` with ``significant``: whether the pair is among the discoveries at that false-discovery rate.

    The tests are all pairs of eligible items; pairs that can't reach the counts aren't discoveries, so the ranks are
    whole only with a share of 0 and ``min_shared`` 1 (pairs without a shared basket have p = 1).
    """
    kept = _stable(rows)
    counts = item_counts(kept)
    scored = materialize(_scored(kept, n_baskets, min_count, share, max_share, min_shared, counts), "pairs-scored")
    v = eligible(counts, n_baskets, min_count, max_share).count()
    return scored.withColumn("significant", F.col("log10_p") <= false_discovery_cut(scored, v * (v - 1) // 2, rate))
