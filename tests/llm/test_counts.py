"""Term frequencies by blocks, and pairs that occur together, against brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from spindrift.llm import frequency, pairs


@pytest.mark.parametrize("block, max_blocks", [(4096, 4096), (8, 2)])
def test_count_arrays(spark, block, max_blocks):
    r = random.Random(2)
    rows = [(r.choice([3, 3, 3, r.randrange(200)]), r.randrange(1, 9)) for _ in range(4000)]
    got = {x.id: (x.occurrences, x.records) for x in frequency.count_arrays(spark.createDataFrame(rows, "id long, frequency long").repartition(4), block, max_blocks).collect()}
    occ, rec = Counter(), Counter()
    for i, f in rows:
        occ[i] += f
        rec[i] += 1
    assert got == {i: (occ[i], rec[i]) for i in occ}


def test_frequencies_and_marks(spark):
    p = spark.createDataFrame([(r, 10, 2) for r in range(6)] + [(0, 20, 5), (1, 20, 1), (2, 20, 1), (0, 30, 1), (0, 99, 1)], "record long, term long, frequency long")
    t = spark.createDataFrame([(10,), (20,), (30,), (40,), (40,), (None,)], "term long")
    got = {r.term: (r.occurrences, r.records, r["mark"]) for r in frequency.marks(frequency.frequencies(p, t), 9, 3, (1, 2)).collect()}
    assert got == {10: (12, 6, "common"), 20: (7, 3, None), 30: (1, 1, "rare"), 40: (0, 0, "rare")}
    assert frequency.frequencies(p.limit(0), t.limit(0)).count() == 0


def _baskets(seed=4):
    r = random.Random(seed)
    rows = set()
    for b in range(120):
        for i in range(12):
            if r.random() < 0.15:
                rows.add((b, i))
        if r.random() < 0.12:
            rows |= {(b, 50), (b, 51)} if r.random() < 0.9 else {(b, 50)}
        if b % 10 == 0:
            rows |= {(b, 60), (b, 61), (b, 62)}
    rows |= {(7, i) for i in range(200, 700)}  # one very large basket
    rows |= {(b, 999) for b in range(100)}  # one item of most baskets
    return sorted(rows)


def _brute(rows, n, least, share, most):
    by, of = {}, {}
    for b, i in rows:
        by.setdefault(b, set()).add(i)
        of.setdefault(i, set()).add(b)
    ok = {i for i, s in of.items() if len(s) >= least and len(s) * most[1] <= n * most[0]}
    out = {}
    for x, y in itertools.combinations(sorted(ok), 2):
        n12 = len(of[x] & of[y])
        if n12 >= least and n12 * share[1] >= share[0] * min(len(of[x]), len(of[y])):
            out[x, y] = (len(of[x]), len(of[y]), n12)
    return out


@pytest.mark.parametrize("least, share, most", [(3, (3, 4), (1, 5)), (7, (3, 4), (1, 5)), (3, (1, 2), (1, 2)), (2, (9, 10), (1, 1))])
def test_pair_counts_lose_no_pair(spark, least, share, most):
    rows = _baskets()
    df = spark.createDataFrame(rows, "basket long, item long").repartition(3)
    got = {(r.word1_id, r.word2_id): (r.n1, r.n2, r.n12) for r in pairs.co_occurrence(df, 120, least, share, most).collect()}
    want = _brute(rows, 120, least, share, most)
    assert got == want and want


def test_pair_counts_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([(None, 1), (1, None)], "basket long, item long")
    assert pairs.co_occurrence(df, 5).count() == 0


def _exact_tail(k, q, m):
    dist = np.array([1.0])
    for p, n in zip(q, m):
        for _ in range(int(n)):
            dist = np.convolve(dist, [1 - p, p])
    return dist[int(k) :].sum()


@pytest.mark.parametrize("q, m, ks", [([0.01, 0.1, 0.4], [200, 60, 8], [14, 18, 25, 33]), ([0.001], [500], [2, 4, 7]), ([0.3], [20], [8, 12, 17, 20])])
def test_tail_is_close_to_the_exact_one(q, m, ks):
    k = np.array(ks, float)
    got = pairs.log10_upper_tail(k, np.tile(q, (len(ks), 1)), np.array(m, float))
    want = np.log10([_exact_tail(x, q, m) for x in ks])
    assert np.abs(got - want).max() < 0.06


def test_counts_at_or_below_the_mean_are_no_surprise():
    assert pairs.log10_upper_tail(np.array([0.0, 2.0, 5.0]), np.full((3, 1), 0.5), np.array([10.0])).tolist()[:2] == [0.0, 0.0]


def test_null_meets_frequencies_and_sizes():
    items, baskets = [(3.0, 40), (10.0, 5), (60.0, 1)], [(1.0, 30), (2.0, 40), (12.0, 10)]
    assert sum(d * m for d, m in items) == sum(d * m for d, m in baskets)
    degree, x, y, m = pairs.fit_null(items, baskets)
    p = x[:, None] * y / (1 + x[:, None] * y)
    assert np.allclose((p * m).sum(1), degree, rtol=1e-4)
    assert np.allclose((p * np.array([t[1] for t in items])[:, None]).sum(0), [t[0] for t in baskets], rtol=1e-4)


def test_false_discovery_cut(spark):
    p = [-9.0, -6.0, -4.0, -2.0, -1.0]
    df = spark.createDataFrame([(v,) for v in p], "log10_p double")
    cut = pairs.false_discovery_cut(df, 1000)
    assert sum(v <= cut for v in p) == 3  # 1e-4 <= 0.05 * 3 / 1000, but 1e-2 > 0.05 * 4 / 1000
    assert pairs.false_discovery_cut(df.limit(0), 0) == -np.inf


def test_p4_pairs_has_every_pair_of_supported_words(spark, monkeypatch):
    from spindrift.llm import queries

    rows = _baskets()
    # words 9001 and 9002 share half of their pages, far above chance; 9003 is on more than a fifth of all
    rows = rows + [(b, 9001) for b in range(20)] + [(b, 9002) for b in range(10, 30)] + [(b, 9003) for b in range(60)]
    df = spark.createDataFrame(rows, "basket long, item long").repartition(3)
    monkeypatch.setattr(queries, "_baskets", lambda *_: df)
    monkeypatch.setattr(queries, "_n_act", lambda *_: 120)
    got = {(r.word1_id, r.word2_id): r for r in queries.p4_pairs(spark, "").collect()}
    of = {}
    for b, i in set(rows):
        if b is not None and i is not None:
            of.setdefault(i, set()).add(b)
    of = {i: b for i, b in of.items() if len(b) >= 7}
    want = {(i, j): (len(of[i]), len(of[j]), len(of[i] & of[j])) for i in of for j in of if i < j and of[i] & of[j]}
    assert {k: (r.n1, r.n2, r.n12) for k, r in got.items()} == want
    assert got[9001, 9002].n12 == 10 and got[9001, 9003].n12 == 20


def _upper_tail(k: int, q: list) -> float:
    """P(X >= k) of a sum of independent Bernoulli variables, term by term."""
    p = [1.0]
    for x in q:
        p = [(p[i] if i < len(p) else 0) * (1 - x) + (p[i - 1] * x if i else 0) for i in range(len(p) + 1)]
    return sum(p[k:])


def test_p4_pairs_against_term_by_term_tails_and_step_up(spark, small):
    """Every pair of words on 7 act pages or more: exact counts, exact Poisson-binomial tails, and the step-up rule over all tests."""
    import math
    from collections import Counter
    from itertools import combinations

    from spindrift.llm import pairs, queries

    base = [(r.basket, r.item) for r in queries._baskets(spark, small).collect()]
    by, n_of, size = {}, Counter(), Counter()
    for b, i in base:
        by.setdefault(b, set()).add(i)
        n_of[i] += 1
        size[b] += 1
    kept = {i for i, n in n_of.items() if n >= 7}
    both = Counter(p for words in by.values() for p in combinations(sorted(words & kept), 2))
    degree, x, y, m = pairs.fit_null(sorted(Counter(n_of.values()).items()), sorted(Counter(size.values()).items()))
    xs = {int(d): v for d, v in zip(degree, x)}
    got = {(r.word1_id, r.word2_id): r for r in queries.p4_pairs(spark, small).collect()}
    assert {k: r.n12 for k, r in got.items()} == dict(both) and len(both) > 1000
    # the tails of a spread of pairs, the most and the least surprising among them
    order = sorted(got, key=lambda k: got[k].log10_p)
    for k in order[:60] + order[:: max(1, len(order) // 200)]:
        r = got[k]
        q = [u * v for u, v in zip(*[[xs[n] * yy / (1 + xs[n] * yy) for yy, c in zip(y, m) for _ in range(int(c))] for n in (r.n1, r.n2)])]
        assert r.expected == pytest.approx(sum(q), rel=1e-4, abs=1e-6)
        exact = math.log10(max(_upper_tail(r.n12, q), 1e-300))
        if r.n12 > sum(q) + 0.5:
            assert r.log10_p == pytest.approx(exact, abs=0.06 + 0.02 * abs(exact))
        else:
            assert exact > math.log10(0.2)
    tests = len(kept) * (len(kept) - 1) // 2
    cut = max([p for i, p in enumerate(sorted(r.log10_p for r in got.values()), 1) if p <= math.log10(0.05 * i / tests)], default=-math.inf)
    # the operator counts on a grid of a hundredth, rounded so that it is never too generous
    for r in got.values():
        assert not r.significant or r.log10_p <= cut
        assert r.significant or r.log10_p > cut - 0.02
