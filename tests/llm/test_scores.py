"""Distinctiveness, leximin and top-n against brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spindrift.llm import distinct, leximin, terms, topn


def test_terms_fold_spellings(spark):
    rows = [(5, "Café"), (3, "café"), (9, " CAFÉ "), (1, "a  b"), (2, "Ａ　b"), (4, None), (6, ""), (None, "z"), (3, "café")]
    got = {(r.word_id, r.term_id) for r in terms.spellings(spark.createDataFrame(rows, "word_id long, word string")).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (1, 1), (2, 1), (6, 6)}
    assert terms.spellings(spark.createDataFrame([], "word_id long, word string")).count() == 0


def test_one_term_with_most_spellings(spark):
    rows = [(i, "x" + " " * (i % 7) + "y") for i in range(1, 300)]
    got = terms.spellings(spark.createDataFrame(rows, "word_id long, word string")).collect()
    assert len(got) == 299 and {r.term_id for r in got if "x" in rows[r.word_id - 1][1] and r.word_id % 7} == {1}


def _records():
    r = random.Random(3)
    return [(rec, r.choice([1, 1, 1, 2, 3, r.randrange(4, 40)]), r.randrange(1, 5)) for rec in range(60) for _ in range(12)]


@pytest.mark.parametrize("hot", [None, [1], []])
def test_distinctiveness_matches_brute_force(spark, hot):
    rows = _records()
    pairs = distinct.per_record(spark.createDataFrame(rows, "record long, term long, frequency long"))
    got = {(r.record, r.term): r.score for r in distinct.distinctiveness(pairs, distinct.document_frequency(pairs), 60, hot).collect()}
    tf, length, df = Counter(), Counter(), Counter()
    for rec, t, f in rows:
        tf[rec, t] += f
        length[rec] += f
    for rec, t in tf:
        df[t] += 1
    want = {(rec, t): f / length[rec] * math.log((1 + 60) / (1 + df[t])) for (rec, t), f in tf.items()}
    assert got == pytest.approx(want)


def test_distinctiveness_of_common_and_rare(spark):
    rows = [(i, 1, 5) for i in range(9)] + [(0, 2, 5)]
    pairs = distinct.per_record(spark.createDataFrame(rows, "record long, term long, frequency long"))
    got = {(r.record, r.term): r.score for r in distinct.distinctiveness(pairs, distinct.document_frequency(pairs), 9).collect()}
    assert got[0, 1] == 0 and got[0, 2] == max(got.values())


def test_distinctiveness_leaves_out_nulls_and_zeros(spark):
    rows = [(None, 1, 1), (1, None, 1), (1, 1, None), (1, 1, 0), (1, 2, 3), (1, 2, 1)]
    pairs = distinct.per_record(spark.createDataFrame(rows, "record long, term long, frequency long"))
    assert [tuple(r) for r in pairs.collect()] == [(1, 2, 4)]
    assert distinct.distinctiveness(pairs.limit(0), distinct.document_frequency(pairs.limit(0)), 0).count() == 0


def _items():
    r = random.Random(5)
    return [(q, i, r.choice([None, r.randrange(4) * 1.0, r.random() * 1e6]), r.choice([None, r.random()]), r.randrange(3) / 2) for q in (1, 2) for i in range(40)] + [(3, 7, None, None, None)]


SCHEMA = "q long, i long, a double, b double, c double"


def _leximin(rows):
    out = {}
    for q in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == q]
        low = lambda v: -math.inf if v is None or v != v else v
        vec = {x[1]: sorted(sum(low(y[k]) < low(x[k]) for y in own) / max(len(own) - 1, 1) for k in (2, 3, 4)) for x in own}
        out[q] = sorted(vec, key=lambda i: ([-v for v in vec[i]], i))
    return out


@pytest.mark.parametrize("n", [1, 6])
def test_leximin_order(spark, n):
    df = leximin.leximin(spark.createDataFrame(_items(), SCHEMA).repartition(3), "q", "i", ["a", "b", "c"], n)
    got = defaultdict(list)
    for r in topn.top_n(df, ["q"], leximin.order(3, "i"), 100, rank="nth").orderBy("q", "nth").collect():
        got[r.q].append(r.i)
    assert dict(got) == _leximin(_items())


def test_leximin_hides_no_weak_score(spark):
    rows = [(1, 1, 1e9, 0.1, 0.1), (1, 2, 5.0, 0.5, 0.5), (1, 3, 1.0, 0.2, 0.05)]
    r = {x.i: x.v0 for x in leximin.leximin(spark.createDataFrame(rows, SCHEMA), "q", "i", ["a", "b", "c"]).collect()}
    assert r[2] > r[1] > r[3] or r[2] > r[1] == r[3]


def test_leximin_nan_repeats_nulls_empty(spark):
    rows = [(1, 1, float("nan"), 1.0, 1.0), (1, 1, 2.0, 0.5, 1.0), (1, 2, 1.0, 0.7, None), (None, 3, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0)]
    got = {r.i: (r.p_a, r.p_b, r.p_c) for r in leximin.percentiles(spark.createDataFrame(rows, SCHEMA), "q", "i", ["a", "b", "c"]).collect()}
    assert got == {1: (1.0, 1.0, 1.0), 2: (0.0, 0.0, 0.0)}
    assert leximin.percentiles(spark.createDataFrame([], SCHEMA), "q", "i", ["a", "b", "c"]).count() == 0


@pytest.mark.parametrize("block, heap", [(262_144, 1_048_576), (50, 20)])
def test_top_n_matches_brute_force(spark, block, heap):
    r = random.Random(9)
    rows = [(r.choice([1, 1, 1, 2, None, r.randrange(50)]), r.choice([None, r.randrange(6)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, s long, i long").repartition(6)
    got = defaultdict(list)
    for x in topn.top_n(df, ["g"], [("s", "desc"), ("i", "asc")], 5, "nth", block, heap).orderBy("nth").collect():
        got[x.g].append(x.i)
    by = defaultdict(list)
    for g, s, i in rows:
        by[g].append((s is None, -(s or 0), i))
    assert dict(got) == {g: [i for _, _, i in sorted(v)[:5]] for g, v in by.items()}


def test_top_n_sends_at_most_n_rows_a_task(spark):
    df = spark.range(0, 20_000, 1, 4).withColumn("g", F.lit(1))
    parts = df.mapInArrow(topn._heaps(["g"], [("id", "descending")], 3, 1000, 100_000), df.schema)
    assert parts.count() <= 12


def test_top_n_nan_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, float("nan"), "x"), (1, 2.0, "y"), (1, 1.0, "z")], "g long, s double, rank string")
    assert [r.rank for r in topn.top_n(df, ["g"], [("s", "desc")], 2).orderBy("s").collect()] == ["z", "y"]
    assert topn.top_n(df.limit(0), ["g"], [("s", "desc")], 2).count() == 0
