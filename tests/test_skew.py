"""Skewed keys: hot keys, salted joins, range aggregation and ranking against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spindrift import skew


def _rows(n=3000, seed=1):
    """One key has a third of the rows, all copies of one row; null keys; ties."""
    r = random.Random(seed)
    rows = [(7, 1)] * (n // 3)
    rows += [(r.choice([1, 2, 2, 2, None]), r.randrange(20)) for _ in range(n // 3)]
    rows += [(100 + i % 500, r.randrange(5)) for i in range(n // 3)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(_rows(), "k long, o long").repartition(5)


def test_hot_keys_are_those_above_the_share(df):
    c = Counter(k for k, _ in _rows())
    want = {k for k, n in c.items() if k is not None and n >= 3000 / 20}
    assert set(skew.hot_keys(df, "k", 1 / 20)) == want


def test_hot_keys_of_nothing(spark):
    assert skew.hot_keys(spark.createDataFrame([], "k long"), "k") == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_plain_join(spark, df, how):
    right = spark.createDataFrame([(7, "a"), (7, "b"), (2, "c"), (100, "d"), (9999, "e")], "k long, v string")
    hot = skew.hot_keys(df, "k", 1 / 20)
    assert hot
    got = skew.salted_join(df, right, "k", how, hot, ["o"])
    want = df.join(right, "k", how)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


@pytest.mark.parametrize("max_rows", [10_000, 1])
def test_lookup_join_broadcast_and_shuffled_agree(spark, df, max_rows):
    d = spark.createDataFrame([(7, "x"), (2, "y"), (100, "z")], "k long, v string")
    got = skew.lookup_join(df, d, "k", "left", spread=["o"], max_rows=max_rows)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, df.join(d, "k", "left").collect()))


def test_range_aggregate_matches_group_by(df):
    got = skew.range_aggregate(df, "k", ["o"], [F.count(F.lit(1)).alias("n"), F.sum("o").alias("s")], n=7).collect()
    n, s = Counter(), Counter()
    for k, o in _rows():
        n[k] += 1
        s[k] += o
    assert {(r.k, r.n, r.s) for r in got} == {(k, n[k], s[k]) for k in n} and len(got) == len(n)


def test_range_split_spreads_a_key_of_copies(spark):
    d = spark.createDataFrame([(7, 1)] * 4000, "k long, o long").repartition(8)
    sizes = [r.c for r in skew.range_split(d, "k", ["o"], 4).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("c")).collect()]
    assert len(sizes) > 1 and max(sizes) < 4000


def test_heavy_keys(df):
    got = {(r.k, r.n_rows) for r in skew.heavy_keys(df, "k", ["o"], 1 / 10).collect()}
    c = Counter(k for k, _ in _rows())
    assert got == {(k, n) for k, n in c.items() if k is not None and n >= 300}


def test_heavy_keys_of_nothing(spark):
    assert skew.heavy_keys(spark.createDataFrame([], "k long, o long"), "k", ["o"], 0.1).count() == 0


@pytest.mark.parametrize("n", [1, 3, 11])
def test_range_rank_positions_and_ranks(df, n):
    got = skew.range_rank(df, ["k"], ["o"], n=n).collect()
    by = defaultdict(list)
    for k, o in _rows():
        by[k].append(o)
    seen = defaultdict(list)
    for r in got:
        below = sum(x < r.o for x in by[r.k])
        assert r["rank"] == below + 1
        seen[r.k].append((r.position, r.o))
    for k, rows in seen.items():
        rows.sort()
        assert [p for p, _ in rows] == list(range(1, len(by[k]) + 1))
        assert [o for _, o in rows] == sorted(by[k])


def test_range_rank_without_keys_numbers_the_table(spark):
    d = spark.createDataFrame([(f"w{i:03}",) for i in range(257)], "w string").repartition(6)
    got = {r.w: r.position for r in skew.range_rank(d, [], ["w"], n=5).collect()}
    assert got == {f"w{i:03}": i + 1 for i in range(257)}


def test_range_rank_nulls_first_and_empty(spark):
    d = spark.createDataFrame([(1, None), (1, 2.0), (1, None), (1, 1.0)], "k long, v double")
    got = sorted((r.v is not None, r.v or 0, r["rank"]) for r in skew.range_rank(d, ["k"], ["v"], n=2).collect())
    assert got == [(False, 0, 1), (False, 0, 1), (True, 1.0, 3), (True, 2.0, 4)]
    assert skew.range_rank(d.limit(0), ["k"], ["v"]).count() == 0


def test_extra_columns_with_clashing_names_survive(spark):
    d = spark.createDataFrame([(1, 5, "a"), (1, 4, "b")], "k long, o long, n_rows string")
    got = {(r.k, r.o, r.n_rows, r.position) for r in skew.range_rank(d, ["k"], ["o"]).collect()}
    assert got == {(1, 4, "b", 1), (1, 5, "a", 2)}


def test_range_rank_splits_ties(spark):
    """One key, nine tenths of the values missing: no task gets more than twice the mean, and ranks are carried over the borders."""
    n = 200_000
    d = spark.range(n).select(F.lit(1).alias("k"), F.col("id"), F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).alias("v"))
    got = skew.range_rank(d, ["k"], ["v"], n=8).cache()
    parts = [r.c for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("c")).collect()]
    nulls = n - n // 10
    assert got.count() == n and got.select("position").distinct().count() == n and got.agg(F.max("position")).first()[0] == n
    assert {r[0] for r in got.filter("v is null").select("rank").distinct().collect()} == {1}
    assert got.filter(f"v is not null and rank <> {nulls} + v / 10 + 1").count() == 0
    local = d.withColumn("__split", F.xxhash64("k", "id", "v")).repartitionByRange(8, "k", "v", "__split")
    sizes = [r.c for r in local.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("c")).collect()]
    assert max(sizes) < 2 * n / 8 and len(parts) >= 1


@pytest.mark.parametrize("n", [1, 4, 9])
def test_range_rank_of_long_ties_nan_and_several_keys(spark, n):
    r = random.Random(4)
    rows = [(r.choice([None, 1, 1, 1, 2]), r.choice([None, None, float("nan"), 0.0, -0.0, 1.5]), i) for i in range(900)]
    d = spark.createDataFrame(rows, "k long, v double, i long").repartition(3)
    at = lambda v: (0, 0) if v is None else (2, 0) if v != v else (1, v)
    seen = defaultdict(list)
    for x in skew.range_rank(d, ["k"], ["v"], n=n).collect():
        own = [at(v) for k, v, _ in rows if k == x.k]
        assert x["rank"] == sum(o < at(x.v) for o in own) + 1
        seen[x.k].append(x.position)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in seen.values())


def test_salts_follow_the_share(spark):
    d = spark.createDataFrame([(1,)] * 600 + [(2,)] * 300 + [(i,) for i in range(10, 110)], "k long")
    hot = skew.hot_keys(d, "k", 1 / 20)
    assert list(hot) == [1, 2] and hot.salts[1] >= hot.salts[2] >= 2
