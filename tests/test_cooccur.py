"""Pairs of words against brute force: none is shuffled or written, whatever pages, hot words and fields there are."""

import math
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spindrift import session, skew
from spindrift.config import DEFAULT
from spindrift.operators import cooccur, pmi
from spindrift.tables import ByPage

ABOVE = {"title": DEFAULT.title_frequency_above, "body": DEFAULT.body_frequency_above}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = [(1, "body", w, r.randint(2, 9)) for w in range(1, 120)]
    for page in range(2, 150):
        for field in ("title", "body"):
            words = {1000 + int(r.paretovariate(0.5)) % 40 for _ in range(r.randint(0, 7))} | {2000 + r.randrange(60)}
            out += [(page, field, w, r.randint(1, 12)) for w in words]
    return out


@pytest.fixture(scope="module")
def posts(spark, rows):
    return spark.createDataFrame(rows, "webpage_id long, field string, word_id long, frequency long").cache()


def brute(rows, field, summed):
    own = [x for x in rows if x[1] == field]
    n = sum(x[3] for x in own)
    total, pages, m = defaultdict(int), defaultdict(list), defaultdict(list)
    for page, _, w, f in own:
        if f > ABOVE[field]:
            total[w] += f
            pages[page].append((w, f))
    for words in pages.values():
        for a, f in words:
            for b, g in words:
                if a < b:
                    m[a, b].append(min(f, g))
    v = {(a, b): round(math.log10((sum(x) if summed else max(x)) * n / (total[a] * total[b])), 9) for (a, b), x in m.items()}
    return {k: x for k, x in v.items() if x > DEFAULT.pmi_above}


def got(df):
    found = [((r.word1_id, r.word2_id), r.pmi) for r in df.collect()]
    assert len(found) == len(dict(found))
    return dict(found)


def near(a, b):
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) < 3e-9 for k in a)


def top_per_word(v, n=5):
    of = defaultdict(set)
    for (a, b), x in v.items():
        of[a].add(x)
        of[b].add(x)
    least = {w: sorted(x)[-n:][0] for w, x in of.items()}
    return {k: x for k, x in v.items() if x >= least[k[0]] or x >= least[k[1]]}


@pytest.mark.parametrize("field", ["title", "body"])
def test_values_are_those_of_brute_force(posts, rows, field):
    assert skew.hot_keys(posts, "word_id")
    assert near(got(pmi.page_values(posts, field)), brute(rows, field, False))
    assert near(got(pmi.pair_values(posts, field)), brute(rows, field, True))


def test_both_fields_at_once(posts, rows):
    want = defaultdict(float)
    for field, w in (("title", DEFAULT.pmi_title_weight), ("body", DEFAULT.pmi_body_weight)):
        for k, x in brute(rows, field, True).items():
            want[k] += w * x
    assert near(got(pmi.combined_pair_values(posts)), want)


def test_tops(posts, rows):
    v = brute(rows, "body", False)
    best = sorted(set(v.values()))[-5:]
    assert near(got(pmi.page_values_top(posts, "body")), {k: x for k, x in v.items() if x in best})
    assert near(got(pmi.pair_values_top(posts, "body")), top_per_word(brute(rows, "body", True)))


def test_small_blocks_and_batches(posts, rows, monkeypatch):
    s = cooccur.strong(posts, ["body"], True)
    lists = cooccur._lists(s).orderBy("l").collect()
    task = cooccur._Task(iter(posts.sparkSession.createDataFrame(lists, "of int, l array<struct<lists:long,word_id:long,f:long,total:long,salt:int,x:double>>").select(F.lit(0).alias("s"), "of", "l").toArrow().to_batches()), lambda salt, _: salt >= 0)
    whole = sorted((int(x), int(y), float(z)) for a, b, v in task.valued(s.rule) for x, y, z in zip(a, b, v))
    monkeypatch.setattr(cooccur, "_BLOCK", 1)
    assert whole and whole == sorted((int(x), int(y), float(z)) for a, b, v in task.valued(s.rule) for x, y, z in zip(a, b, v))


def test_touching_and_refresh(spark, posts, rows):
    v = brute(rows, "body", False)
    words = spark.createDataFrame([(1005,), (2003,), (7,)], "word_id long")
    w = {1005, 2003, 7}
    touched = {k: x for k, x in v.items() if w & {*k}}
    assert touched and near(got(pmi.page_values(posts, "body", touching=words)), touched)
    affected = w | {i for k in touched for i in k}
    stored = pmi.page_values(posts, "body").withColumn("pmi", F.col("pmi") + 1)
    fresh = lambda touching=None: pmi.page_values(posts, "body", touching=touching)
    want = {k: x if affected & {*k} else x + 1 for k, x in v.items()}
    assert near(got(pmi.refresh(stored, fresh, words, fresh(words))), want)
    assert near(got(pmi.refresh(stored, fresh(), words)), want)


def test_dictionaries_too_large_to_broadcast(spark, posts, rows, monkeypatch):
    monkeypatch.setattr(skew, "broadcast_if_small", lambda df, most=0: (df, False))
    assert near(got(pmi.pair_values_top(posts, "body")), top_per_word(brute(rows, "body", True)))
    words = spark.createDataFrame([(1005,), (2003,), (7,)], "word_id long")
    v = brute(rows, "body", False)
    rest, affected = pmi.delete_words(pmi.page_values(posts, "body"), words)
    touched = {k for k in v if {1005, 2003, 7} & {*k}}
    assert got(rest).keys() == v.keys() - touched and {r.word_id for r in affected.collect()} == {i for k in touched for i in k}


@pytest.mark.parametrize("name", ["q_pmi_top_per_term", "q_pmi_body", "q_pmi_combined", "q_pmi_delete_affected", "q_pmi_refresh"])
def test_no_exchange_or_scratch_table_has_the_pairs(spark, small, name):
    """What is written between is lists of words and marks, and no pair is in an exchange."""
    import __spark_entry__ as entry

    since = len(session._paths)
    df = entry.queries()[name](spark, small)
    labels = {os.path.basename(p).rsplit("-", 1)[0] for _, p in session._paths[since:]}
    assert labels <= {f"spindrift-{x}" for x in ("strong", "strong-totals", "lists", "marks", "least", "affected", "hot-pairs")}
    plan = df._jdf.queryExecution().executedPlan().toString()
    above = [line for line in plan.split("== Initial Plan ==")[0].split("\n") if "Exchange" in line and "Broadcast" not in line]
    assert all("pmi" not in line for line in above)
    assert "MapInArrow" in plan


def test_the_table_per_word_is_not_written(spark, small):
    import __spark_entry__ as entry

    entry.queries()["q_pmi_expand"](spark, small).collect()
    assert not [x for x in os.listdir(session.shared_dir(spark)) if x.startswith("spindrift-pmi-body-")]


def test_rows_by_page_give_the_same(posts, rows):
    salted = posts.withColumn("__salt", F.pmod("word_id", F.lit(3)))
    for by_page in (ByPage(posts, ["webpage_id"]), ByPage(salted, ["webpage_id", "__salt"])):
        assert near(got(pmi.page_values(by_page, "body")), brute(rows, "body", False))
    none = ByPage(posts.filter("frequency < 0"), ["webpage_id"])
    assert got(pmi.page_values(none, "body")) == {}


@pytest.mark.parametrize("name", ["q_pmi_body", "q_pmi_delete_affected", "q_pmi_refresh"])
def test_body_pairs_need_no_index(spark, small, name, monkeypatch):
    """The index of all fields is not built, and the body's rows are read once however many calls need them."""
    import __spark_entry__ as entry
    from spindrift.plans import payloads, queries

    for module in (queries, payloads):
        monkeypatch.setattr(module, "_index", lambda *_: pytest.fail("the index is built"))
    since = len(session._paths)
    assert entry.queries()[name](spark, small).count()
    labels = [os.path.basename(p).rsplit("-", 1)[0] for _, p in session._paths[since:]]
    assert labels.count("spindrift-strong") == labels.count("spindrift-strong-totals") == 1


def test_stored_pairs_as_a_function(spark, posts, rows):
    """Those that stay are made without the words and the new ones with them alone, from postings read once."""
    v, w = brute(rows, "body", False), {1005, 2003, 7}
    words = spark.createDataFrame([(x,) for x in w], "word_id long")
    s = pmi.page_strong(posts, "body")
    fresh = lambda touching: pmi.page_values(s, "body", touching=touching)
    stored = lambda without: pmi.page_values(s, "body", without=without).withColumn("pmi", F.col("pmi") + 1)
    affected = w | {i for k in v if w & {*k} for i in k}
    assert near(got(pmi.refresh(stored, fresh, words, fresh(words))), {k: x if affected & {*k} else x + 1 for k, x in v.items()})
    rest, changed = pmi.delete_words(lambda x: pmi.page_values(s, "body", without=x), words, fresh(words))
    assert near(got(rest), {k: x for k, x in v.items() if not w & {*k}})
    assert {r.word_id for r in changed.collect()} == {i for k in v if w & {*k} for i in k}


def test_only_marked_pairs_are_made(posts):
    s = cooccur.strong(posts, ["body"], False)
    marks = posts.sparkSession.createDataFrame([(w, 1.0) for w in (7, 1005, 2003)], "word_id long, x double")
    batches = cooccur._lists(s, marks, marked=True).select(F.lit(0).alias("s"), "of", "l").toArrow().to_batches()
    made = {}
    for marked in (False, True):
        t = cooccur._Task(iter(batches), lambda salt, _: salt >= -1, marked)
        pairs = [(t.words[a], t.words[b], int(z)) for at, several in t.blocks() for _, x, y, m in t.minima(at, several, False) for a, b, z in zip(x, y, m)]
        assert len(pairs) == len(set(pairs))
        made[marked] = set(pairs)
    assert made[True] == {p for p in made[False] if {7, 1005, 2003} & {*p[:2]}} and len(made[True]) < len(made[False])
