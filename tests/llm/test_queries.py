"""The queries over the smallest tables: SQL where there is some, brute force elsewhere."""

import math
import os
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from spindrift.llm import encode, oracle, queries, terms

NAMES = sorted(oracle.oracle_sql())


@pytest.fixture(scope="module")
def sql(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, small, sql, name):
    df = queries.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*cols).collect())))
    cur = sql.execute(oracle.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall())


@pytest.fixture(scope="module")
def by_term(sql):
    """(page -> term -> frequency) over act pages, and every term."""
    words = sql.execute("SELECT word_id, word FROM keyword").fetchall()
    first: dict = {}
    for i, w in words:
        first[terms.normal_word(w)] = min(i, first.get(terms.normal_word(w), i))
    term = {i: first[terms.normal_word(w)] for i, w in words}
    out: dict = defaultdict(Counter)
    act = {r[0] for r in sql.execute(f"WITH {oracle.ACT} SELECT webpage_id FROM act").fetchall()}
    for p, w, f, _ in sql.execute(oracle.live("body_index")).fetchall():
        if p in act:
            out[p][term.get(w, w)] += f
    return out, set(term.values()), len(act)


def test_p1_brute_force(spark, small, sql, by_term):
    pages, _, n = by_term
    df = Counter(t for c in pages.values() for t in c)
    want = set()
    for (p,) in sql.execute("SELECT DISTINCT webpage_id FROM probe_page").fetchall():
        if pages[p]:
            length = sum(pages[p].values())
            want.add((p, min(pages[p], key=lambda t: (-(pages[p][t] / length * math.log((1 + n) / (1 + df[t]))), t))))
    assert {tuple(r) for r in queries.p1_found(spark, small).collect()} == want


def test_p6_brute_force(spark, small, by_term):
    pages, every, n = by_term
    df = Counter(t for c in pages.values() for t in c)
    want = {(t, "rare") for t in every if df[t] < 3} | {(t, "common") for t in every if df[t] >= 3 and 3 * df[t] >= n}
    assert {tuple(r) for r in queries.p6_found(spark, small).collect()} == want


def test_p7_p8_brute_force(spark, small, sql):
    tok = encode._tokenizer(encode.vocabulary())
    ids = {d: tok.encode(t or "", add_special_tokens=False).ids for d, t in sql.execute("SELECT doc_id, text FROM documents").fetchall()}
    assert {r.doc_id: r.ids for r in queries.p7_ids(spark, small).collect()} == ids
    assert sorted(r.doc_id for r in queries.p8_found(spark, small).collect()) == sorted(d for d, x in ids.items() if len(x) > 4096)
    fill = Counter()
    for r in queries.p8_assignment(spark, small).collect():
        fill[r.container] += r.n_tokens
    assert sum(fill.values()) == sum(map(len, ids.values())) and max(fill.values()) <= 4096


def test_p4_found_are_pairs_of_the_operator(spark, small):
    df = queries.p4_pairs(spark, small)
    assert {"expected", "log10_p", "significant"} <= set(df.columns)
    assert all(r.log10_p <= 0 and r.expected > 0 for r in df.collect())


def test_nothing_in_the_library_imports_this_package():
    root = os.path.dirname(os.path.dirname(queries.__file__))
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"spindrift\.llm|import llm", open(os.path.join(folder, f)).read()), f


