"""Values of all word pairs that share a page, each complete in one task, so that no pair is ever shuffled.

A page's strong words are one list, in the order of how many lists have a word
(ties: the id).  The earlier, rarer word of a pair owns it.  Owners are spread by
hash, and a task gets, of every page, the list from its first owner on: what is
sent grows with the postings and not with the pairs.  Whatever the pages have of
an owner's pairs is then in its task, where a pair's minima are added up (or the
highest taken) and valued in blocks.

Words that hold much of all strong rows (``skew.hot_keys``) own nothing: of
pairs of two such words there are few, which are counted in part by page and
then by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift import skew
from spindrift.config import DEFAULT, Config
from spindrift.session import materialize, shuffle_partitions
from spindrift.tables import ByPage

_PAIR = "word1_id long, word2_id long, pmi double"
#: Pairs of a block, which is at least one owner; a column of it stays in a core's cache.
_BLOCK = 1 << 16
#: Words up to which pairs are filtered without a shuffle; a row is an id, and pairs are far more than rows elsewhere.
_MARKED = 1_000_000
#: Rows of an Arrow batch that goes back.
_ROWS = 1 << 16


def _rounded(x: np.ndarray) -> np.ndarray:
    """To nine digits."""
    return np.floor(x * 1e9 + 0.5) / 1e9


@dataclass
class Rule:
    """How pairs are valued: ``n`` the summed frequency and ``weights`` the weight of each field (none: one field as it is), values above ``above``; the minima of a pair's pages are added up if ``summed``."""

    n: list[int]
    above: float
    summed: bool
    weights: list[float] | None = None

    def values(self, field: int, m: np.ndarray, t1: np.ndarray, t2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions above the threshold, their values)."""
        q = m.astype(np.float64) * float(self.n[field]) / (t1 * t2)
        at = np.flatnonzero(q > 10.0**self.above * (1 - 1e-6))
        v = _rounded(np.log10(q[at]))
        kept = v > self.above
        return at[kept], v[kept]


@dataclass
class Strong:
    """The strong postings (field number, webpage_id, word_id, f, total, lists, salt) and how their pairs are valued."""

    rows: DataFrame
    rule: Rule
    has_hot: bool
    tasks: int


def strong(postings: DataFrame | ByPage, fields: Sequence[str], summed: bool, cfg: Config = DEFAULT, weights: Sequence[float] | None = None) -> Strong:
    """``postings`` of act pages, live; ``total`` is a word's summed frequency in the field, above the field's threshold.

    A table of them is read twice; of those that lie by page, which are a plan, all is made in one pass.
    """
    above = {"title": cfg.title_frequency_above, "body": cfg.body_frequency_above}
    own = [F.col("field") == f for f in fields]
    sums = [F.coalesce(F.sum(F.when(o, F.col("frequency"))), F.lit(0)).alias(f"n{i}") for i, o in enumerate(own)]
    kept, number = F.lit(False), F.lit(None).cast("int")
    for i, (f, o) in enumerate(zip(fields, own)):
        kept, number = kept | (o & (F.col("frequency") > above[f])), F.when(o, F.lit(i)).otherwise(number)
    row = [number.alias("of"), "webpage_id", "word_id", F.col("frequency").alias("f")]
    # few rows are above the threshold; they are read for the totals and for the lists
    if isinstance(postings, ByPage):
        by_page = postings.rows.groupBy(*postings.keys).agg(*sums, F.collect_list(F.when(kept, F.struct(*row))).alias("rows"))
        by_page = materialize(by_page.drop(*postings.keys), "strong")
        n = by_page.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(len(fields))]).first()
        frequent = by_page.select(F.inline("rows"))
    else:
        n = postings.agg(*sums).first()
        frequent = materialize(postings.filter(kept).select(*row), "strong")
    spark = frequent.sparkSession
    words = frequent.groupBy("word_id").agg(F.count(F.lit(1)).alias("lists"), *[F.sum(F.when(F.col("of") == i, F.col("f"))).alias(f"t{i}") for i in range(len(fields))])
    hot, tasks = skew.hot_keys(frequent, "word_id"), shuffle_partitions(spark)
    total, salt = F.col("t0"), F.pmod(F.xxhash64("word_id"), F.lit(tasks)).cast("int")
    for i in range(1, len(fields)):
        total = F.when(F.col("of") == i, F.col(f"t{i}")).otherwise(total)
    if hot:
        salt = F.when(F.col("word_id").isin(list(hot)), F.lit(-1)).otherwise(salt)
    rows = skew.lookup_join(frequent, words, "word_id", hot_in=frequent, spread=["webpage_id"]).select("of", "webpage_id", "word_id", "f", total.alias("total"), "lists", salt.alias("salt"))
    rule = Rule([int(x) for x in n], cfg.pmi_above, summed, list(weights) if weights else None)
    return Strong(materialize(rows, "strong-totals"), rule, bool(hot), tasks)


def _lists(s: Strong, marks: DataFrame | None = None, default: float = 0.0, marked: bool = False) -> DataFrame:
    """(of, l): a page's strong words in order; ``marks`` (word_id, x) gives each word a number; ``marked``: only lists that have one above 0."""
    rows = s.rows.withColumn("x", F.lit(0.0))
    if marks is not None:
        rows = skew.lookup_join(s.rows, marks, "word_id", "left", hot_in=s.rows, spread=["webpage_id"]).withColumn("x", F.coalesce("x", F.lit(default)))
    each = F.sort_array(F.collect_list(F.struct("lists", "word_id", "f", "total", "salt", "x")))
    lists = rows.groupBy("of", "webpage_id").agg(each.alias("l"), F.max("x").alias("x")).filter(F.size("l") > 1)
    return materialize((lists.filter("x > 0") if marked else lists).select("of", "l"), "lists")


def _sent(s: Strong, lists: DataFrame) -> DataFrame:
    """(s, of, l): for every task that has an owner on the page, the list from its first owner on."""
    owners = F.filter(F.array_distinct(F.slice(F.col("l.salt"), F.lit(1), F.size("l") - 1)), lambda x: x >= 0)
    each = lists.select("of", "l", F.explode(owners).alias("s"))
    at = F.array_position(F.col("l.salt"), F.col("s")).cast("int")
    return each.select("s", "of", F.slice("l", at, F.size("l")).alias("l")).repartitionById(s.tasks, "s")


class _Task:
    """What a task holds: flat columns over all its lists."""

    def __init__(self, batches: Iterator[pa.RecordBatch], owned: Callable[[np.ndarray, np.ndarray], np.ndarray], marked: bool = False) -> None:
        """``marked``: only the pairs of which a word has a mark above 0 are made."""
        cols: dict[str, list] = {k: [] for k in ("word_id", "f", "total", "x", "own", "of", "size")}
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(2)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            for k in ("word_id", "f", "total", "x"):
                cols[k].append(flat.field(k).to_numpy(zero_copy_only=False))
            cols["own"].append(owned(flat.field("salt").to_numpy(zero_copy_only=False), np.repeat(b.column(0).to_numpy(zero_copy_only=False), size)))
            cols["of"].append(np.repeat(b.column(1).to_numpy(zero_copy_only=False), size))
            cols["size"].append(size)
        c = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in cols.items()}
        self.words, self.code = np.unique(c["word_id"], return_inverse=True)
        self.f, self.of, own = c["f"], c["of"], c["own"]
        end = np.repeat(np.cumsum(c["size"]), c["size"])
        self.x = np.zeros(len(self.words))
        self.x[self.code] = c["x"]
        self.fields = int(self.of.max()) + 1 if len(self.of) else 0
        self.total = np.zeros((self.fields, len(self.words)))
        self.total[self.of, self.code] = c["total"]
        # an owner's others are those of self.others from begin to end: all that follow it on its list, or those with a mark
        self.others, self.begin, self.end = None, np.arange(1, len(own) + 1), end
        if marked:
            with_mark = np.flatnonzero(c["x"] > 0)
            self.others = np.concatenate([np.arange(len(own)), with_mark])
            none = c["x"] <= 0
            self.begin[none] = len(own) + np.searchsorted(with_mark, self.begin[none])
            self.end = np.where(none, len(own) + np.searchsorted(with_mark, end), end)
        at = np.flatnonzero(own.astype(bool) & (self.begin < self.end))
        times = np.bincount(self.code[at], minlength=len(self.words))
        # owners of one list first, as their pairs need no adding up
        self.at = at[np.lexsort((self.code[at], times[self.code[at]] > 1))]
        self.several = times > 1

    def blocks(self) -> Iterator[tuple[np.ndarray, bool]]:
        """(positions of owners, whether any has several lists); all of an owner's are in one block."""
        if not len(self.at):
            return
        pairs = np.cumsum(self.end[self.at] - self.begin[self.at])
        code = self.code[self.at]
        ends = np.append(np.flatnonzero(np.diff(code)) + 1, len(code))
        begin = 0
        while begin < len(code):
            limit = np.searchsorted(pairs, (pairs[begin - 1] if begin else 0) + _BLOCK, side="right")
            k = np.searchsorted(ends, limit, side="right") - 1
            stop = int(ends[k]) if k >= 0 and ends[k] > begin else int(ends[np.searchsorted(ends, begin, side="right")])
            yield self.at[begin:stop], bool(self.several[code[stop - 1]])
            begin = stop

    def minima(self, at: np.ndarray, several: bool, summed: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(field, owner, other, m) of each pair of a block, by field; words as codes."""
        size = self.end[at] - self.begin[at]
        first = np.cumsum(size) - size
        other = np.arange(int(size.sum())) + np.repeat(self.begin[at] - first, size)
        other = other if self.others is None else self.others[other]
        a, b = np.repeat(self.code[at], size), self.code[other]
        m = np.minimum(np.repeat(self.f[at], size), self.f[other])
        of = self.of[other] if self.fields > 1 else None
        for k in range(self.fields):
            x, y, z = (a, b, m) if of is None else (w[of == k] for w in (a, b, m))
            if several and len(x):
                key = x * len(self.words) + y
                order = np.argsort(key)
                key = key[order]
                starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
                z = (np.add if summed else np.maximum).reduceat(z[order], starts)
                x, y = key[starts] // len(self.words), key[starts] % len(self.words)
            if len(x):
                yield k, x, y, z

    def valued(self, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(owner, other, value) of all pairs above the threshold, by blocks; words as codes."""
        for at, several in self.blocks():
            parts = []
            for k, a, b, m in self.minima(at, several, rule.summed):
                kept, v = rule.values(k, m, self.total[k, a], self.total[k, b])
                parts.append((a[kept], b[kept], v * rule.weights[k] if rule.weights else v))
            if not parts:
                continue
            a, b, v = (np.concatenate(c) for c in zip(*parts)) if len(parts) > 1 else parts[0]
            if rule.weights and len(v):
                if several and len(parts) > 1:
                    key, of = np.unique(a * len(self.words) + b, return_inverse=True)
                    a, b, v = key // len(self.words), key % len(self.words), np.bincount(of, v)
                v = _rounded(v)
            yield a, b, v


def _batches(*cols: np.ndarray, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(cols[0]), _ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + _ROWS]) for c in cols], names=list(names))


def _own(salt: np.ndarray, task: np.ndarray) -> np.ndarray:
    return salt == task


def _kept_pairs(rule: Rule, keep: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None, marked: bool = False):
    """``keep`` is asked with the marks of both words and the value; if ``marked``, only pairs with a marked word are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _Task(batches, _own, marked)
        for a, b, v in t.valued(rule):
            if keep is not None:
                k = keep(t.x[a], t.x[b], v)
                a, b, v = a[k], b[k], v[k]
            # codes are in the order of the ids
            yield from _batches(t.words[np.minimum(a, b)], t.words[np.maximum(a, b)], v, names=("word1_id", "word2_id", "pmi"))

    return run


def _highest(rule: Rule, n: int):
    """The ``n`` highest distinct values of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(0)
        for _, _, v in _Task(batches, _own).valued(rule):
            if len(best) == n:
                v = v[v > best[0]]
            best = np.unique(np.append(best, v))[-n:]
        yield from _batches(best, names=("pmi",))

    return run


def _highest_by_word(rule: Rule, n: int):
    """The ``n`` highest distinct values of each word, among a task's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _Task(batches, _own)
        best = np.full((n, len(t.words)), -np.inf)
        for a, b, v in t.valued(rule):
            for word in (a, b):
                new = v > best[n - 1, word]
                w, x = word[new], v[new]
                for k in range(n - 1):
                    new = x != best[k, w]
                    w, x = w[new], x[new]
                if not len(w):
                    continue
                some = np.unique(w)
                w = np.concatenate([w, np.tile(some, n)])
                x = np.concatenate([x, best[:, some].ravel()])
                order = np.lexsort((-x, w))
                w, x = w[order], x[order]
                there = np.isfinite(x) & np.append(True, (np.diff(w) != 0) | (x[1:] != x[:-1]))
                w, x = w[there], x[there]
                rank = np.arange(len(w)) - np.maximum.accumulate(np.where(np.diff(w, prepend=-1) != 0, np.arange(len(w)), 0))
                w, x, rank = w[rank < n], x[rank < n], rank[rank < n]
                best[rank, w] = x
        rank, word = np.nonzero(np.isfinite(best))
        yield from _batches(t.words[word], best[rank, word], names=("word_id", "pmi"))

    return run


def _partial_minima(summed: bool):
    """(of, word1_id, word2_id, m, total1, total2) of all pairs in the lists of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            t = _Task(iter([whole]), lambda salt, _: np.ones(len(salt), bool))
            for at, several in t.blocks():
                for k, a, b, m in t.minima(at, several, summed):
                    a, b = np.minimum(a, b), np.maximum(a, b)
                    of = np.full(len(a), k, np.int32)
                    totals = (t.total[k, c].astype(np.int64) for c in (a, b))
                    yield from _batches(of, t.words[a], t.words[b], m, *totals, names=("of", "word1_id", "word2_id", "m", "total1", "total2"))

    return run


def _value_rows(rule: Rule):
    """From (word1_id, word2_id, and m, total1, total2 of each field) to pairs with their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value, found = np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            for k in range(len(rule.n)):
                m, t1, t2 = (np.nan_to_num(b.column(2 + 3 * k + j).to_numpy(zero_copy_only=False).astype(np.float64)) for j in range(3))
                there = np.flatnonzero(m > 0)
                at, v = rule.values(k, m[there], t1[there], t2[there])
                value[there[at]] += v * rule.weights[k] if rule.weights else v
                found[there[at]] = True
            words = (b.column(j).to_numpy(zero_copy_only=False)[found] for j in range(2))
            yield from _batches(*words, _rounded(value[found]) if rule.weights else value[found], names=("word1_id", "word2_id", "pmi"))

    return run


def _hot_values(s: Strong, lists: DataFrame) -> DataFrame | None:
    """(word1_id, word2_id, pmi) of the pairs of two hot words, written."""
    if not s.has_hot:
        return None
    hot = lists.select(F.lit(-1).alias("s"), "of", F.filter("l", lambda x: x["salt"] == -1).alias("l")).filter(F.size("l") > 1)
    parts = hot.mapInArrow(_partial_minima(s.rule.summed), "of int, word1_id long, word2_id long, m long, total1 long, total2 long")
    cols = []
    for k in range(len(s.rule.n)):
        own = lambda c, k=k: F.when(F.col("of") == k, F.col(c))
        cols += [(F.sum if s.rule.summed else F.max)(own("m")).alias(f"m{k}"), F.max(own("total1")).alias(f"a{k}"), F.max(own("total2")).alias(f"b{k}")]
    return materialize(parts.groupBy("word1_id", "word2_id").agg(*cols).mapInArrow(_value_rows(s.rule), _PAIR), "hot-pairs")


def all_values(s: Strong) -> DataFrame:
    """(word1_id, word2_id, pmi) of all pairs above the threshold, one row a pair."""
    lists = _lists(s)
    hot = _hot_values(s, lists)
    out = _sent(s, lists).mapInArrow(_kept_pairs(s.rule), _PAIR)
    return out if hot is None else out.unionByName(hot)


def values_touching(s: Strong, words: DataFrame) -> DataFrame:
    """As :func:`all_values`, of the pairs that have one of ``words`` (word_id); no others are made."""
    marks = materialize(words.select("word_id").distinct().withColumn("x", F.lit(1.0)), "marks")
    lists = _lists(s, marks, marked=True)
    hot = _hot_values(s, lists)  # of these, the touched ones are whole
    out = _sent(s, lists).mapInArrow(_kept_pairs(s.rule, marked=True), _PAIR)
    return out if hot is None else out.unionByName(touching(hot, marks))


def values_without(s: Strong, words: DataFrame) -> DataFrame:
    """As :func:`all_values`, of the pairs that have none of ``words`` (word_id), which are taken from the lists before."""
    words = words.select("word_id").distinct()
    return all_values(replace(s, rows=skew.lookup_join(s.rows, words, "word_id", "left_anti", hot_in=s.rows, spread=["webpage_id"])))


def touching(pairs: DataFrame, words: DataFrame, either: bool = True) -> DataFrame:
    """The pairs that have one of ``words`` (word_id), or if not ``either``, none; up to ``_MARKED`` counted words are broadcast."""
    for side, other in (("word1_id", "word2_id"), ("word2_id", "word1_id")):
        mark = words.select(F.col("word_id").alias(side)).distinct().withColumn(f"__{side}", F.lit(True))
        pairs = skew.lookup_join(pairs, mark, side, "left", hot_in=pairs, spread=[other], max_rows=_MARKED)
    there = F.coalesce("__word1_id", F.lit(False)) | F.coalesce("__word2_id", F.lit(False))
    return pairs.filter(there if either else ~there).select("word1_id", "word2_id", "pmi")


def highest(s: Strong, n: int) -> DataFrame:
    """The pairs whose value is among the ``n`` highest distinct values of all: those values first, then their pairs."""
    lists = _lists(s)
    hot = _hot_values(s, lists)
    best = _sent(s, lists).mapInArrow(_highest(s.rule, n), "pmi double")
    best = best if hot is None else best.unionByName(hot.select("pmi"))
    least = min((r.pmi for r in best.distinct().orderBy(F.desc("pmi")).limit(n).collect()), default=float("inf"))
    out = _sent(s, lists).mapInArrow(_kept_pairs(s.rule, lambda a, b, v: v >= least), _PAIR)
    return out if hot is None else out.unionByName(hot.filter(F.col("pmi") >= least))


def highest_per_word(s: Strong, n: int) -> DataFrame:
    """The pairs that are among the ``n`` highest distinct values of either word: each word's least such value first, then the pairs."""
    lists = _lists(s)
    hot = _hot_values(s, lists)
    best = _sent(s, lists).mapInArrow(_highest_by_word(s.rule, n), "word_id long, pmi double")
    if hot is not None:
        best = best.unionByName(hot.select(F.explode(F.array("word1_id", "word2_id")).alias("word_id"), "pmi"))
    least = F.element_at(F.slice(F.sort_array(F.collect_set("pmi"), False), 1, n), -1)
    marks = materialize(best.groupBy("word_id").agg(least.alias("x")), "least")
    out = _sent(s, _lists(s, marks, float("inf"))).mapInArrow(_kept_pairs(s.rule, lambda a, b, v: (v >= a) | (v >= b)), _PAIR)
    if hot is None:
        return out
    for side, other in (("word1_id", "word2_id"), ("word2_id", "word1_id")):
        hot = skew.lookup_join(hot, marks.select(F.col("word_id").alias(side), F.col("x").alias(f"__{side}")), side, spread=[other])
    return out.unionByName(hot.filter((F.col("pmi") >= F.col("__word1_id")) | (F.col("pmi") >= F.col("__word2_id"))).select("word1_id", "word2_id", "pmi"))
