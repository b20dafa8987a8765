"""Keys that hold most of the rows: per-key results without a few giant tasks.

``range_aggregate``  per-key aggregates: range partitioning on the composite
    (key, secondary order) with sampled quantiles, so that a heavy key spans
    many partitions; each partition forms partial states, which are stitched
    by key.
``range_rank``       position of every row within its key, under any skew of keys
    or of tied values: the same partitioning, local positions, and for each
    partition's first key an offset, and for its first tie a rank, carried over
    from the partitions before.
``hot_keys``         the keys that hold at least a given share of all rows; at
    most 1/share keys can, which bounds what comes to the driver.
``salted_join``      equi-join that spreads only those keys over several tasks.
``lookup_join``      join with a dictionary: broadcast behind a counted bound,
    beyond it a salted join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.session import BROADCAST_ROWS, broadcast_if_small, materialize, shuffle_partitions

#: Share of all rows from which a key counts as hot in a join, and the tasks it is then spread over.
HOT_SHARE = 1 / 64
SALTS = 16


def key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


class HotKeys(list):
    """Keys that hold much of a table, and over how many tasks the rows of each are to be spread (``salts``)."""

    def __init__(self, counts: dict | None = None, total: int = 0, tasks: int = 1) -> None:
        super().__init__(counts or ())
        # a task then gets about one task's share of all rows
        self.salts = {k: max(2, -(-n * tasks // max(total, 1))) for k, n in (counts or {}).items()}


#: Most keys that are treated as hot, whatever the number of tasks.
MOST_HOT = 1024


def hot_keys(df: DataFrame, key: str, share: float | None = None) -> HotKeys:
    """Values of ``key`` (nulls excluded) that hold at least ``share`` of the rows of ``df``; never more than 1/share values.

    By default a key is hot from twice a task's share on (at most HOT_SHARE, at least 1/MOST_HOT).
    One pass over one column, the total being a row of the same aggregation; ``df`` should be a table, not a long plan.
    """
    tasks = shuffle_partitions(df.sparkSession)
    share = share or max(1 / MOST_HOT, min(HOT_SHARE, 2 / tasks))
    counts = df.select(key).rollup(key).agg(F.count(F.lit(1)).alias("n_rows"), F.grouping(key).alias("total"))
    top = counts.filter((F.col("total") == 1) | F.col(key).isNotNull()).orderBy(F.desc("total"), F.desc("n_rows"), key).limit(int(1 / share) + 2).collect()
    if not top or not top[0].n_rows:
        return HotKeys()
    total = top[0].n_rows
    return HotKeys({r[0]: r.n_rows for r in top[1:] if r.n_rows >= total * share}, total, tasks)


def _salts(hot: Sequence) -> dict:
    return hot.salts if isinstance(hot, HotKeys) else dict.fromkeys(hot, SALTS)


def salt(hot: Sequence, key: str, spread: Sequence[str]) -> Column:
    """The task number among those of its key for a row of a hot key, 0 for all others."""
    out: Column | None = None
    by_salts: dict[int, list] = {}
    for k, n in _salts(hot).items():
        by_salts.setdefault(n, []).append(k)
    for n, keys in sorted(by_salts.items()):
        value = F.pmod(F.xxhash64(*spread), F.lit(n)).cast("int")
        out = F.when(F.col(key).isin(keys), value) if out is None else out.when(F.col(key).isin(keys), value)
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def repeated(right: DataFrame, hot: Sequence, key: str, name: str = "__salt") -> DataFrame:
    """``right`` with a row for each task of a hot key."""
    out: Column | None = None
    by_salts: dict[int, list] = {}
    for k, n in _salts(hot).items():
        by_salts.setdefault(n, []).append(k)
    for n, keys in sorted(by_salts.items()):
        value = F.sequence(F.lit(0), F.lit(n - 1))
        out = F.when(F.col(key).isin(keys), value) if out is None else out.when(F.col(key).isin(keys), value)
    one = F.array(F.lit(0))
    return right.withColumn(name, F.explode(one if out is None else out.otherwise(one)))


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: Sequence = (), spread: Sequence[str] = ()) -> DataFrame:
    """``left`` joined with ``right`` on ``key``; rows of ``left`` with a key in ``hot`` are spread by the hash of ``spread``.

    ``right`` is repeated for the hot keys only.  ``how`` is inner, left,
    left_semi or left_anti (each row of ``left`` meets all its
    partners in exactly one task, so these keep their meaning).  The result
    has the columns of ``left``, then the other columns of ``right``.
    """
    if not hot:
        return left.join(right.hint("shuffle_hash"), key, how)
    l = left.withColumn("__salt", salt(hot, key, spread))
    return l.join(repeated(right, hot, key).hint("shuffle_hash"), [key, "__salt"], how).drop("__salt")


def lookup_join(left: DataFrame, dictionary: DataFrame, key: str, how: str = "inner", hot_in: DataFrame | None = None, spread: Sequence[str] = (), max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``left`` joined with a dictionary that has one row per ``key``.

    Up to ``max_rows`` counted rows the dictionary is broadcast and ``left`` isn't
    shuffled; beyond, the keys that are hot in ``hot_in`` are salted.
    """
    side, small = broadcast_if_small(dictionary, max_rows)
    if small:
        return left.join(side, key, how)
    return salted_join(left, dictionary, key, how, hot_keys(hot_in if hot_in is not None else left, key), spread)


def range_split(df: DataFrame, key: str, order: Sequence[str], n: int | None = None) -> DataFrame:
    """``df`` range-partitioned on (key, order, split read), so that even a key whose rows are all copies of one row is split."""
    n = n or shuffle_partitions(df.sparkSession)
    return df.withColumn("__split", F.spark_partition_id()).repartitionByRange(n, key, *order, "__split").drop("__split")


def range_aggregate(df: DataFrame, key: str, order: Sequence[str], aggs: Sequence[Column], n: int | None = None) -> DataFrame:
    """One row per ``key`` with the aggregates ``aggs`` (any that Spark can compute partially).

    Plan: range exchange on (key, order) by sampled quantiles; partial
    aggregation inside each range partition; exchange of the partial states
    (one per key and partition it touches); final merge.  No task receives
    more than a range partition's share of rows, whatever the key distribution.
    A null key is a key of its own.  An empty input gives an empty result.
    """
    return range_split(df.select(key, *[c for c in df.columns if c != key]), key, order, n).groupBy(key).agg(*aggs)


def heavy_keys(df: DataFrame, key: str, order: Sequence[str], share: float, n: int | None = None) -> DataFrame:
    """(key, n_rows, share) of the keys that hold at least ``share`` of all rows of ``df`` (nulls count as rows, but are no key)."""
    total = df.count()
    counts = range_aggregate(df.select(key, *order), key, order, [F.count(F.lit(1)).alias("n_rows")], n)
    return counts.filter(F.col(key).isNotNull() & (F.col("n_rows") >= F.lit(total * share))).withColumn("share", F.col("n_rows") / F.lit(max(total, 1)))


def _changes(columns: list[pa.ChunkedArray | pa.Array], before: list | None) -> "list[bool]":
    """For each row whether any of the columns differs from the row before (``before``: the last row of the batch before)."""
    import numpy as np

    n = len(columns[0])
    out = np.zeros(n, dtype=bool)
    for i, c in enumerate(columns):
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        if n > 1:
            a, b = c[1:], c[:-1]
            d = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            if pa.types.is_floating(c.type):
                d = d & ~(pc.fill_null(pc.is_nan(a), False).to_numpy(zero_copy_only=False) & pc.fill_null(pc.is_nan(b), False).to_numpy(zero_copy_only=False))
            out[1:] |= d | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
        out[0] |= before is None or not _same(c[0].as_py(), before[i])
    return out


def _same(a: object, b: object) -> bool:
    return a == b or (a is None and b is None) or (a != a and b != b)


def _positions(keys: Sequence[str], order: Sequence[str]):
    """Arrow iterator that adds, to a sorted partition, each row's position and competition rank within its key.

    ``__head`` is 2 for the rows of the partition's first tie, 1 for the other rows of its first key, 0 for the rest.  The
    first and the last row come once more, with ``__mark`` 1 and 2, for the carry from partition to partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        last_key: list | None = None
        last_all: list | None = None
        pos, rank, head = 0, 0, 2
        end: pa.RecordBatch | None = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            kcols = [b.column(b.schema.get_field_index(k)) for k in keys]
            ocols = [b.column(b.schema.get_field_index(o)) for o in order]
            new_key = _changes(kcols, last_key) if kcols else np.array([last_all is None] + [False] * (n - 1))
            new_all = new_key | _changes(ocols, last_all[len(kcols) :] if last_all else None)
            idx = np.arange(n)
            starts = np.maximum.accumulate(np.where(new_key, idx, -1))
            position = np.where(starts >= 0, idx - starts + 1, idx + 1 + pos).astype(np.int64)
            tie = np.maximum.accumulate(np.where(new_all, idx, -1))
            ranks = np.where(tie >= 0, position[np.maximum(tie, 0)], rank).astype(np.int64)
            opening = int(last_all is None)
            heads = np.where(np.cumsum(new_key) > opening, 0, np.where(np.cumsum(new_all) > opening, 1, 2))
            heads = np.minimum(heads, head).astype(np.int8)
            pos, rank, head = int(position[-1]), int(ranks[-1]), int(heads[-1])
            made = pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(position), pa.array(ranks), pa.array(heads), pa.array(np.zeros(n, np.int8))], names=[*b.schema.names, "__pos", "__rank", "__head", "__mark"]
            )
            if last_all is None:
                yield _marked(made.slice(0, 1), 1)
            last_key = [c[n - 1].as_py() for c in kcols]
            last_all = last_key + [c[n - 1].as_py() for c in ocols]
            yield made
            end = made.slice(n - 1)
        if end is not None:
            yield _marked(end, 2)

    return run


def _marked(b: pa.RecordBatch, mark: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([mark] * b.num_rows, pa.int8())], names=b.schema.names)


def _carried(ends: Sequence, n_keys: int) -> list[tuple[int, int, int | None]]:
    """(partition, offset of its first key, rank of its first tie or null) where something is carried; ``ends`` are its marked rows in order."""
    out = []
    key: tuple | None = None
    tie: tuple | None = None
    held, tied = 0, 0
    equal = lambda a, b: a is not None and b is not None and all(map(_same, a, b))
    for part, first, last in ends:
        k, o = first[:n_keys], first[n_keys:-2]
        off = held if equal(k, key) else 0
        rank = tied if off and equal(o, tie) else None
        if off:
            out.append((part, off, rank))
        one_key, one_tie = last[-2][0] > 0, last[-2][0] == 2
        held = last[-2][1] + (off if one_key else 0)
        tied = rank if one_tie and rank is not None else last[-1] + (off if one_key else 0)
        key, tie = last[:n_keys], last[n_keys:-2]
    return out


def range_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int | None = None, position: str = "position", rank: str = "rank", label: str = "rank") -> DataFrame:
    """``df`` with each row's position (1, 2, ...) and competition rank (ties share the first position) within ``keys``, ascending in ``order``.

    Nulls come first, NaN last.  Without keys the whole table is one key.  Rows
    are range-partitioned on (keys, order, a hash of the row), so that neither a
    key nor a tie needs to fit into one task; every partition numbers its own
    rows, and what the partitions before hold of its first key and of its first
    tie is carried over.  Two rows per partition come to the driver for that,
    and at most one row per partition is broadcast.
    Rows equal in keys and order share a rank and have positions in no defined order.
    """
    spark = df.sparkSession
    n = n or shuffle_partitions(spark)
    by = [*keys, *order]
    extra = [("__pos", T.LongType()), ("__rank", T.LongType()), ("__head", T.ByteType()), ("__mark", T.ByteType())]
    schema = T.StructType([*df.schema.fields, *[T.StructField(name, kind) for name, kind in extra]])
    split = F.xxhash64(*[f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()], F.spark_partition_id())
    local = df.withColumn("__split", split).repartitionByRange(n, *by, "__split").drop("__split").sortWithinPartitions(*by).mapInArrow(_positions(keys, order), schema)
    kept = materialize(local.withColumn("__part", F.spark_partition_id()), label)
    marks = kept.filter("__mark > 0").select("__part", "__mark", "__head", "__pos", "__rank", *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]).orderBy("__part", "__mark").collect()
    ends: dict[int, list[tuple]] = {}
    for r in marks:
        ends.setdefault(r[0], []).append((*r[5:], (r[2], r[3]), r[4]))
    carried = _carried([(p, v[0], v[1]) for p, v in ends.items()], len(keys))
    out = kept.filter("__mark = 0")
    if not carried:
        return out.select(*df.columns, F.col("__pos").alias(position), F.col("__rank").alias(rank))
    offsets = spark.createDataFrame(carried, "__part int, __off long, __tie long")
    out = out.join(F.broadcast(offsets), "__part", "left").withColumn("__add", F.when(F.col("__head") > 0, F.coalesce("__off", F.lit(0))).otherwise(F.lit(0)))
    ranked = F.when(F.col("__head") == 2, F.coalesce("__tie", F.col("__rank") + F.col("__add"))).otherwise(F.col("__rank") + F.col("__add"))
    return out.select(*df.columns, (F.col("__pos") + F.col("__add")).alias(position), ranked.alias(rank))


def key_positions(df: DataFrame, key: str, order: Sequence[str], n: int | None = None) -> DataFrame:
    """``df`` with ``position`` within ``key`` in ascending ``order``; see :func:`range_rank`."""
    return range_rank(df, [key], order, n).drop("rank")
