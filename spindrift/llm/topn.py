"""The N best items of every group, as a mergeable aggregation with at most N items per group.

Before the shuffle, each task keeps, for every group it meets, the N best items
seen so far (a bounded heap per group, held in one sorted Arrow table and
refilled block by block); only those travel.  After the shuffle, the parts of a
group are merged by the same order.  A group of any size sends at most N rows
per task.

Order: the given columns one after the other, each ascending or descending;
the last should be a unique identifier, so that ties fall the same way in every
run.  Nulls come last in either direction; a NaN in an order column counts and
comes out as null.  Rows with a null group form a group.
Rows equal in group and order columns are interchangeable and may both be kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows gathered before the kept rows are cut down again, and kept rows from which a task passes its heaps on and starts anew.
BLOCK_ROWS = 262_144
HEAP_ROWS = 1_048_576


def _keep(t: pa.Table, groups: Sequence[str], order: Sequence[tuple[str, str]], n: int) -> pa.Table:
    import numpy as np

    nulls = [(f"__null_{c}", "ascending") for c, _ in order if t.column(c).null_count]
    s = t
    for c, _ in order:
        if t.column(c).null_count:
            s = s.append_column(f"__null_{c}", pc.cast(pc.is_null(t.column(c)), pa.int8()))
    keys: list[tuple[str, str]] = [(g, "ascending") for g in groups]
    for c, d in order:
        keys += [k for k in nulls if k[0] == f"__null_{c}"] + [(c, d)]
    s = t.take(pc.sort_indices(s, sort_keys=keys))
    m = s.num_rows
    new = np.zeros(m, dtype=bool)
    new[:1] = True
    for g in groups:
        c = s.column(g).combine_chunks()
        a, b = c[1:], c[:-1]
        new[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new[1:] |= a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False)
    idx = np.arange(m)
    nth = idx - np.maximum.accumulate(np.where(new, idx, 0))
    return s.filter(pa.array(nth < n))


def _heaps(groups: Sequence[str], order: Sequence[tuple[str, str]], n: int, block: int, heap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        fresh: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            fresh.append(b)
            rows += b.num_rows
            if rows >= block:
                t = pa.Table.from_batches(fresh)
                kept = _keep(t if kept is None else pa.concat_tables([kept, t]), groups, order, n)
                fresh, rows = [], 0
                if kept.num_rows > heap:
                    yield from kept.combine_chunks().to_batches(max_chunksize=65536)
                    kept = None
        if fresh or kept is not None:
            parts = ([kept] if kept is not None else []) + ([pa.Table.from_batches(fresh)] if fresh else [])
            yield from _keep(pa.concat_tables(parts), groups, order, n).combine_chunks().to_batches(max_chunksize=65536)

    return run


def top_n(df: DataFrame, groups: Sequence[str], order: Sequence[tuple[str, str]], n: int, rank: str | None = None, block: int = BLOCK_ROWS, heap: int = HEAP_ROWS) -> DataFrame:
    """The first ``n`` rows of each group by ``order`` ((column, "asc" | "desc") ...), all columns of ``df`` kept; ``rank`` names a column for 1..n."""
    full = [(c, "ascending" if d == "asc" else "descending") for c, d in order]
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")} & {c for c, _ in order}
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df
    parts = df.mapInArrow(_heaps(groups, full, n, block, heap), df.schema)
    w = Window.partitionBy(*groups).orderBy(*[F.asc_nulls_last(c) if d == "asc" else F.desc_nulls_last(c) for c, d in order])
    out = parts.withColumn("__nth", F.row_number().over(w)).filter(F.col("__nth") <= n)
    return out.withColumnRenamed("__nth", rank) if rank else out.drop("__nth")
