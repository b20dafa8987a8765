"""Frequency of every term of a collection, and in how many records it occurs.

1. ``dictionary`` gives every term a dense integer id (0, 1, 2 ...) in the order
   of the terms' own ids.
2. The records' terms are encoded with it.
3. Each task accumulates count arrays for blocks of BLOCK neighbouring ids, one
   for occurrences and one for record presence, and passes on each block once
   (its non-zero cells, or the whole array where it is dense).
4. The blocks are shuffled by id range and the arrays of a block summed.

Rows must be distinct in (record, term) for presence to count records; use
``distinct.per_record``.  Terms that no record has come out with zeros.  Null
ids are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift import skew

#: Ids in a block, and blocks a task holds before it passes them on (2 x 8 bytes a cell: 256 MB at most).
BLOCK = 4096
MAX_BLOCKS = 4096

_PART = "block long, idx binary, occurrences binary, records binary"


def dictionary(terms: DataFrame) -> DataFrame:
    """(term, id) with dense ids in ascending order of term; exact for any number of terms (range-partitioned)."""
    distinct = terms.filter("term is not null").select("term").distinct()
    return skew.range_rank(distinct, [], ["term"], label="dictionary").select("term", (F.col("position") - 1).alias("id"))


def _accumulate(block: int, max_blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        arrays: dict[int, tuple] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for k, (occ, rec) in arrays.items():
                at = np.flatnonzero(rec)
                rows.append((k, at.astype(np.int32).tobytes(), occ[at].tobytes(), rec[at].tobytes()))
            arrays.clear()
            for i in range(0, len(rows), 512):
                cols = list(zip(*rows[i : i + 512]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["block", "idx", "occurrences", "records"])

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            freq = b.column(1).to_numpy(zero_copy_only=False)
            where = np.argsort(ids, kind="stable")
            ids, freq = ids[where], freq[where]
            blocks = ids // block
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
                if lo == hi:
                    continue
                k = int(blocks[lo])
                if k not in arrays:
                    arrays[k] = (np.zeros(block, np.int64), np.zeros(block, np.int64))
                at = ids[lo:hi] - k * block
                np.add.at(arrays[k][0], at, freq[lo:hi])
                np.add.at(arrays[k][1], at, 1)
            if len(arrays) > max_blocks:
                yield from flush()
        yield from flush()

    return run


def _sum_blocks(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def out(k: int, occ: "np.ndarray", rec: "np.ndarray") -> pa.RecordBatch:
            at = np.flatnonzero(rec)
            return pa.RecordBatch.from_arrays([pa.array(at + k * block, pa.int64()), pa.array(occ[at]), pa.array(rec[at])], names=["id", "occurrences", "records"])

        now, occ, rec = None, None, None
        for b in batches:
            for k, i, o, r in zip(*[c.to_pylist() for c in b.columns]):
                if k != now:
                    if now is not None:
                        yield out(now, occ, rec)
                    now, occ, rec = k, np.zeros(block, np.int64), np.zeros(block, np.int64)
                at = np.frombuffer(i, np.int32)
                occ[at] += np.frombuffer(o, np.int64)
                rec[at] += np.frombuffer(r, np.int64)
        if now is not None:
            yield out(now, occ, rec)

    return run


def count_arrays(encoded: DataFrame, block: int = BLOCK, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(id, occurrences, records) of (id, frequency) rows, one row per record and id."""
    parts = encoded.select(F.col("id").cast("long"), F.col("frequency").cast("long")).mapInArrow(_accumulate(block, max_blocks), _PART)
    by_range = parts.repartition("block").sortWithinPartitions("block")
    return by_range.mapInArrow(_sum_blocks(block), "id long, occurrences long, records long")


def with_counts(ids: DataFrame, counted: DataFrame) -> DataFrame:
    """(term, occurrences, records) of every term of a dictionary, zeros where nothing was counted."""
    zero = F.lit(0).cast("long")
    return ids.join(counted, "id", "left").select("term", F.coalesce("occurrences", zero).alias("occurrences"), F.coalesce("records", zero).alias("records"))


def frequencies(pairs: DataFrame, terms: DataFrame, block: int = BLOCK) -> DataFrame:
    """(term, occurrences, records) of every term of ``terms`` over ``pairs`` (record, term, frequency)."""
    ids = dictionary(terms)
    encoded = skew.salted_join(pairs, ids, "term", hot=skew.hot_keys(pairs, "term"), spread=["record"]).select("id", "frequency")
    return with_counts(ids, count_arrays(encoded, block))


def marks(counts: DataFrame, n_records: int, rare_below: int = 3, common_share: tuple[int, int] = (1, 3)) -> DataFrame:
    """``counts`` with ``mark``: rare (in fewer than ``rare_below`` records), common (in at least the share of all records), else null.

    A term that is both is marked rare.
    """
    num, den = common_share
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * den >= F.lit(num * n_records), "common")
    return counts.withColumn("mark", mark)
