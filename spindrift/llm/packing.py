"""Filling containers of a fixed capacity with items of varying size.

Bounded-space online packing: a task holds at most OPEN open containers.  Each
item goes into the open container it fills best (least room left); where it fits
into none, the fullest open container is closed and a new one opened.  At
the end of the tasks their open containers are merged in rounds, until one task
has met all that are left: in each round the leftovers of up to MERGE tasks meet
in one and are packed, whole containers being the items, best-fit, fullest
first, of which the OPEN emptiest stay open for the next.

An item larger than the capacity is cut into full containers and a rest, which
is packed like an item; no other item is cut.  Items of size 0, of null size
or of null id take no room and are left out.  Extra columns aren't carried along; join
by id.  Container ids are strings, unique within one run.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.session import materialize

CAPACITY = 4096
OPEN = 64
MERGE = 64

_NAMES = ["item", "part", "start", "size", "container", "open"]


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows))
    types = [kind, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=_NAMES)


def _pack(capacity: int, most_open: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        room: list[tuple[int, int]] = []  # (room left, container), ascending
        held: dict[int, list[tuple]] = {}
        n, kind, out = 0, pa.int64(), []

        def close(c: int) -> None:
            out.extend((i, p, s, z, f"{here}-{c}", False) for i, p, s, z in held.pop(c))

        for b in batches:
            kind = b.schema.field(0).type
            for item, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                start, part = 0, 0
                while size - start > capacity or (size - start == capacity):
                    out.append((item, part, start, capacity, f"{here}-{n}", False))
                    n, start, part = n + 1, start + capacity, part + 1
                size -= start
                if not size:
                    continue
                at = bisect_left(room, (size, -1))
                if at < len(room):
                    left, c = room.pop(at)
                else:
                    if len(room) == most_open:
                        close(room.pop(0)[1])
                    left, c, n = capacity, n, n + 1
                    held[c] = []
                held[c].append((item, part, start, size))
                if left == size:
                    close(c)
                else:
                    insort(room, (left - size, c))
            if len(out) > 50_000:
                yield _batch(out, kind)
                out.clear()
        for c, rows in held.items():
            out.extend((i, p, s, z, f"{here}-{c}", True) for i, p, s, z in rows)
        if out:
            yield _batch(out, kind)

    return run


def _merge(capacity: int, most_open: int):
    """Packs the open containers of the task together, best-fit, fullest first; the ``most_open`` emptiest stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        held: dict[str, list[tuple]] = {}
        kind = pa.int64()
        for b in batches:
            kind = b.schema.field(0).type
            shut = b.filter(pc.invert(b.column(5)))
            if shut.num_rows:
                yield shut
            for r in zip(*[c.to_pylist() for c in b.filter(b.column(5)).columns]):
                held.setdefault(r[4], []).append(r)
        sizes = sorted(((sum(r[3] for r in rows), c) for c, rows in held.items()), reverse=True)
        room: list[tuple[int, str]] = []
        into: dict[str, str] = {}
        for size, c in sizes:
            at = bisect_left(room, (size, ""))
            left, to = room.pop(at) if at < len(room) else (capacity, c)
            into[c] = to
            if left > size:
                insort(room, (left - size, to))
        still = {c for _, c in room[-most_open:]}
        rows = [(*r[:4], into[c], into[c] in still) for c, rs in held.items() for r in rs]
        for i in range(0, len(rows), 50_000):
            yield _batch(rows[i : i + 50_000], kind)

    return run


def pack(items: DataFrame, item: str, size: str, capacity: int = CAPACITY, most_open: int = OPEN, merge: int = MERGE) -> DataFrame:
    """(item, part, start, size, container): where each item, or each part of a cut one, lies; ``part`` counts from 0.

    The assignment rows (no texts) are written once; only those of open
    containers are shuffled, in as many rounds as it takes to bring ``merge`` to
    that power past the number of tasks.
    """
    kind = items.schema[item].dataType
    schema = T.StructType([T.StructField("item", kind), T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("size", T.LongType()), T.StructField("container", T.StringType()), T.StructField("open", T.BooleanType())])
    if item in _NAMES[1:]:
        items, item = items.withColumnRenamed(item, "item"), "item"
    packed = items.filter(F.col(item).isNotNull() & (F.col(size) > 0)).select(F.col(item).alias("item"), F.col(size).cast("long").alias("size")).mapInArrow(_pack(capacity, most_open), schema)
    packed = materialize(packed, "packed")
    task = F.split("container", "-")[0].cast("int")
    last = packed.filter("open").agg(F.max(task)).first()[0]
    merged, reach = packed.filter("open"), 1
    while last is not None and reach <= last or reach == 1:
        reach *= merge
        groups = (last or 0) // reach + 1
        # containers that earlier rounds closed come along with their group and are passed on
        merged = merged.withColumn("__to", (task / F.lit(reach)).cast("int")).repartition(groups, "__to").drop("__to").mapInArrow(_merge(capacity, most_open), schema)
    return packed.filter("not open").unionByName(merged).drop("open")
