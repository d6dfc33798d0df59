"""Running aggregates over range-partitioned timelines.

A plain window over a user puts all rows of that user into one task. Here rows
are range-partitioned and sorted by (key, order), so a user with a third of the
log lies in many ranges. Each task runs over its range once with vectorised prefix
sums and *writes* the rows with the number of their range: the ranges are fixed
there and then. What a key has gathered in earlier ranges is read from the same
table, from at most two rows per range, and added. No result hangs on two
exchanges choosing equal bounds, on exchange reuse or on adaptive execution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.session import materialize

PART = "__part"
RIM = "__rim"


class _Running:
    """State of the current key at the end of what has been read."""

    def __init__(self, key: str, sums: dict, lasts: dict, since: dict):
        self.key, self.sums, self.lasts, self.since = key, sums, lasts, since
        self.current, self.open = None, False
        self.sum = dict.fromkeys(sums, 0)
        self.last = dict.fromkeys(lasts)
        self.part = dict.fromkeys(since, 0)
        self.cut = dict.fromkeys(since, False)

    def batch(self, b: pa.RecordBatch) -> tuple[list[pa.Array], np.ndarray]:
        """The rows' running values within the range, and where a key starts."""
        n = b.num_rows
        keys = b.column(self.key).dictionary_encode()
        codes = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        start = np.concatenate([[True], codes[1:] != codes[:-1]])
        start[0] = not self.open or b.column(self.key)[0].as_py() != self.current
        index = np.arange(n)
        first = np.maximum.accumulate(np.where(start, index, -1))  # -1: the key came with the last batch
        carried = first < 0
        cols = []

        def value(name: str) -> np.ndarray:
            return b.column(name).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

        for out, (col, inclusive) in self.sums.items():
            v = value(col)
            total = np.cumsum(v)
            before = total - v
            run = before - np.where(carried, 0, before[first]) + np.where(carried, self.sum[out], 0)
            cols.append(pa.array(run + v if inclusive else run, pa.int64()))
            self.sum[out] = int(run[-1] + v[-1])
        for out, col in self.lasts.items():
            v = b.column(col)
            known = np.where(v.is_valid().to_numpy(zero_copy_only=False), index, -1)
            at = np.maximum.accumulate(known)
            here = at >= np.maximum(first, 0)
            taken = v.take(pa.array(np.where(here, at, 0), mask=~here))
            if self.last[out] is not None:
                taken = pc.if_else(pa.array(carried & ~here), pa.scalar(self.last[out], v.type), taken)
            cols.append(taken)
            self.last[out] = taken[n - 1].as_py()
        for out, (col, reset) in self.since.items():
            v, resets = value(col), value(reset) > 0
            v = np.where(resets, 0, v)
            total = np.cumsum(v)
            before = total - v
            begin = np.maximum.accumulate(np.where(start | resets, index, -1))
            run = before - np.where(begin < 0, 0, before[begin]) + np.where(begin < 0, self.part[out], 0)
            last_cut = np.maximum.accumulate(np.where(resets, index, -1))
            cut = (last_cut >= np.maximum(first, 0)) | (carried & self.cut[out])
            cols += [pa.array(run, pa.int64()), pa.array(cut)]
            self.part[out], self.cut[out] = int(run[-1] + v[-1]), bool(cut[-1])
        self.current, self.open = b.column(self.key)[n - 1].as_py(), True
        return cols, start


def rims(batches: Iterator[tuple[pa.RecordBatch, np.ndarray]], part: int) -> Iterator[pa.RecordBatch]:
    """Adds the range's number and, at the last row of the range's first and of
    its last key, ``__rim``. ``batches`` come with where a key starts; the last row
    of a batch waits for the next one."""
    held, keys = None, 0

    def out(b: pa.RecordBatch, rim: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(rim)],
                                          [*b.schema.names, PART, RIM])

    for b, start in batches:
        if held is not None:
            yield out(held, np.array([keys == 1 and bool(start[0])]))
        count = keys + np.cumsum(start)  # keys so far, with the row's own
        keys = int(count[-1])
        if b.num_rows > 1:
            yield out(b.slice(0, b.num_rows - 1), start[1:] & (count[:-1] == 1))
        held = b.slice(b.num_rows - 1)
    if held is not None:
        yield out(held, np.array([True]))


def write_ranges(df: DataFrame, key: str, order: list[str], run, fields: list[T.StructField], name: str = "timeline") -> DataFrame:
    """The rows of ``df`` in ranges of (key, order), each range passed through
    ``run(batches, its number)`` and written once with ``fields``."""
    from pyspark import TaskContext

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run((b for b in it if b.num_rows), TaskContext.get().partitionId())

    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(ranges, key, *order).sortWithinPartitions(key, *order)
    return materialize(ordered.mapInArrow(task, T.StructType(fields)), name)


def running(df: DataFrame, key: str, order: list[str], sums: dict | None = None, lasts: dict | None = None,
            since: dict | None = None) -> DataFrame:
    """Running aggregates over (key, order) in one pass.

    ``sums``: ``{out: (column, inclusive)}`` sum over earlier rows of the key,
    with the current row if ``inclusive``; 0 when there is none.
    ``lasts``: ``{out: column}`` last non-null value up to the current row.
    ``since``: ``{out: (column, reset)}`` sum over earlier rows after the last
    row whose ``reset`` is positive (such a row starts anew and adds nothing).
    """
    sums, lasts, since = dict(sums or {}), dict(lasts or {}), dict(since or {})
    longs = lambda names: [T.StructField(x, T.LongType()) for x in names]
    fields = list(df.schema.fields) + longs(sums) + [T.StructField(o, df.schema[c].dataType) for o, c in lasts.items()]
    for o in since:
        fields += [*longs([o]), T.StructField(f"__c_{o}", T.BooleanType())]
    names = [f.name for f in fields]
    fields += [T.StructField(PART, T.IntegerType()), T.StructField(RIM, T.BooleanType())]

    def run(it: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        state = _Running(key, sums, lasts, since)

        def local() -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
            for b in it:
                cols, start = state.batch(b)
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], names), start

        yield from rims(local(), part)

    local = write_ranges(df, key, order, run, fields)
    # What a key has at the end of a range, where it can go on in the next one or
    # come from the one before: at most two rows per range ...
    own = lambda c: F.coalesce(F.col(c), F.lit(0))
    totals = local.where(RIM).select(
        key, PART, *[(F.col(o) + (F.lit(0) if inclusive else own(c))).alias(f"__t_{o}") for o, (c, inclusive) in sums.items()],
        *[F.col(o).alias(f"__t_{o}") for o in lasts], *[F.col(f"__c_{o}") for o in since],
        *[(F.col(o) + F.when(own(r) > 0, F.lit(0)).otherwise(own(c))).alias(f"__t_{o}") for o, (c, r) in since.items()])
    # ... and so what it brings into a range from the earlier ones. Rows are sorted
    # by key, so only the first key of a range can have come from an earlier one:
    # at most one row per range is left, which is why it may be broadcast.
    w = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    for o in since:
        totals = totals.withColumn(f"__b_{o}", F.coalesce(F.sum(f"__t_{o}").over(w), F.lit(0)))
    brought = totals.withColumn("__earlier", F.count(PART).over(w)).select(
        F.col(key).alias("__key"), F.col(PART).alias("__of"), "__earlier",
        *[F.sum(f"__t_{o}").over(w).alias(f"__o_{o}") for o in sums],
        *[F.last(f"__t_{o}", ignorenulls=True).over(w).alias(f"__o_{o}") for o in lasts],
        *[(F.col(f"__b_{o}") - F.coalesce(F.last(F.when(F.col(f"__c_{o}"), F.col(f"__b_{o}")), ignorenulls=True).over(w),
                                          F.lit(0))).alias(f"__o_{o}") for o in since]).where("__earlier > 0")
    out = local.join(F.broadcast(brought), F.col(key).eqNullSafe(F.col("__key")) & (F.col(PART) == F.col("__of")), "left")
    offset = lambda o: F.coalesce(F.col(f"__o_{o}"), F.lit(0))
    return out.select(
        *df.columns, *[(F.col(o) + offset(o)).cast("long").alias(o) for o in sums],
        *[F.coalesce(o, f"__o_{o}").alias(o) for o in lasts],
        *[F.when(F.col(f"__c_{o}"), F.col(o)).otherwise(F.col(o) + offset(o)).cast("long").alias(o) for o in since])
