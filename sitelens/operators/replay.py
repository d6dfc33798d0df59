"""Check-then-increment counters with limit changes, replayed in ranges (W-3b).

Rows of a user in order are requests (``ws`` of them would succeed) and limit
changes. A request is admitted while the user's counter is below the limit in
force; an admitted request that succeeds raises it. What a *segment* (the rows up
to the next change) does to the counter is a map: c -> max(c, min(c + ws, limit)).
Such maps are monotone, made of pieces of slope 0 and 1, and closed under
composition, so a range of rows of one user, however many changes it holds, is one
map (``Counter``) of the counter at its first change.

Ranges are cut by rows, not by users (``operators.windows``). Within a range only
the first user can have rows in earlier ranges. The others start from nothing:
their decisions are made at once. For the first user each row gets what the
decision hangs on: before the first change of the range, the successes so far;
after it, the least counter at that change which blocks the row, read off the map
by its inverse. The range's summary (successes before its first change, the map,
the last limit) goes into the same table. The summaries of a user are then applied
in order, one number and one limit being all that goes from range to range, and the
result, at most one row per range, is joined back: a user with a third of the log,
or with millions of changes, is spread over as many tasks as its rows fill.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.operators.windows import PART, write_ranges


@dataclass(frozen=True)
class Counter:
    """A monotone map of counters (0, 1, ...): through the points (at, to), with
    slope 0 or 1 between them and slope 1 after the last. ``at`` starts with 0."""
    at: np.ndarray
    to: np.ndarray

    def __call__(self, c):
        i = np.searchsorted(self.at, c, side="right") - 1
        j = np.minimum(i + 1, len(self.at) - 1)
        rises = (i == j) | (self.to[j] > self.to[i])
        return self.to[i] + np.where(rises, c - self.at[i], 0)

    def least(self, v):
        """The least counter that is mapped to ``v`` or more."""
        i = np.searchsorted(self.to, v, side="left")
        j = np.minimum(i, len(self.to) - 1)
        reach = self.at[j] + np.where(i < len(self.to), np.minimum(v - self.to[j], 0), v - self.to[j])
        return np.where(i == 0, 0, reach)

    def then(self, after: "Counter") -> "Counter":
        """This map, then ``after``: points where either has one, those in line left out."""
        at = np.unique(np.concatenate([self.at, self.least(after.at[after.at > self.to[0]])]))
        to = after(self(at))
        if len(at) > 2:
            rises = np.append(np.diff(to) > 0, True)
            kept = np.append(True, rises[1:] != rises[:-1])
            at, to = at[kept], to[kept]
        return Counter(at, to)


def segment(ws: int, limit: int) -> Counter:
    """What ``ws`` successes under ``limit`` do: c -> max(c, min(c + ws, limit))."""
    if ws <= 0 or limit <= 0:
        return Counter(np.zeros(1, np.int64), np.zeros(1, np.int64))
    if ws >= limit:
        return Counter(np.array([0, limit], np.int64), np.array([limit, limit], np.int64))
    return Counter(np.array([0, limit - ws, limit], np.int64), np.array([ws, limit, limit], np.int64))


def advanced(c: int, ws: int, limit: int) -> int:
    return max(c, min(c + ws, limit))


class _Replay:
    """One range: rows in order, and the summaries of its first and last user."""

    def __init__(self, key: str, default: int):
        self.key, self.default = key, default
        self.user, self.seen = None, False
        self.first = True              # still the range's first user
        self.c, self.limit, self.ws = 0, default, 0
        self.before: int | None = None  # first user: successes before its first change, once there was one
        self.map = segment(0, 0)

    def end_of_first(self) -> None:
        """Keeps what the first user's rows amount to."""
        if self.before is None:
            self.summary = (self.user, self.ws, None, None, None)
        else:
            m = self.map.then(segment(self.ws, self.limit))
            self.summary = (self.user, self.before, m.at.tolist(), m.to.tolist(), self.limit)

    def end(self) -> list[pa.Array]:
        """The range's summary: first user, its successes before the first change,
        map and last limit (null: no change); last user, if another, its counter
        and limit."""
        last = (None, None, None)
        if self.first:
            self.end_of_first()
        else:
            last = (self.user, advanced(self.c, self.ws, self.limit), self.limit)
        return [pa.array([v], t) for v, t in zip((*self.summary, *last), _TYPES)]

    def batch(self, b: pa.RecordBatch):
        """Per row: admitted, limit, successes in the segment so far, blocking
        counter. Rows of the range's first user are not decided here: after its first
        change they have the counter, before it no limit either."""
        n, users = b.num_rows, b.column(self.key)
        codes = users.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        start = np.concatenate([[True], codes[1:] != codes[:-1]])
        start[0] = not self.seen or users[0].as_py() != self.user
        ws = b.column("ws").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        new = b.column("new_limit")
        change, value = new.is_valid().to_numpy(zero_copy_only=False), new.fill_null(0).to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(start | change)
        if not len(heads) or heads[0]:
            heads = np.append(0, heads)
        total = np.cumsum(ws)
        sums = np.diff(np.append(0, total[np.append(heads[1:], n) - 1]))
        before = total - ws
        counters, limits = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
        offset, kind = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int8)
        blocks = np.zeros(n, np.int64)
        cuts = np.append(heads, n)
        for s, (a, e, starts, changes, gained) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), start[heads].tolist(),
                                                               change[heads].tolist(), sums.tolist())):
            if starts and self.seen:
                if self.first:
                    self.end_of_first()
                self.first, self.c, self.limit, self.ws = False, 0, self.default, 0
            self.seen, self.user = True, users[a].as_py()
            if changes:
                if self.first:
                    if self.before is None:
                        self.before = self.ws
                    else:
                        self.map = self.map.then(segment(self.ws, self.limit))
                else:
                    self.c = advanced(self.c, self.ws, self.limit)
                self.limit, self.ws = int(value[a]), 0
            counters[s], limits[s], offset[s] = self.c, self.limit, self.ws
            if self.first:
                kind[s] = 1 if self.before is None else 2
                if kind[s] == 2:
                    prior = self.ws + before[a:e] - before[a]
                    blocks[a:e] = self.map.least(self.limit - prior)
            self.ws += gained
        which = np.repeat(np.arange(len(heads)), np.diff(cuts))
        prior = before - before[heads][which] + offset[which]
        kind = kind[which]
        admitted = pa.array(counters[which] + prior < limits[which], mask=kind > 0)
        return [admitted, pa.array(limits[which], mask=kind == 1), pa.array(prior), pa.array(blocks, mask=kind < 2)]


_SUMMARY = [T.StructField("__user", T.StringType()), T.StructField("__before", T.LongType()),
            T.StructField("__at", T.ArrayType(T.LongType())), T.StructField("__to", T.ArrayType(T.LongType())),
            T.StructField("__limit", T.LongType()), T.StructField("__last_user", T.StringType()),
            T.StructField("__last_counter", T.LongType()), T.StructField("__last_limit", T.LongType())]
_TYPES = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_ROW = [T.StructField("admitted", T.BooleanType()), T.StructField("max_limit", T.LongType()),
        T.StructField("__prior", T.LongType()), T.StructField("__blocks", T.LongType())]
INCOMING = "user string, part int, counter long, limit long, first long"


def _apply(default: int):
    """Summaries of users, in order of their ranges -> the counter and limit with
    which each range starts, and the counter at its first change."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, seen, c, limit = None, False, 0, default
        for b in it:
            out = []
            for u, part, before, at, to, last, counter in zip(*(x.to_pylist() for x in b.columns)):
                if not seen or u != user:
                    user, seen, c, limit = u, True, 0, default
                if counter is not None:  # the user's first row is in this range: its counter is known
                    c, limit = counter, last
                    continue
                first = advanced(c, before, limit)
                out.append((u, part, c, limit, first))
                c = first
                if at is not None:
                    c, limit = int(Counter(np.array(at, np.int64), np.array(to, np.int64))(np.int64(c))), last
            cols = list(zip(*out)) or [[]] * 5
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)],
                                             ["user", "part", "counter", "limit", "first"])
    return run


def replayed(timeline: DataFrame, order: list[str], default: int) -> DataFrame:
    """``timeline`` (user_id, ws, new_limit, the order columns and any others)
    with ``admitted`` and ``max_limit`` (the limit in force) for every row; on a
    row that is a change, ``max_limit`` is the new one."""
    fields = [*timeline.schema.fields, *_ROW, T.StructField(PART, T.IntegerType()), *_SUMMARY]
    names = [f.name for f in fields]

    def run(it: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        state, held = _Replay("user_id", default), None

        def rows(cols: list[pa.Array], summary: list[pa.Array] | None = None) -> pa.RecordBatch:
            n = len(cols[0])
            return pa.RecordBatch.from_arrays(
                [*cols, pa.array(np.full(n, part, np.int32)), *(summary or [pa.nulls(n, t) for t in _TYPES])], names)

        for b in it:
            if held is not None:
                yield rows(held)
            cols = [*b.columns, *state.batch(b)]
            yield rows([c.slice(0, b.num_rows - 1) for c in cols])
            held = [c.slice(b.num_rows - 1) for c in cols]
        if held is not None:
            yield rows(held, state.end())  # the range's last row carries its summary

    table = write_ranges(timeline, "user_id", order, run, fields, "replay")
    ends = table.where(F.col("__before").isNotNull())  # one row per range
    none = F.lit(None).cast("array<long>")
    summaries = ends.select(F.col("__user").alias("user"), PART, "__before", "__at", "__to", "__limit",
                            F.lit(None).cast("long").alias("counter")) \
        .unionAll(ends.where(F.col("__last_counter").isNotNull()).select(
            "__last_user", PART, F.lit(0).cast("long"), none, none, "__last_limit", "__last_counter"))
    incoming = summaries.repartition("user").sortWithinPartitions("user", PART).mapInArrow(_apply(default), INCOMING)
    # at most one row per range, which is why it may be broadcast
    out = table.join(F.broadcast(incoming), F.col("user_id").eqNullSafe(F.col("user")) & (F.col(PART) == F.col("part")), "left")
    by_range = F.when(F.col("__blocks").isNotNull(), F.col("first") < F.col("__blocks")) \
        .otherwise(F.col("counter") + F.col("__prior") < F.col("limit"))
    return out.select(*timeline.columns, F.coalesce("admitted", by_range).alias("admitted"),
                      F.coalesce("max_limit", "limit").alias("max_limit"))
