"""The composable counter maps, and the replay over ranges against a plain walk."""

import random

import numpy as np
import pytest
from sitelens.operators import quota as Q
from sitelens.operators.replay import advanced, segment


def test_maps_compose_like_the_segments_they_stand_for():
    r = random.Random(3)
    for _ in range(300):
        parts = [(r.randint(0, 6), r.randint(0, 12)) for _ in range(r.randint(1, 9))]
        whole = segment(*parts[0])
        for p in parts[1:]:
            whole = whole.then(segment(*p))
        c = np.arange(40)
        want = []
        for x in c.tolist():
            for ws, limit in parts:
                x = advanced(x, ws, limit)
            want.append(x)
        assert whole(c).tolist() == want
        assert [int(whole.least(np.int64(v))) for v in range(40)] == [next(x for x in range(60) if x >= 40 or want[x] >= v)
                                                                      for v in range(40)]
        assert whole.at[0] == 0 and len(whole.at) <= 2 * len(parts) + 1


def plain(rows, default):
    state, out = {}, {}
    for user, t, ws, new in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        s = state.setdefault(user, [0, default])
        if new is not None:
            s[1] = new
            continue
        ok = s[0] < s[1]
        out[t] = (ok, s[1])
        s[0] += int(ok and ws)
    return out, {u: tuple(s) for u, s in state.items()}


@pytest.mark.parametrize("ranges, changing", [(1, 0.1), (5, 0.1), (16, 0.5), (16, 0.004), (40, 0.05)])
def test_hot_user_over_ranges(spark, ranges, changing):
    r = random.Random(ranges)
    rows = [("hot" if r.random() < 0.6 else r.choice(["a", "b", "zz", None]), t, 0 if new else int(r.random() < 0.8), limit)
            for t in range(1500) for new in [r.random() < changing] for limit in [r.randint(0, 400) if new else None]]
    df = spark.createDataFrame([(u, t, t, w, n) for u, t, w, n in rows],
                               "user_id string, ts long, request_id long, ws long, new_limit long").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        per, final = Q.replay_timeline(df, default=5)
        got = {x.request_id: (x.admitted, x.max_limit) for x in per.collect()}
        ends = {x.user_id: (x.current, x.max_limit) for x in final.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    want, last = plain(rows, 5)
    assert got == want and ends == last


def test_many_changes_of_one_user_spread_over_tasks(spark):
    """A user with 200,000 limit changes: every range holds its share, and the result is the plain walk's."""
    n = 400_000
    rng = np.random.default_rng(1)
    new = rng.random(n) < 0.5
    limit = rng.integers(0, n // 3, n)
    ws = np.where(new, 0, rng.random(n) < 0.9)
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame({"user_id": "u", "ts": np.arange(n), "request_id": np.arange(n), "ws": ws.astype(int),
                                             "new_limit": pd.array(np.where(new, limit, 0), "Int64")}),
                               "user_id string, ts long, request_id long, ws long, new_limit long")
    marks = spark.createDataFrame(pd.DataFrame({"request_id": np.flatnonzero(new)}))
    df = df.join(marks.withColumn("is_change", marks.request_id >= 0), "request_id", "left") \
        .selectExpr("user_id", "ts", "request_id", "ws", "CASE WHEN is_change THEN new_limit END AS new_limit")
    per, final = Q.replay_timeline(df, default=7)
    got = per.selectExpr("sum(cast(admitted as int))", "sum(hash(request_id, admitted, max_limit))").first()
    c, lim, admitted, flags, limits, ids = 0, 7, 0, [], [], []
    for i in range(n):
        if new[i]:
            lim = int(limit[i])
            continue
        ok = c < lim
        c += int(ok and ws[i])
        admitted += ok
        ids.append(i)
        flags.append(ok)
        limits.append(lim)
    want = spark.createDataFrame(pd.DataFrame({"i": ids, "a": flags, "l": limits})).selectExpr("sum(hash(i, a, l))").first()
    assert (got[0], got[1]) == (admitted, want[0])
    assert tuple(final.first()) == ("u", c, lim)
