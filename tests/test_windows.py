"""Running aggregates over ranges against a plain loop."""

import random

import pytest
from sitelens.operators.windows import running


def plain(rows):
    out, state = [], {}
    for user, t, v, name, reset in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        s = state.setdefault(user, [0, None, 0])
        if reset:
            s[2] = 0
        name_now = name if name is not None else s[1]
        out.append((user, t, s[0], s[0] + v, name_now, s[2]))
        s[0] += v
        s[1] = name_now
        if not reset:
            s[2] += v
    return out


@pytest.mark.parametrize("ranges", [1, 4, 13])
def test_hot_user_over_many_ranges(spark, ranges):
    r = random.Random(ranges)
    rows = [("hot" if r.random() < 0.6 else r.choice("abcdef"), i, r.randint(0, 3),
             r.choice([None, None, None, "x", "y"]), int(r.random() < 0.05)) for i in range(900)]
    df = spark.createDataFrame(rows, "user string, t long, v long, name string, reset long").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = running(df, "user", ["t"], sums={"before": ("v", False), "upto": ("v", True)}, lasts={"last": "name"},
                      since={"since": ("v", "reset")}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((x.user, x.t, x.before, x.upto, x["last"], x.since) for x in got) == sorted(plain(rows))


def test_null_key_and_empty(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 5), ("a", 1, 1)], "user string, t long, v long")
    got = running(df, "user", ["t"], sums={"before": ("v", False)}).collect()
    assert sorted((x.user or "", x.t, x.before) for x in got) == [("", 1, 0), ("", 2, 2), ("a", 1, 0)]
    assert running(df.where("false"), "user", ["t"], sums={"s": ("v", True)}).count() == 0
