"""Quota replay and outbox against plain-Python versions of the original
statement-by-statement logic."""

import datetime as dt
import random

from pyspark.sql import functions as F

from sitelens.operators import outbox as O
from sitelens.operators import quota as Q
from sitelens.schemas import REPORT_HEADERS

T0 = dt.datetime(2024, 1, 1)


def _frames(spark, reqs, changes):
    r = spark.createDataFrame(reqs, "request_id long, user_id string, ts timestamp_ntz, would_succeed boolean")
    c = spark.createDataFrame(changes, "event_id long, user_id string, ts timestamp_ntz, max_limit long")
    return r, c


def py_replay(reqs, changes, default=10):
    """ensure_user_limit / can_run / increment_counter / set_limit, in order."""
    ev = [(ts, rid, "req", u, ws) for rid, u, ts, ws in reqs] + [(ts, eid, "chg", u, n) for eid, u, ts, n in changes]
    rows, out = {}, {}
    for ts, i, kind, u, x in sorted(ev):
        if kind == "chg":
            rows.setdefault(u, [0, x])
            rows[u][1] = x
            continue
        rows.setdefault(u, [0, default])
        ok = rows[u][0] < rows[u][1]
        if ok and x:
            rows[u][0] += 1
        out[i] = (ok, rows[u][1])
    return out, rows


def test_reference_limit_scenario(spark):
    # limit 10: 5 uses still allowed, 10 uses blocked, raised to 20 -> allowed.
    reqs = [(i, "u", T0 + dt.timedelta(minutes=i), True) for i in range(12)]
    changes = [(100, "u", T0 + dt.timedelta(minutes=10, seconds=30), 20)]
    r, c = _frames(spark, reqs, changes)
    per, final = Q.quota_replay(r, c)
    got = {x.request_id: x.admitted for x in per.collect()}
    # 10 successes use the quota; the 11th (10:00) is blocked; after the
    # raise at 10:30 the 12th is allowed again.
    assert all(got[i] for i in range(10)) and not got[10] and got[11]
    fixed = {x.request_id: x.admitted for x in Q.quota_admission(r).collect()}
    assert all(fixed[i] for i in range(10)) and not fixed[10] and not fixed[11]
    f = final.first()
    assert (f.current, f.max_limit) == (11, 20)


def test_replay_matches_bruteforce_random(spark):
    rnd = random.Random(7)
    reqs, changes, eid = [], [], 0
    for u in ["a", "b", "c", "d"]:
        for _ in range(60):
            eid += 1
            ts = T0 + dt.timedelta(minutes=rnd.randrange(0, 3000))
            if rnd.random() < 0.1:
                changes.append((eid, u, ts, rnd.randrange(0, 8)))
            else:
                reqs.append((eid, u, ts, rnd.random() < 0.8))
    r, c = _frames(spark, reqs, changes)
    per, final = Q.quota_replay(r, c, default=3)
    exp, rows = py_replay(reqs, changes, default=3)
    got = {x.request_id: (x.admitted, x.max_limit) for x in per.collect()}
    assert got == exp
    assert {x.user_id: [x.current, x.max_limit] for x in final.collect()} == rows


def test_route_flush_and_unwritten(spark):
    res = spark.createDataFrame([(1, "u1", T0, "https://a.com", "{}"), (2, "u1", T0 + dt.timedelta(hours=2), "https://b.com", "{}"),
                                 (3, "u2", T0, "https://c.com", "{}")],
                                "request_id long, user_id string, ts timestamp_ntz, url string, result_json string")
    links = spark.createDataFrame([(10, T0 + dt.timedelta(hours=1), "u1", "l", "S1"),
                                   (11, T0 + dt.timedelta(hours=3), "u1", "l", "S2"),
                                   (12, T0 + dt.timedelta(minutes=5), "u2", "bad", "")],
                                  "event_id long, ts timestamp_ntz, user_id string, link string, sheet_id string")
    known = O.destinations(res, links).select("request_id", "sheet_id")
    both = O.with_route(res.join(known, "request_id"))
    routed = {r.request_id: (r.route, r.sheet_id) for r in both.collect()}
    assert routed == {1: ("pending", None), 2: ("write", "S1"), 3: ("pending", None)}
    pend = O.pending_rows(both, links)
    keys = [r.row_key for r in pend.orderBy("id").collect()]
    assert len(set(keys)) == 2 and keys == [r.row_key for r in O.pending_rows(both, links).orderBy("id").collect()]
    rows = {r.id: (r.written, r.flush_event_id, r.flushed_to) for r in pend.collect()}
    assert rows == {1: (True, 10, "S1"), 3: (False, None, None)}
    assert [r.id for r in O.unwritten(pend).collect()] == [3]
    counts = {r.event_id: r.n_flushed for r in O.flush_counts(pend, links).collect()}
    assert counts == {10: 1, 11: 0}


def test_header_check(spark):
    df = spark.createDataFrame([(REPORT_HEADERS,), (["x"] * 28,), ([],), (None,)], "h array<string>")
    assert [r.s for r in df.select(O.header_check("h").alias("s")).collect()] == ["ok", "mismatch", "create", "create"]


def test_sink_and_state_tables(spark):
    import tempfile

    from sitelens.functions import answers as A
    from sitelens.sources.tables import ensure_state_tables
    root = tempfile.mkdtemp(prefix="sitelens-sink-")
    paths = ensure_state_tables(spark, root)
    assert spark.read.parquet(paths["pending_results"]).columns == ["id", "user_id", "url", "result_json",
                                                                   "created_at", "written"]
    ensure_state_tables(spark, root)  # idempotent
    df = spark.createDataFrame([(1, "u", "https://s.com", '{"full_result": {"offer_first_screen": "T"}}', "S1"),
                                (2, "v", "https://t.com", '{"full_result": {}}', "S2")],
                               "request_id long, user_id string, url string, result_json string, sheet_id string") \
        .withColumn("created_at", F.lit("2025-01-01 12:00:00").cast("timestamp_ntz"))
    rows = A.with_report_row(df, fill_timestamp=True)
    assert rows.filter("request_id = 1").first().timestamp == "2025-01-01 12:00:00"
    sheets = spark.createDataFrame([("S1", REPORT_HEADERS)], "sheet_id string, first_row array<string>")
    O.write_reports(rows, sheets, f"{root}/reports")
    O.write_reports(rows.filter("request_id = 1"), sheets, f"{root}/reports")  # an append
    assert O.write_reports(rows.filter("request_id = 2"), sheets, f"{root}/again", "night")
    assert not O.write_reports(rows, sheets, f"{root}/again", "night")  # the run is there
    assert O.read_reports(spark, f"{root}/again").count() == 1
    back = O.read_reports(spark, f"{root}/reports").collect()
    assert sorted((r.sheet_id, r.header, r.offer_first_screen) for r in back) == [
        ("S1", "ok", "T"), ("S1", "ok", "T"), ("S2", "create", "")]


def test_appended_rows_keep_gapless_ids(spark):
    """S-5/W-4: three runs, one repeated and one empty, have the ids of a single run."""
    import tempfile
    rows = [(i, f"u{i % 3}", "https://a.com", T0 + dt.timedelta(minutes=i * 7 % 60 + 60 * (i // 20))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, user_id string, url string, created_at timestamp_ntz").repartition(4)
    many, one = (tempfile.mkdtemp(prefix="sitelens-parked-") for _ in range(2))
    parts = [df.where(F.floor(F.col("id") / 20) == n) for n in range(3)]
    assert [O.append_pending(p, many, r) for p, r in ((parts[0], "0"), (parts[1], "1"), (parts[1], "1"), (df.where("false"), "1b"),
                                                      (parts[2], "2"), (parts[0], "0"))] == [True, True, False, True, True, False]
    assert O.append_pending(df, one, "all")
    got, want = ({(r.row_id, r.id) for r in O.parked(spark, p).collect()} for p in (many, one))
    assert got == want and sorted(i for i, _ in got) == list(range(1, 61))
