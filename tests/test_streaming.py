"""Streaming quota and dialog state against the batch closed forms."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL
from sitelens.operators import dialog as Dg
from sitelens.operators import quota as Q
from sitelens.sources import eventlog as L
from sitelens.sources.runs import Runs
from sitelens.streaming import streams as ST


def _slice(n_files):
    return F.floor(F.datediff(F.col("ts"), F.lit("2024-01-01")) / (31 / n_files))


def _split_events(spark, n_files=4, newest_first=False):
    """The event log as several time-ordered files (several micro-batches)."""
    import time
    out = tempfile.mkdtemp(prefix="sitelens-events-")
    ev = spark.read.parquet(f"{SF_CHECK}/events.parquet")
    # One file per time slice: the file source takes new files in modification-time order.
    for i in sorted(range(n_files), reverse=newest_first):
        ev.filter(_slice(n_files) == i).coalesce(1).write.mode("append").parquet(out)
        time.sleep(1.1)
    return out, ev


def _quota(spark, path, name, **kw):
    stream = L.quota_timeline(ST.event_stream(spark, path, max_files=1))
    return ST.quota_stream(stream, tempfile.mkdtemp(prefix=f"sitelens-{name}-"), **kw)


def _dialog(spark, path, name):
    return ST.dialog_stream(ST.event_stream(spark, path, max_files=1), tempfile.mkdtemp(prefix=f"sitelens-{name}-"))


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


QUOTA, DIALOG = ["request_id", "user_id", "admitted", "max_limit"], ["event_id", "user_id", "session", "action"]


def test_quota_stream_matches_batch_replay(spark):
    path, ev = _split_events(spark)
    got = _quota(spark, path, "quota")
    per, _ = Q.quota_replay(L.audit_requests(ev), L.limit_changes(ev))
    assert _rows(got, QUOTA) == _rows(per, QUOTA)
    assert got.where("late").count() == 0


def test_dialog_stream_matches_batch(spark):
    path, ev = _split_events(spark)
    got = _dialog(spark, path, "dialog")
    log = ev.select("event_id", "ts", "user_id", F.col("event_type").alias("kind"))
    assert _rows(got, DIALOG) == _rows(Dg.message_routing(log), DIALOG)


def test_out_of_order_batches_lose_no_row(spark):
    """Four micro-batches, the newest first: every request and every text comes
    out once; rows behind their user's time are marked, and decided on arrival."""
    path, ev = _split_events(spark, newest_first=True)
    got = _quota(spark, path, "late-quota")
    requests = L.audit_requests(ev)
    assert _rows(got, ["request_id", "user_id"]) == _rows(requests, ["request_id", "user_id"])
    # the same rule in plain Python, in order of arrival
    limits, used, want = {}, {}, {}
    for batch in range(3, -1, -1):
        for r in L.quota_timeline(ev.filter(_slice(4) == batch)).orderBy("ts", "request_id").collect():
            lim, n = limits.get(r.user_id, 10), used.get(r.user_id, 0)
            if r.new_limit is not None:
                limits[r.user_id] = r.new_limit
            else:
                want[r.request_id] = n < lim
                used[r.user_id] = n + (n < lim) * r.ws
    assert {r.request_id: r.admitted for r in got.collect()} == want
    assert got.where("late").count() > 100
    said = _dialog(spark, path, "late-dialog")
    assert said.count() == said.select("event_id").distinct().count() == ev.filter(
        F.col("event_type").isin(Dg.TEXT_PLAIN, Dg.TEXT_WITH_ID)).count()


def test_repeated_rows_count_once(spark):
    path = tempfile.mkdtemp(prefix="sitelens-events-")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    for _ in range(2):  # the recent rows of a file come again in the next one
        ev.filter("event_id < 120").unionAll(ev.filter("event_id < 20")).coalesce(1).write.mode("append").parquet(path)
    got = _quota(spark, path, "again")
    per, _ = Q.quota_replay(L.audit_requests(ev.filter("event_id < 120")), L.limit_changes(ev.filter("event_id < 120")))
    assert _rows(got, QUOTA) == _rows(per, QUOTA)


def test_quota_timeline_equals_union(spark):
    ev = spark.read.parquet(f"{SF_CHECK}/events.parquet")
    a = L.quota_timeline(ev)
    b = Q.timeline_of(L.audit_requests(ev), L.limit_changes(ev))
    cols = ["user_id", "ts", "request_id", "ws", "new_limit"]
    assert _rows(a, cols) == _rows(b, cols)


def test_report_sink_is_idempotent_under_replay(spark):
    """ST-3: the same micro-batch delivered twice (a replay after a failure)
    leaves each request id once in the sink."""
    from sitelens.functions import answers as A
    sink = tempfile.mkdtemp(prefix="sitelens-sink-") + "/reports"
    rows = spark.createDataFrame([(i, "u", "https://s.com", '{"full_result": {}}', f"S{i % 2}") for i in range(6)],
                                 "request_id long, user_id string, url string, result_json string, sheet_id string") \
        .withColumn("created_at", F.lit("2025-01-01 12:00:00").cast("timestamp_ntz"))
    rows = A.with_report_row(rows)
    write = ST.deliver_reports(sink, rows.schema)
    write(rows.filter("request_id < 4"), 0)
    write(rows.filter("request_id < 4"), 0)      # replayed epoch
    write(rows.filter("request_id >= 4"), 1)
    got = Runs(spark, sink, rows.schema).read()
    assert got.count() == 6 and got.select("request_id").distinct().count() == 6


def _plain_quota(batches, default=10):
    """The rule in order of arrival, one statement after the other."""
    rows, out, seen = {}, {}, set()
    for batch in batches:
        for i, user, ts, ws, new in sorted({r[0]: r for r in batch}.values(), key=lambda r: (r[2], r[0])):
            if i in seen:
                continue
            seen.add(i)
            s = rows.setdefault(user, [0, default])
            if new is not None:
                s[1] = new
                continue
            ok = s[0] < s[1]
            out[i] = (ok, s[1])
            s[0] += int(ok and ws)
    return out, {u: tuple(s) for u, s in rows.items()}


def test_quota_epochs_hot_user_far_repeats_and_replays(spark, monkeypatch):
    """Half of every batch is one user; ids come again many epochs and 10,000 ids later;
    an epoch is run again after a failure, before and after all its commits."""
    monkeypatch.setattr(ST, "COMPACT_EVERY", 3)
    r = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    batches, made = [], 0
    for _ in range(5):
        batch = []
        for _ in range(2200):
            change = r.random() < 0.02
            batch.append((made, "hot" if r.random() < 0.5 else f"u{r.randint(0, 40)}", t0 + dt.timedelta(seconds=made),
                          0 if change else int(r.random() < 0.7), r.randint(0, 900) if change else None))
            made += 1
        batches.append(batch)
    batches[4] += batches[0][:50] + batches[3][:50] + batches[4][:50]  # ids 0.. come again at a distance of 10,000
    schema = "request_id long, user_id string, ts timestamp_ntz, ws long, new_limit long"
    path = tempfile.mkdtemp(prefix="sitelens-epochs-")
    job = ST.QuotaEpochs(spark, path, default=10)
    for n, batch in enumerate(batches):
        df = spark.createDataFrame(batch, schema).repartition(3)
        if n == 2:  # fails before its state is committed
            with monkeypatch.context() as m:
                m.setattr(job.states, "append", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
                with pytest.raises(RuntimeError):
                    job(df, n)
        job(df, n)
        if n in (1, 2):
            job(df, n)
    got = job.decisions.read()
    want, rows = _plain_quota(batches)
    assert {x.request_id: (x.admitted, x.max_limit) for x in got.collect()} == want and got.count() == len(want)
    assert {x.user_id: (x.current, x.max_limit) for x in job.state_before(5).collect()} == rows
    assert [*job.whole.committed()] == [ST.epoch_name(2)]


def test_dialog_state_composes(spark):
    """A log taken in parts, the state carried on, equals the log taken whole."""
    ev = spark.read.parquet(f"{SF_CHECK}/events.parquet").select("event_id", "ts", "user_id", F.col("event_type").alias("kind"))
    parts = [ev.where(_slice(5) == n).withColumn("user_id", F.col("user_id").cast("string")) for n in range(5)]
    job = ST.DialogEpochs(spark, tempfile.mkdtemp(prefix="sitelens-dialog-"))
    for n, part in enumerate(parts):
        job(part, n)
    assert _rows(job.decisions.read(), DIALOG) == _rows(Dg.message_routing(ev.where(_slice(5) < 5)), DIALOG)


def test_runs_are_whole_or_absent(spark):
    path = tempfile.mkdtemp(prefix="sitelens-runs-")
    table = Runs(spark, path, "id long")
    assert table.read().count() == 0
    assert table.append(spark.range(3), "b", note=1) and not table.append(spark.range(9), "b")
    spark.range(50).write.parquet(f"{path}/data/c-unfinished")  # a run that ended before its record
    assert table.append(spark.range(2), "a")
    assert table.read().count() == 5 and table.read(before="b").count() == 2 and table.read(runs=["b"]).count() == 3
    assert [*table.committed()] == ["a", "b"] and table.committed()["b"]["note"] == 1
