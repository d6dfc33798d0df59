"""Plan-shape regression guards for the scale design."""

import re

import __spark_entry__ as E
from conftest import SF_CHECK


def _plan(spark, key):
    return E.queries()[key](spark, SF_CHECK)._jdf.queryExecution().executedPlan().toString()


def _shuffles(plan):
    return len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin", plan))


def test_row_local_operators_do_not_shuffle_big_inputs(spark):
    # URL work is per row: no exchange at all (pages URL column only).
    assert _shuffles(_plan(spark, "url_normalize")) == 0
    # Text work is per row: never a shuffle of words or pages.
    for key in ["drop_frequent_words", "frequent_words", "html_to_text", "html_visible_text", "json_unwrap"]:
        plan = _plan(spark, key)
        assert _shuffles(plan) == 0 and not re.search("MapInArrow|MapInPandas|EvalPython|ArrowEval", plan), key


def test_filters_and_columns_reach_the_scan(spark):
    from sitelens.sources import eventlog as L
    from sitelens.sources.tables import events
    plan = L.audit_requests(events(spark, SF_CHECK))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(event_type, [click,error,purchase,view])]" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan
    plan = _plan(spark, "url_domain")
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan


def _rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


TIMELINES = ["message_routing", "quota_admission", "limit_asof", "quota_replay", "limits_final"]


def test_timelines_do_not_depend_on_how_spark_runs_them(spark):
    """The ranges are written with the rows: no exchange has to be reused, no plan kept."""
    want = {k: _rows(E.queries()[k](spark, SF_CHECK)) for k in TIMELINES}
    for conf, value in (("spark.sql.exchange.reuse", "false"), ("spark.sql.adaptive.enabled", "false")):
        before = spark.conf.get(conf)
        spark.conf.set(conf, value)
        try:
            for k in TIMELINES:
                fn = E.queries()[k]
                # apply_conf sets AQE again, so the frame is collected under the changed setting
                df = fn(spark, SF_CHECK)
                spark.conf.set(conf, value)
                assert _rows(df) == want[k], (conf, k)
        finally:
            spark.conf.set(conf, before)


def test_timelines_are_not_shuffled_again(spark):
    """What earlier ranges bring comes as a broadcast of at most a row per range."""
    for key in ["message_routing", "quota_admission", "limit_asof"]:
        plan = _plan(spark, key)
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "rangepartitioning" not in plan, key


def _files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numFiles").value()


def test_lookup_reads_one_bucket(spark):
    """S-2/S-3: the files of one user's bucket, not the table's."""
    from sitelens.plans import audit
    from sitelens.sources.lookup import BUCKET, rows_of
    table = audit.pending_by_user(spark, SF_CHECK)
    users = [r[0] for r in table.select("user_id").distinct().limit(5).collect()]
    every = _files_read(table.select("id"))
    for user in users:
        got = rows_of(table, "user_id", user)
        bucket = table.where(table.user_id == user).select(BUCKET).first()[0]
        assert got.count() == table.where(table.user_id == user).count() > 0
        assert _files_read(got) == _files_read(table.where(table[BUCKET] == bucket)) < every / 4
        assert "PartitionFilters: [isnotnull(key_bucket" in got._jdf.queryExecution().executedPlan().toString()


def test_texts_stay_out_of_the_lookups(spark):
    """The audit's decisions read keys and lengths of the snapshot, no text."""
    from sitelens.plans import audit, pages
    plan = audit._checked(spark, SF_CHECK)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[(norm_url[^\]]*)\]", plan)
    assert scans and all(not re.search(r"\btext#", s) for s in scans)
    assert "text" in pages.crawl_snapshot(spark, SF_CHECK).columns
