"""Cross-checks from the test plan: regex-mode text vs the tree walk on the
test pages; fixed-limit admission vs the exact replay without limit changes."""

from pyspark.sql import functions as F

from conftest import SF_CHECK
from sitelens.functions.html import html_to_text
from sitelens.operators import quota as Q
from sitelens.sources import eventlog as L
from tree_walk import extract_text


def test_regex_mode_equals_tree_walk_on_test_pages(spark):
    pages = spark.read.parquet(f"{SF_CHECK}/pages.parquet").select("page_id", "html")
    rows = pages.select("page_id", "html", html_to_text("html").alias("t")).collect()
    assert len(rows) > 0
    for r in rows:
        assert r.t == extract_text(r.html, visible_only=False), r.page_id


def test_fixed_limit_admission_equals_replay_without_changes(spark):
    ev = spark.read.parquet(f"{SF_CHECK}/events.parquet")
    req = L.audit_requests(ev)
    no_changes = spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id string, max_limit long")
    per, _ = Q.quota_replay(req, no_changes)
    fixed = Q.quota_admission(req).select("request_id", F.col("admitted").alias("fixed"))
    diff = per.join(fixed, "request_id").filter(F.col("admitted") != F.col("fixed"))
    assert diff.count() == 0
    assert per.count() == req.count()
