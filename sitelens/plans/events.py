"""Registered settings/limits/quota queries over the whole ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators import quota as Q
from sitelens.session import scratch_path, shared_table
from sitelens.sources import eventlog as L
from sitelens.sources.lookup import BUCKET, clustered, rows_of
from sitelens.sources.runs import Runs
from sitelens.sources.tables import events

# Fallback destination id when a user has none (a deployment setting).
DEFAULT_SHEET_ID = "default-sheet"
# User whose pending rows the parameterised scan returns: one who never connects.
PROBE_USER = "12"
# User whose destination is looked up: one who connects.
CONNECTED_USER = "3"


def _ev(spark, sf):
    return events(spark, sf)


def settings_latest(spark: SparkSession, sf: str) -> DataFrame:
    return Q.settings_latest(L.sheet_links(_ev(spark, sf)))


def sheet_id_extract(spark: SparkSession, sf: str) -> DataFrame:
    return L.sheet_links(_ev(spark, sf)).select("event_id", "link", "sheet_id")


def admin_changes(spark: SparkSession, sf: str) -> DataFrame:
    c = L.limit_commands(_ev(spark, sf))
    return c.select("event_id", "actor", L.is_admin("actor").alias("is_admin"))


def limit_changes_valid(spark: SparkSession, sf: str) -> DataFrame:
    return L.limit_changes(_ev(spark, sf))


def limits_initial(spark: SparkSession, sf: str) -> DataFrame:
    ev = _ev(spark, sf)
    return Q.limits_initial(L.audit_requests(ev), L.limit_changes(ev))


def quota_admission(spark: SparkSession, sf: str) -> DataFrame:
    adm = Q.quota_admission(L.audit_requests(_ev(spark, sf)))
    return adm.select("request_id", "user_id", "prior_ok", "admitted")


def usage_counts(spark: SparkSession, sf: str) -> DataFrame:
    _, final = Q.replay_timeline(L.quota_timeline(_ev(spark, sf)))
    return Q.usage_counts(final)


def limit_asof(spark: SparkSession, sf: str) -> DataFrame:
    return Q.limit_asof(L.quota_timeline(_ev(spark, sf)))


def quota_replay(spark: SparkSession, sf: str) -> DataFrame:
    per, _ = Q.replay_timeline(L.quota_timeline(_ev(spark, sf)))
    return per


def limits_final(spark: SparkSession, sf: str) -> DataFrame:
    _, final = Q.replay_timeline(L.quota_timeline(_ev(spark, sf)))
    return final


def message_routing(spark: SparkSession, sf: str) -> DataFrame:
    from sitelens.operators.dialog import message_routing as route
    log = events(spark, sf, "event_id", "ts", "user_id", "event_type").withColumnRenamed("event_type", "kind")
    return route(log)


def sheet_urls(spark: SparkSession, sf: str) -> DataFrame:
    """S-8: the destination link per user (fallback id when unset or '')."""
    from sitelens.functions.urls import sheet_url
    users = events(spark, sf, "user_id").select(F.col("user_id").cast("string").alias("user_id")).distinct()
    latest = Q.settings_latest(L.sheet_links(_ev(spark, sf)))
    return users.join(latest, "user_id", "left").select("user_id", sheet_url("sheet_id", DEFAULT_SHEET_ID).alias("url"))


def pending_for_user(spark: SparkSession, sf: str) -> DataFrame:
    """S-2/S-4: the scan a flush performs (one user's parked rows, oldest
    first) as Spark SQL with a named parameter (``:user`` is bound, never
    spliced into the text), from the folder of that user's bucket."""
    from sitelens.plans.audit import pending_by_user
    return spark.sql("SELECT id, user_id, url, created_at FROM {pending} WHERE user_id = :user "
                     "ORDER BY created_at, id", args={"user": PROBE_USER},
                     pending=rows_of(pending_by_user(spark, sf), "user_id", PROBE_USER))


def destination_for_user(spark: SparkSession, sf: str) -> DataFrame:
    """S-3: the destination of one user, from a settings table laid out for lookups."""
    settings = shared_table(spark, "settings_by_user", sf, lambda: clustered(
        Q.settings_latest(L.sheet_links(_ev(spark, sf))), "user_id", []), by=[BUCKET])
    return rows_of(settings, "user_id", CONNECTED_USER).select("user_id", "sheet_id")


def _event_files(sf: str) -> str:
    """The table as a glob: a stream takes a single file only by a pattern."""
    return f"{sf.rstrip('/')}/events.parque[t]"


def quota_stream(spark: SparkSession, sf: str) -> DataFrame:
    """ST-1 + ST-4: the quota rule run as Structured Streaming over the event
    files (availableNow), output identical to ``quota_replay``."""
    from sitelens.streaming import streams as ST
    stream = L.quota_timeline(ST.event_stream(spark, _event_files(sf)))
    return ST.quota_stream(stream, scratch_path(spark, "quota-stream")).drop("late")


def dialog_stream(spark: SparkSession, sf: str) -> DataFrame:
    """ST-1 + ST-5: the dialog state machine as Structured Streaming,
    output identical to ``message_routing``."""
    from sitelens.streaming import streams as ST
    stream = ST.event_stream(spark, _event_files(sf))
    return ST.dialog_stream(stream, scratch_path(spark, "dialog-stream")).drop("late")


def bundle_stream(spark: SparkSession, sf: str) -> DataFrame:
    """ST-2: the requests as a stream against the static crawl snapshot,
    output identical to ``content_bundle``."""
    from sitelens.plans import pages as P
    from sitelens.session import shared_path
    from sitelens.streaming import streams as ST
    table = shared_table(spark, "bundle_requests", sf, lambda: P.bundle_requests(spark, sf))
    stream = spark.readStream.schema(table.schema).parquet(shared_path(spark, "bundle_requests", sf))
    bundle = ST.bundle_stream(stream, P.crawl_snapshot(spark, sf))
    return ST.collect_stream(bundle.select("request_id", "norm_url", "fetched", "home_text", "requires_js", "pricing_url",
                                           "pricing_text"), "bundle_stream")


def delivered_reports(spark: SparkSession, sf: str) -> DataFrame:
    """ST-3: the report rows as a stream into the sink, the stream started a
    second time from its checkpoint, and the sink read back."""
    from sitelens.plans import audit as Au
    from sitelens.functions import answers as A
    from sitelens.session import shared_path
    from sitelens.streaming import streams as ST
    table = shared_table(spark, "report_stream", sf, lambda: A.with_report_row(Au._deliveries(spark, sf)))
    at, sink = scratch_path(spark, "reports-stream"), scratch_path(spark, "reports")
    for _ in range(2):
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", ST.FILES_PER_BATCH) \
            .parquet(shared_path(spark, "report_stream", sf))
        ST.run_available(stream, at, each=ST.deliver_reports(sink, table.schema))
    return Runs(spark, sink, table.schema).read().select("request_id", "sheet_id", "row_ok")


QUERIES = {
    "quota_stream": quota_stream,
    "bundle_stream": bundle_stream,
    "delivered_reports": delivered_reports,
    "dialog_stream": dialog_stream,
    "message_routing": message_routing,
    "sheet_urls": sheet_urls,
    "pending_for_user": pending_for_user,
    "destination_for_user": destination_for_user,
    "settings_latest": settings_latest,
    "sheet_id_extract": sheet_id_extract,
    "admin_changes": admin_changes,
    "limit_changes_valid": limit_changes_valid,
    "limits_initial": limits_initial,
    "quota_admission": quota_admission,
    "usage_counts": usage_counts,
    "limit_asof": limit_asof,
    "quota_replay": quota_replay,
    "limits_final": limits_final,
}
