"""The end-to-end audit and the outbox queries.

requests (events) -> address -> content flags -> model answer (synthetic
answers of ``documents``, the scorer stand-in) -> quota with limit changes ->
outcome -> result envelope -> route (write now / park) -> flush on first
connection -> report rows.

Only ids, addresses and flags go through the timelines; the wide answers are
joined once, at the end, to the requests that need them. ``audit_decisions`` is
a table built once per input and read by every query here.

Requests are assigned pages and answers by ``request_id`` modulo the table
sizes (scalar subqueries); every table is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import answers as A
from sitelens.operators import bundle as B
from sitelens.operators import outbox as O
from sitelens.operators import quota as Q
from sitelens.plans import standin as Si
from sitelens.plans.answers import checked_answers, parsed_answers
from sitelens.plans.pages import crawl_index
from sitelens.schemas import FIELDS, REPORT_COLUMNS
from sitelens.session import materialize, scratch_path, shared_table
from sitelens.sources import eventlog as L
from sitelens.sources.lookup import BUCKET, clustered
from sitelens.sources.tables import documents, events, pages

# Stand-in: damaged copies of stored results, by request_id % BROKEN_EVERY; they come beside the results.
BROKEN_EVERY = 23
BROKEN_RESULTS = {5: "cut", 6: '{"full_result": {"faq": 5}}', 7: '{"full_result": "x"}', 8: "[]",
                  9: '{"full_result": {}, "pricing_url": 1}', 10: '{"pricing_url": null}'}


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    """Per audit request what it would come to if the quota allowed it."""
    n_pages = pages(spark, sf, "page_id").select(F.count("*")).scalar()
    n_docs = documents(spark, sf, "doc_id").select(F.count("*")).scalar()
    req = L.audit_requests(events(spark, sf)).withColumn("page_id", F.pmod("request_id", n_pages)) \
        .withColumn("doc_id", F.pmod("request_id", n_docs))
    # a request without a page keeps its row: its fetch fails
    req = req.join(pages(spark, sf, "page_id", "url").withColumnRenamed("url", "page_url"), "page_id", "left")
    req = req.withColumn("url", Si.typed_url(F.col("request_id"), F.coalesce("page_url", F.lit("gone.test"))))
    req = req.join(Si.typed_addresses(spark, sf), "url", "left")
    runs = B.with_flags(req.withColumn("norm_url", F.coalesce("norm_url", F.lit("https://gone.test"))),
                        crawl_index(spark, sf))
    runs = runs.join(checked_answers(spark, sf), "doc_id", "left")
    parsed = F.coalesce("parse_ok", F.lit(False))
    pre = (F.when(F.col("norm_url") == "", F.lit("invalid_url"))
           .when(~F.col("fetched"), F.lit("internal_error"))
           .when(~F.col("home_ok"), F.lit("fetch_failed"))
           .when(~F.col("would_succeed") | ~parsed, F.lit("internal_error")).otherwise(F.lit("ok")))
    error = (F.when(F.col("pre") != "internal_error", F.lit(None).cast("string"))
             .when(~F.col("fetched"), F.lit("page not reached"))
             .when(~F.col("would_succeed"), F.lit("model call failed")).otherwise(F.lit("answer is not a record")))
    return runs.withColumn("pre", pre).withColumn("fault", error).select(
        "request_id", "user_id", "ts", "doc_id", "norm_url", "pricing_url", "pre", "fault")


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """(request_id, user_id, ts, doc_id, norm_url, pricing_url, reason, error,
    sheet_id): every request's outcome under the quota in force, with limit
    changes, and the destination connected at its time. A table."""
    def build() -> DataFrame:
        checked = shared_table(spark, "audit_checked", sf, lambda: _checked(spark, sf))
        ev = events(spark, sf)
        timeline = Q.timeline_of(checked.withColumn("would_succeed", F.col("pre") == "ok"), L.limit_changes(ev))
        admitted, _ = Q.replay_timeline(timeline)
        routed = O.destinations(checked.select("request_id", "user_id", "ts"), L.sheet_links(ev))
        df = checked.join(admitted.select("request_id", "admitted"), "request_id") \
            .join(routed.select("request_id", "sheet_id"), "request_id")
        return df.select("request_id", "user_id", "ts", "doc_id", "norm_url", "pricing_url",
                         F.when(F.col("admitted"), F.col("pre")).otherwise(F.lit("limit")).alias("reason"),
                         F.when(F.col("admitted"), F.col("fault")).alias("error"), "sheet_id")
    return shared_table(spark, "audit_decisions", sf, build)


def audit_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """F-2: (request_id, user_id, ok, reason, short_summary, written_now, error).
    ``short_summary`` is the JSON text of up to four points (R-12)."""
    answers = parsed_answers(spark, sf)  # before the decisions, which then need no parse of their own
    d = decisions(spark, sf)
    ok = F.col("reason") == "ok"
    points = answers.select("doc_id", F.to_json(A.short_summary()).alias("points"))
    return d.join(points, "doc_id", "left").select(
        "request_id", "user_id", ok.alias("ok"), F.when(~ok, F.col("reason")).alias("reason"),
        F.when(ok, F.col("points")).alias("short_summary"), F.when(ok, F.col("sheet_id").isNotNull()).alias("written_now"),
        "error")


def results(spark: SparkSession, sf: str) -> DataFrame:
    """R-7: (request_id, user_id, ts, url, sheet_id, result_json) of every
    successful audit; the wide answers meet only these."""
    parsed_answers(spark, sf)  # before the decisions, which then need no parse of their own
    return _enveloped(spark, sf, decisions(spark, sf).filter(F.col("reason") == "ok"))


def _enveloped(spark: SparkSession, sf: str, d: DataFrame) -> DataFrame:
    """R-7 for the successful audits of ``d``."""
    df = d.join(parsed_answers(spark, sf).select("doc_id", *FIELDS), "doc_id").withColumn("short_summary", A.short_summary())
    env = A.envelope_json(pricing_url="pricing_url", timestamp=A.iso_timestamp("ts"), summary="short_summary")
    return df.select("request_id", "user_id", "ts", F.col("norm_url").alias("url"), "sheet_id", env.alias("result_json"))


def result_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).select("request_id", "result_json")


def _routed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Successful requests with their route, narrow."""
    d = decisions(spark, sf).filter(F.col("reason") == "ok")
    links = L.sheet_links(events(spark, sf))
    d = d.select("request_id", "user_id", "ts", F.col("norm_url").alias("url"), "sheet_id")
    return O.with_route(d), links


def outbox_route(spark: SparkSession, sf: str) -> DataFrame:
    routed, _ = _routed(spark, sf)
    return routed.select("request_id", "user_id", "route", "sheet_id")


def _pending(spark: SparkSession, sf: str) -> DataFrame:
    routed, links = _routed(spark, sf)
    return O.pending_rows(routed, links)


def pending_by_user(spark: SparkSession, sf: str) -> DataFrame:
    """The parked rows, laid out for lookups of one user."""
    return shared_table(spark, "pending_by_user", sf, lambda: clustered(
        _pending(spark, sf).select("id", "user_id", "url", "created_at"), "user_id", ["created_at", "id"]), by=[BUCKET])


def pending_results(spark: SparkSession, sf: str) -> DataFrame:
    return O.with_row_ids(_pending(spark, sf)).select("row_id", "id", "row_key", "user_id", "url", "created_at", "written")


def outbox_flush(spark: SparkSession, sf: str) -> DataFrame:
    return _pending(spark, sf).filter(F.col("written")).select("id", "user_id", "flush_event_id", "flushed_to")


def outbox_unwritten(spark: SparkSession, sf: str) -> DataFrame:
    return O.unwritten(_pending(spark, sf))


# Times at which the delivery runs (stand-in): each round delivers what is due and not marked.
ROUNDS = ["2024-01-03 00:00:00", "2024-01-08 00:00:00", "2024-02-01 00:00:00"]


def outbox_delivery(spark: SparkSession, sf: str) -> DataFrame:
    """J-4/J-7: parked rows delivered in rounds, each marked in the log; the
    last round runs twice. Returns (id, round) of the log."""
    path = scratch_path(spark, "delivered")
    pending = materialize(_pending(spark, sf).select("id", "flushed_at"), "pending-times")
    for n, at in [*enumerate(ROUNDS), (len(ROUNDS) - 1, ROUNDS[-1])]:
        O.deliver(pending.filter(F.col("flushed_at") <= F.lit(at).cast("timestamp_ntz")), path, n)
    return spark.read.parquet(*[f"{path}/{n}" for n in range(len(ROUNDS))])


def outbox_append(spark: SparkSession, sf: str) -> DataFrame:
    """S-5/W-4: the parked rows appended in runs by time, the first of them twice:
    one copy of every row, with the gapless ids of a single run."""
    path = scratch_path(spark, "parked")
    pending = materialize(_pending(spark, sf).select("id", "user_id", "url", "created_at"), "parked-rows")
    cuts = [None, *ROUNDS, None]
    for n in [0, 0, *range(1, len(ROUNDS) + 1)]:
        part = pending
        if cuts[n]:
            part = part.where(F.col("created_at") > F.lit(cuts[n]).cast("timestamp_ntz"))
        if cuts[n + 1]:
            part = part.where(F.col("created_at") <= F.lit(cuts[n + 1]).cast("timestamp_ntz"))
        O.append_pending(part, path, f"run-{n}")
    return O.parked(spark, path)


def flush_counts(spark: SparkSession, sf: str) -> DataFrame:
    return O.flush_counts(_pending(spark, sf), L.sheet_links(events(spark, sf)))


def _stored(result_json: Column, request_id: Column) -> Column:
    """array<struct<request_id, result_json>>: the result, and for some a damaged
    copy under a negative id (see BROKEN_RESULTS)."""
    def one(i: Column, text: Column) -> Column:
        return F.struct(i.cast("long").alias("request_id"), text.alias("result_json"))

    out = F.array(one(request_id, result_json))
    for at, text in BROKEN_RESULTS.items():
        broken = F.substr(result_json, F.lit(1), F.length(result_json) - 5) if text == "cut" else F.lit(text)
        out = F.when(F.pmod(request_id, F.lit(BROKEN_EVERY)) == at,
                     F.array(one(request_id, result_json), one(-1 - request_id, broken))).otherwise(out)
    return out


def _sent(spark: SparkSession, sf: str) -> DataFrame:
    """The successful audits that have a destination, with it as ``sheet_id``; still narrow,
    so that no answer is shuffled by user."""
    first = O.first_connections(L.sheet_links(events(spark, sf))).select("user_id", "conn_sheet_id")
    d = decisions(spark, sf).filter(F.col("reason") == "ok").join(first, "user_id", "left")
    return d.withColumn("sheet_id", F.coalesce("sheet_id", "conn_sheet_id")).filter(F.col("sheet_id").isNotNull()) \
        .drop("conn_sheet_id")


def _deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Every result with a destination: at request time, or at its user's first
    connection (the flush)."""
    parsed_answers(spark, sf)  # before the decisions, which then need no parse of their own
    sent = _enveloped(spark, sf, _sent(spark, sf)).select(
        "user_id", "url", F.col("ts").alias("created_at"), "sheet_id", F.inline(_stored(F.col("result_json"), F.col("request_id"))))
    return sent.select("request_id", "user_id", "url", "result_json", "created_at", "sheet_id")


def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """R-8/R-9: every delivered result as its 28 report cells."""
    rows = A.with_report_row(_deliveries(spark, sf))
    return rows.select("request_id", "sheet_id", "row_ok", *REPORT_COLUMNS)


def report_rows_stamped(spark: SparkSession, sf: str) -> DataFrame:
    """R-10: the same rows with the time of the audit in the first cell."""
    rows = A.with_report_row(_deliveries(spark, sf), fill_timestamp=True)
    return rows.select("request_id", "sheet_id", "row_ok", *REPORT_COLUMNS)


def sink_header_check(spark: SparkSession, sf: str) -> DataFrame:
    """S-7 over the first rows of all destinations: (sheet_id, header)."""
    return O.check_headers(_sheets(spark, sf)).select("sheet_id", "header")


def _sheets(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in: destinations with the first row that they hold, by the length
    and digits of their id: right, empty, missing or of other columns."""
    from sitelens.schemas import REPORT_HEADERS
    ids = _sent(spark, sf).select("sheet_id").distinct()
    n = F.pmod(F.crc32("sheet_id"), F.lit(4))
    right = F.array(*[F.lit(h) for h in REPORT_HEADERS])
    return ids.select("sheet_id", F.when(n == 0, right).when(n == 1, F.array().cast("array<string>"))
                      .when(n == 2, F.array(F.lit("Дата"), F.lit("Сайт"))).alias("first_row"))


def written_reports(spark: SparkSession, sf: str) -> DataFrame:
    """S-6: the report rows appended to the sink (headers checked), the run
    repeated, and the sink read back."""
    path = scratch_path(spark, "reports")
    rows, sheets = A.with_report_row(_deliveries(spark, sf)), _sheets(spark, sf)
    for _ in range(2):
        O.write_reports(rows, sheets, path, "audit")
    return O.read_reports(spark, path).select("sheet_id", "header", *REPORT_COLUMNS)


QUERIES = {
    "audit_outcome": audit_outcome,
    "result_envelope": result_envelope,
    "outbox_route": outbox_route,
    "pending_results": pending_results,
    "outbox_flush": outbox_flush,
    "outbox_unwritten": outbox_unwritten,
    "outbox_delivery": outbox_delivery,
    "outbox_append": outbox_append,
    "flush_counts": flush_counts,
    "report_rows": report_rows,
    "report_rows_stamped": report_rows_stamped,
    "sink_header_check": sink_header_check,
    "written_reports": written_reports,
}
