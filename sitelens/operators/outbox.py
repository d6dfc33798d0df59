"""Result routing and the outbox (J-3, J-4, J-7, S-4, S-5, S-7, A-3, W-4).

The original writes a finished audit to the user's spreadsheet when one is
connected and otherwise parks it in ``pending_results``; connecting a
spreadsheet flushes the parked rows in ``created_at`` order and marks them.

Set-wise over the logs:

* a result is parked iff the user had no valid connection before it. Hence
  every parked row is flushed by the user's *first* valid connection, and
  later connections flush nothing. Route and flush are an aggregate
  (``min_by`` over connections, partial + final) and a join, no sequential
  per-user loop;
* the destination of a direct write is the latest connection before the
  request (as-of, ``operators.windows``);
* rows are appended in runs (``sources.runs``): a repeated run adds nothing, and
  row ids go on from run to run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.operators.windows import running
from sitelens.schemas import REPORT_COLUMNS, REPORT_HEADERS
from sitelens.session import materialize
from sitelens.sources.runs import Runs


def first_connections(links: DataFrame) -> DataFrame:
    """(user_id, conn_ts, conn_event_id, conn_sheet_id): the first valid
    connection per user."""
    ok = links.filter(F.col("sheet_id") != "")
    first = F.min_by(F.struct("ts", "event_id", "sheet_id"), F.struct("ts", "event_id"))
    return ok.groupBy("user_id").agg(first.alias("c")).select(
        "user_id", F.col("c.ts").alias("conn_ts"), F.col("c.event_id").alias("conn_event_id"),
        F.col("c.sheet_id").alias("conn_sheet_id"))


def destinations(requests: DataFrame, links: DataFrame) -> DataFrame:
    """(request_id, user_id, ts, sheet_id): the destination connected when the
    request was made, null before the first connection. ``requests`` needs
    (request_id, user_id, ts); wide columns are better joined afterwards."""
    conn = links.filter(F.col("sheet_id") != "").select(
        "user_id", "ts", F.col("event_id").alias("request_id"), F.col("sheet_id").alias("new_sheet"))
    tl = requests.select("user_id", "ts", "request_id", F.lit(None).cast("string").alias("new_sheet")).unionByName(conn)
    tl = running(tl, "user_id", ["ts", "request_id"], lasts={"sheet_id": "new_sheet"})
    return tl.filter(F.col("new_sheet").isNull()).select("request_id", "user_id", "ts", "sheet_id")


def with_route(results: DataFrame) -> DataFrame:
    """J-3: adds ``route``: ``write`` with a destination, else ``pending``."""
    return results.withColumn("route", F.when(F.col("sheet_id").isNotNull(), F.lit("write")).otherwise(F.lit("pending")))


def row_key(*cols: str) -> F.Column:
    """W-4: an id that follows from a row's content, so that a replayed write
    makes the same id."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)


def pending_rows(routed: DataFrame, links: DataFrame) -> DataFrame:
    """S-5/S-4/J-4: the outbox table with its delivery: (id, row_key, user_id,
    url, created_at, written, flush_event_id, flushed_to)."""
    conn = first_connections(links)
    p = routed.filter(F.col("route") == "pending").select(
        F.col("request_id").alias("id"), "user_id", "url", F.col("ts").alias("created_at"))
    return (p.join(conn, "user_id", "left")
            .withColumn("written", F.col("conn_event_id").isNotNull())
            .select("id", row_key("id", "user_id", "url").alias("row_key"), "user_id", "url", "created_at", "written",
                    F.col("conn_event_id").alias("flush_event_id"), F.col("conn_sheet_id").alias("flushed_to"),
                    F.col("conn_ts").alias("flushed_at")))


def with_row_ids(pending: DataFrame) -> DataFrame:
    """W-4: ``row_id`` 1, 2, ... in the order of insertion, as an auto-increment
    column numbers rows: a running count over ranges, not one sorted partition."""
    numbered = running(pending.withColumn("__all", F.lit(0)).withColumn("__one", F.lit(1)), "__all", ["created_at", "id"],
                       sums={"row_id": ("__one", True)})
    return numbered.drop("__all", "__one")


DELIVERED = "id long, round int"


def undelivered(pending: DataFrame, delivered: DataFrame) -> DataFrame:
    """J-7: parked rows without a mark in the log of delivered ids."""
    return pending.join(delivered.select("id"), "id", "left_anti")


def deliver(due: DataFrame, log_path: str, round_: int) -> None:
    """J-4/J-7: one delivery round. Rows whose id the log holds are left out;
    the ids of the others are the round's own folder of the log, written with
    overwrite, so a round that is repeated after a failure marks nothing twice."""
    spark = due.sparkSession
    log = spark.createDataFrame([], DELIVERED) if round_ == 0 else spark.read.parquet(
        *[f"{log_path}/{r}" for r in range(round_)])
    undelivered(due, log).select("id", F.lit(round_).alias("round")).write.mode("overwrite").parquet(f"{log_path}/{round_}")


def unwritten(pending: DataFrame) -> DataFrame:
    """J-7/F-3: rows still waiting for a destination, oldest first."""
    return pending.filter(~F.col("written")).select("id", "user_id", "url", "created_at") \
        .orderBy("created_at", "id")


def flush_counts(pending: DataFrame, links: DataFrame) -> DataFrame:
    """A-3: rows flushed per valid connection event (0 when none)."""
    n = pending.filter(F.col("written")).groupBy(F.col("flush_event_id").alias("event_id")) \
        .agg(F.count("*").alias("n_flushed"))
    ok = links.filter(F.col("sheet_id") != "").select("event_id", "user_id")
    return ok.join(n, "event_id", "left").select("event_id", "user_id",
                                                 F.coalesce("n_flushed", F.lit(0)).cast("long").alias("n_flushed"))


def header_check(existing) -> F.Column:
    """S-7: ``ok`` when the sink's first row equals the 28 headers,
    ``create`` when it is empty/unreadable (null or []), else ``mismatch``
    (kept as it is, as the original does)."""
    c = F.col(existing) if isinstance(existing, str) else existing
    expected = F.array(*[F.lit(h) for h in REPORT_HEADERS])
    return (F.when(c.isNull() | (F.size(c) == 0), F.lit("create"))
            .when(c == expected, F.lit("ok")).otherwise(F.lit("mismatch")))


def check_headers(sheets: DataFrame) -> DataFrame:
    """``sheets`` (sheet_id, first_row) with ``header``: see ``header_check``."""
    return sheets.withColumn("header", header_check("first_row"))


PARKED = "row_id long, id long, user_id string, url string, created_at timestamp_ntz"


def append_pending(pending: DataFrame, path: str, run: str) -> bool:
    """S-5/W-4: parked rows (id, user_id, url, created_at) appended as one run. Row
    ids go on after the largest one of the earlier runs, which their records hold;
    a run that is repeated adds nothing (False)."""
    table = Runs(pending.sparkSession, path, PARKED)
    done = table.committed()
    if run in done:
        return False
    high = max([r["last_row_id"] for r in done.values()], default=0)
    rows = materialize(with_row_ids(pending).select((F.col("row_id") + high).alias("row_id"), "id", "user_id", "url", "created_at"),
                       "parked")
    return table.append(rows, run, last_row_id=high + rows.count())


def parked(spark: SparkSession, path: str) -> DataFrame:
    """S-4: the appended rows of all committed runs."""
    return Runs(spark, path, PARKED).read()


SINK_BUCKETS = 16
SINK = T.StructType([T.StructField(n, T.StringType()) for n in ["sheet_id", "header", *REPORT_HEADERS]])


def write_reports(rows: DataFrame, sheets: DataFrame, path: str, run: str | None = None) -> bool:
    """S-6/S-7: append report rows to the sink as one run, with the outcome of the
    header rule for their destination (``create``: the headers are written with the
    rows; ``mismatch``: the rows go in below the other headers, as in the
    original). A run that the sink holds is not written again (False); without a
    name every call is a run of its own. Files are laid out by day and a bucket of
    the destination, not by destination, so their number does not grow with the
    users."""
    out = rows.join(check_headers(sheets).select("sheet_id", "header"), "sheet_id", "left")
    out = out.withColumn("header", F.coalesce("header", F.lit("create"))) \
        .withColumn("day", F.to_date("created_at")) \
        .withColumn("bucket", F.pmod(F.crc32("sheet_id"), F.lit(SINK_BUCKETS)).cast("int"))
    cells = [F.col(c).alias(h) for c, h in zip(REPORT_COLUMNS, REPORT_HEADERS)]
    out = out.select("sheet_id", "header", *cells, "day", "bucket").repartition("day", "bucket")
    return Runs(rows.sparkSession, path, SINK).append(out, run or uuid.uuid4().hex, by=["day", "bucket"])


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the sink's committed runs under their column names."""
    return Runs(spark, path, SINK).read().select(
        "sheet_id", "header", *[F.col(f"`{h}`").alias(c) for c, h in zip(REPORT_COLUMNS, REPORT_HEADERS)])
