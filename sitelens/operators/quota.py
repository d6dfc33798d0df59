"""Settings, limits and quota over append-only logs (W-1..W-3b, F-1, A-1, J-5, J-8).

The original keeps ``users_settings`` and ``users_limits`` rows and updates
them statement by statement. Set-wise:

* latest destination per user (``INSERT OR REPLACE``): ``max_by`` over
  ``(ts, event_id)``, a partial+final aggregate;
* initial limit row (``INSERT OR IGNORE``): ``min_by`` over the first event;
* admission with a fixed limit: a request is admitted iff the user's earlier
  would-succeed requests number fewer than the limit, a running count;
* admission with limit changes: a range of a user's rows is one composable map of
  the counter (``operators.replay``).

Both use range-partitioned timelines (``operators.windows``), so a user who holds
a large share of the log is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators.replay import replayed
from sitelens.operators.windows import running
from sitelens.schemas import DEFAULT_USER_LIMIT

ORDER = ["ts", "request_id"]


def settings_latest(links: DataFrame) -> DataFrame:
    """W-1: (user_id, sheet_id), the last valid connection per user."""
    ok = links.filter(F.col("sheet_id") != "")
    return ok.groupBy("user_id").agg(F.max_by("sheet_id", F.struct("ts", "event_id")).alias("sheet_id"))


def limits_initial(requests: DataFrame, changes: DataFrame, default: int = DEFAULT_USER_LIMIT) -> DataFrame:
    """W-2: (user_id, current, max_limit) as first created: by the user's
    first request (default limit) or first accepted limit change."""
    ev = requests.select("user_id", "ts", F.col("request_id").alias("event_id"),
                         F.lit(default).cast("long").alias("max_limit")) \
        .unionByName(changes.select("user_id", "ts", "event_id", "max_limit"))
    return ev.groupBy("user_id").agg(F.min_by("max_limit", F.struct("ts", "event_id")).alias("max_limit")) \
        .select("user_id", F.lit(0).cast("long").alias("current"), "max_limit")


def quota_admission(requests: DataFrame, limit: int = DEFAULT_USER_LIMIT) -> DataFrame:
    """W-3/F-1: adds ``prior_ok`` and ``admitted`` for a fixed limit."""
    df = requests.withColumn("__ws", F.col("would_succeed").cast("long"))
    df = running(df, "user_id", ORDER, sums={"prior_ok": ("__ws", False)}).drop("__ws")
    return df.withColumn("admitted", F.col("prior_ok") < F.lit(limit))


def usage_counts(limits: DataFrame) -> DataFrame:
    """A-1: (user_id, current) of the final limits rows."""
    return limits.select("user_id", "current")


def timeline_of(requests: DataFrame, changes: DataFrame) -> DataFrame:
    """(user_id, ts, request_id, ws, new_limit) from requests and accepted changes."""
    req = requests.select("user_id", "ts", "request_id", F.col("would_succeed").cast("long").alias("ws"),
                          F.lit(None).cast("long").alias("new_limit"))
    chg = changes.select("user_id", "ts", F.col("event_id").alias("request_id"), F.lit(0).cast("long").alias("ws"),
                         F.col("max_limit").alias("new_limit"))
    return req.unionByName(chg)


def limit_asof(timeline: DataFrame, default: int = DEFAULT_USER_LIMIT) -> DataFrame:
    """J-8/J-5: per request, the limit in force (last accepted change before
    it, else the default): (request_id, user_id, max_limit)."""
    tl = running(timeline, "user_id", ORDER, lasts={"lim": "new_limit"})
    return tl.filter(F.col("new_limit").isNull()).select(
        "request_id", "user_id", F.coalesce("lim", F.lit(default).cast("long")).alias("max_limit"))


def replay_timeline(timeline: DataFrame, default: int = DEFAULT_USER_LIMIT, keep: list[str] | None = None,
                    order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """W-3b: exact replay of check-then-increment with limit changes over
    ``(user_id, ts, request_id, ws, new_limit)``.

    Returns ``(per_request, final_state)``: per request ``(request_id,
    user_id, admitted, max_limit, *keep)``; per user the final ``(user_id,
    current, max_limit)`` row of the limits table.
    """
    order = order or ORDER
    rows = replayed(timeline, order, default)
    per = rows.where(F.col("new_limit").isNull()).select("request_id", "user_id", "admitted", "max_limit", *(keep or []))
    used = F.sum(F.when(F.col("admitted"), F.coalesce("ws", F.lit(0))).otherwise(F.lit(0)))
    final = rows.groupBy("user_id").agg(used.cast("long").alias("current"),
                                        F.max_by("max_limit", F.struct(*order)).alias("max_limit"))
    return per, final


def quota_replay(requests: DataFrame, changes: DataFrame, default: int = DEFAULT_USER_LIMIT) -> tuple[DataFrame, DataFrame]:
    return replay_timeline(timeline_of(requests, changes), default)
