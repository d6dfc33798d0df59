"""Chat/audit event logs derived from the ``events`` table.

The audited application keeps its state in three small tables updated one
statement at a time. Here that state is derived from append-only logs:

* audit requests: every ``click``, ``view``, ``purchase`` and ``error`` event
  is an audit request of its user; ``error`` means the audit failed, the
  others would succeed if admitted;
* destination connections: ``signup`` events with ``props.k < 80`` carry a
  spreadsheet link (every tenth one, and all of some users, without an id, which
  is rejected);
* limit commands: ``signup`` events with ``props.k >= 80`` are
  ``/set_limit <target> <n>`` commands issued by the event's user, with
  malformed variants (one argument, a word, a negative number) mixed in.

The mapping is the test stand-in for the real logs; every derived log reads
the whole ``events`` table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import strip_ws
from sitelens.functions.urls import extract_sheet_id
from sitelens.schemas import SHEET_URL_PREFIX

REQUEST_KINDS = ["click", "view", "purchase", "error"]
FAILED_KIND = "error"
SETTING_KIND = "signup"
COMMAND_MIN_K = 80
# Users whose id leaves this remainder only ever send links without an id.
NEVER_CONNECTS = (7, 5)
# Administrators allowed to change limits (comma-separated, blanks skipped).
ADMIN_IDS = "0,1, 2,3 ,4,5,6,7,8,9, "


def k_of(props: str = "props") -> Column:
    return F.get_json_object(F.col(props), "$.k").cast("long")


def audit_requests(events: DataFrame) -> DataFrame:
    """(request_id, user_id, ts, kind, would_succeed)."""
    return (events.filter(F.col("event_type").isin(REQUEST_KINDS))
            .select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("user_id"),
                    "ts", F.col("event_type").alias("kind"),
                    (F.col("event_type") != FAILED_KIND).alias("would_succeed")))


def sheet_links(events: DataFrame) -> DataFrame:
    """(event_id, ts, user_id, link, sheet_id): destination connections."""
    k = k_of()
    without_id = (F.pmod(k, F.lit(10)) == 0) | (F.pmod(F.col("user_id"), F.lit(NEVER_CONNECTS[0])) == NEVER_CONNECTS[1])
    link = F.when(without_id, F.lit("https://docs.google.com/spreadsheets/u/0/")) \
        .otherwise(F.concat(F.lit(SHEET_URL_PREFIX), F.lit("sh"), k.cast("string"), F.lit("/edit#gid=0")))
    return (events.filter((F.col("event_type") == SETTING_KIND) & (k < COMMAND_MIN_K))
            .select("event_id", "ts", F.col("user_id").cast("string").alias("user_id"), link.alias("link"))
            .withColumn("sheet_id", extract_sheet_id("link")))


def command_args(k: Column) -> Column:
    """The words after ``/set_limit`` of a command event."""
    target = k.cast("string")
    n = (F.floor(F.col("value")).cast("long") % 30).cast("string")
    m = F.pmod(k, F.lit(5))
    return (F.when(m == 0, F.array(target))
            .when(m == 1, F.array(target, F.lit("ten")))
            .when(m == 2, F.array(target, (-(F.pmod(k, F.lit(3))) - 1).cast("string")))
            .otherwise(F.array(target, n)))


def limit_commands(events: DataFrame) -> DataFrame:
    """(event_id, ts, actor, args): ``/set_limit`` commands as issued."""
    k = k_of()
    args = command_args(k)
    return (events.filter((F.col("event_type") == SETTING_KIND) & (k >= COMMAND_MIN_K))
            .select("event_id", "ts", F.col("user_id").alias("actor"), args.alias("args")))


def is_admin(actor, admin_ids: str = ADMIN_IDS) -> Column:
    """F-4: actor in the comma-separated id list; blanks skipped; any
    non-integer entry makes the check fail for everyone."""
    ids = F.transform(F.filter(F.transform(F.split(F.lit(admin_ids), ","), lambda x: strip_ws(x)),
                               lambda x: x != ""), lambda x: x.try_cast("long"))
    actor = F.col(actor) if isinstance(actor, str) else actor
    return ~F.exists(ids, lambda x: x.isNull()) & F.array_contains(ids, actor)


def limit_arg_ok(args: str = "args") -> Column:
    """F-5: exactly two arguments and a non-negative integer limit."""
    a = F.col(args)
    n = F.get(a, 1).try_cast("long")
    return (F.size(a) == 2) & F.coalesce(n >= 0, F.lit(False))


def limit_changes(events: DataFrame, admin_ids: str = ADMIN_IDS) -> DataFrame:
    """(event_id, ts, user_id, max_limit): accepted limit changes (target
    user as text), i.e. F-4 and F-5 applied to the commands."""
    c = limit_commands(events)
    ok = is_admin("actor", admin_ids) & limit_arg_ok()
    return c.filter(ok).select("event_id", "ts", F.get(F.col("args"), 0).alias("user_id"),
                               F.get(F.col("args"), 1).cast("long").alias("max_limit"))


def quota_timeline(events: DataFrame, admin_ids: str = ADMIN_IDS) -> DataFrame:
    """(user_id, ts, request_id, ws, new_limit): audit requests and accepted
    limit changes in one projection (works on a stream as well as a table)."""
    k = k_of()
    is_req = F.col("event_type").isin(REQUEST_KINDS)
    is_cmd = (F.col("event_type") == SETTING_KIND) & (k >= COMMAND_MIN_K)
    df = events.filter(is_req | is_cmd).select("event_id", "ts", "user_id", "event_type", is_req.alias("is_req"),
                                               command_args(k).alias("args"))
    df = df.filter(F.col("is_req") | (is_admin("user_id", admin_ids) & limit_arg_ok()))
    return df.select(F.when(F.col("is_req"), F.col("user_id").cast("string")).otherwise(F.get("args", 0)).alias("user_id"), "ts",
                     F.col("event_id").alias("request_id"),
                     F.when(F.col("is_req"), (F.col("event_type") != FAILED_KIND).cast("long")).otherwise(F.lit(0)).alias("ws"),
                     F.when(~F.col("is_req"), F.get("args", 1).try_cast("long")).alias("new_limit"))
