"""Dialog state per chat user (ST-5) as a closed form over the event log.

States: a ``start`` button opens "waiting for URL", a ``connect`` button
opens "waiting for sheet link"; re-entry is allowed, commands do not change
the state. In the URL state the first text is the audit request and ends
the dialog; in the sheet state every text is tried as a link until one
holds an id, which ends it.

Set-wise: the dialog session is the running count of buttons; a text is
handled when no earlier text of its session was (URL state) or no earlier
*valid* text was (sheet state). All are running counts of one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators.windows import running

# Event kinds of the chat log (the driver's stand-in mapping).
START_BUTTON = "click"
CONNECT_BUTTON = "signup"
TEXT_PLAIN = "view"        # a text that holds no spreadsheet id
TEXT_WITH_ID = "purchase"  # a text that holds a spreadsheet id
COMMAND = "error"          # a command; state-neutral

ORDER = ["ts", "event_id"]


# What a user's earlier rows amount to; it composes, so a log can be taken in parts.
STATE = ["session", "button", "texts", "valid"]


def states_of(log: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``log`` (event_id, ts, user_id, kind) with the dialog state in which each row
    is met: ``session``, ``state`` (its button), ``prior_texts``, ``prior_valid``.
    ``before`` (user_id, session, button, texts, valid): the users' states before
    the log; each enters as one row ahead of its user's (``first`` 0)."""
    press, text = F.col("kind").isin(START_BUTTON, CONNECT_BUTTON), F.col("kind").isin(TEXT_PLAIN, TEXT_WITH_ID)
    df = log.select(F.lit(1).alias("first"), "event_id", "ts", F.col("user_id").cast("string").alias("user_id"), "kind") \
        .withColumns({"is_button": press.cast("long"), "is_text": text.cast("long"),
                      "is_valid": (F.col("kind") == TEXT_WITH_ID).cast("long"), "button": F.when(press, F.col("kind")),
                      "resets": press.cast("long")})
    if before is not None:
        df = df.unionByName(before.select(
            F.lit(0).alias("first"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("timestamp_ntz").alias("ts"),
            "user_id", F.lit(None).cast("string").alias("kind"), F.col("session").alias("is_button"), F.col("texts").alias("is_text"),
            F.col("valid").alias("is_valid"), "button", F.lit(0).cast("long").alias("resets")))
    return running(df, "user_id", ["first", *ORDER], sums={"session": ("is_button", True)}, lasts={"state": "button"},
                   since={"prior_texts": ("is_text", "resets"), "prior_valid": ("is_valid", "resets")})


def actions(states: DataFrame) -> DataFrame:
    """(event_id, user_id, session, action) of the text events."""
    texts = states.filter((F.col("first") == 1) & (F.col("is_text") == 1))
    action = (F.when(F.col("session") == 0, F.lit("ignored"))
              .when(F.col("state") == START_BUTTON,
                    F.when(F.col("prior_texts") == 0, F.lit("audit")).otherwise(F.lit("ignored")))
              .when(F.col("state") == CONNECT_BUTTON,
                    F.when(F.col("prior_valid") > 0, F.lit("ignored"))
                    .when(F.col("is_valid") == 1, F.lit("sheet_connected")).otherwise(F.lit("sheet_invalid")))
              .otherwise(F.lit("ignored")))
    return texts.select("event_id", "user_id", "session", action.alias("action"))


def final_states(states: DataFrame) -> DataFrame:
    """(user_id, session, button, texts, valid) after each user's last row."""
    counted = lambda c: F.when(F.col("resets") > 0, F.lit(0)).otherwise(F.col(c))
    last = F.struct("session", F.col("state").alias("button"), (F.col("prior_texts") + counted("is_text")).alias("texts"),
                    (F.col("prior_valid") + counted("is_valid")).alias("valid"))
    return states.groupBy("user_id").agg(F.max_by(last, F.struct("first", *ORDER)).alias("s")).select(
        "user_id", *[F.col(f"s.{c}").cast("string" if c == "button" else "long").alias(c) for c in STATE])


def message_routing(log: DataFrame) -> DataFrame:
    """``log``: (event_id, ts, user_id, kind). Returns one row per text
    event: (event_id, user_id, session, action) with action in ``audit``,
    ``sheet_connected``, ``sheet_invalid``, ``ignored``."""
    return actions(states_of(log))
