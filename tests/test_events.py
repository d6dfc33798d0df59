"""Limit-command validation and dialog routing on literal logs."""

import datetime as dt

from pyspark.sql import functions as F

from sitelens.operators.dialog import message_routing
from sitelens.sources import eventlog as L

T0 = dt.datetime(2024, 1, 1)


def test_admin_parsing_and_command_validation(spark):
    cmds = spark.createDataFrame([
        (1, T0, 3, ["42", "5"]),        # admin, valid
        (2, T0, 77, ["42", "5"]),       # not an admin
        (3, T0, 3, ["42"]),             # one argument
        (4, T0, 3, ["42", "ten"]),      # not a number
        (5, T0, 3, ["42", "-1"]),       # negative
        (6, T0, 3, ["42", "0"]),        # zero is allowed
    ], "event_id long, ts timestamp_ntz, actor long, args array<string>")
    ok = cmds.filter(L.is_admin("actor", " 3, ,4") & L.limit_arg_ok())
    assert sorted(r.event_id for r in ok.collect()) == [1, 6]
    # a non-integer entry in the admin list fails every check
    assert cmds.filter(L.is_admin("actor", "3,x")).count() == 0


def test_dialog_routing_cases(spark):
    ev = [("click", 1), ("view", 2), ("view", 3),                  # second text after start: ignored
          ("signup", 4), ("view", 5), ("error", 6), ("purchase", 7), ("view", 8),  # invalid, command, valid, after
          ("click", 9), ("signup", 10), ("purchase", 11),          # button mid-dialog re-enters
          ("view", 0)]                                             # text before any button
    rows = [(i, T0 + dt.timedelta(minutes=m), 5, k) for i, (k, m) in enumerate(ev)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, kind string")
    got = {r.event_id: r.action for r in message_routing(df).collect()}
    assert got == {1: "audit", 2: "ignored", 4: "sheet_invalid", 6: "sheet_connected", 7: "ignored",
                   10: "sheet_connected", 11: "ignored"}
