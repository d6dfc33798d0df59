"""Every registered query at sf0.001 against its DuckDB twin, and the entry
point's flagship query."""

import collections
import os
import sys

import duckdb
import pytest

from conftest import SF_CHECK, SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import normalise  # noqa: E402
from sitelens.plans import registry  # noqa: E402
from sitelens.sources.tables import TABLES  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


OWN = sorted(registry.queries())


def test_every_key_has_sql_or_is_rows_only():
    assert set(OWN) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", OWN)
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    scols, srows = normalise(df.columns, df.collect())
    sql = E.oracle_sql().get(key)
    assert len(srows) > 0
    res = duck.execute(sql)
    dcols, drows = normalise([d[0] for d in res.description], res.fetchall())
    assert scols == dcols
    assert srows == drows


def test_entry_flagship(spark):
    df = E.entry(spark)
    assert df.columns == ["request_id", "norm_url", "fetched", "home_text", "requires_js", "pricing_url",
                          "pricing_text"]
    assert df.count() > 0


def test_all_branches_occur(spark):
    """The stand-in data reach every branch that a query decides."""
    q = E.queries()
    outcome = q["audit_outcome"](spark, SF_CHECK)
    assert {r.reason for r in outcome.select("reason").distinct().collect()} == {
        None, "limit", "invalid_url", "fetch_failed", "internal_error"}
    assert {r.error for r in outcome.select("error").distinct().collect()} == {
        None, "page not reached", "model call failed", "answer is not a record"}
    assert {r.written_now for r in outcome.select("written_now").distinct().collect()} == {None, True, False}
    errors = {r.offer_first_screen for r in q["report_rows"](spark, SF_CHECK).where("not row_ok").collect()}
    assert len(errors) == 5
    assert q["outbox_unwritten"](spark, SF_CHECK).count() > 0 and q["pending_for_user"](spark, SF_CHECK).count() > 0
    assert {r["round"] for r in q["outbox_delivery"](spark, SF_CHECK).collect()} == {0, 1, 2}
    assert {r.header for r in q["sink_header_check"](spark, SF_CHECK).collect()} == {"ok", "create", "mismatch"}
    bundle = q["content_bundle"](spark, SF_CHECK).collect()
    assert {r.fetched for r in bundle} == {True, False} and "" in {r.home_text for r in bundle}
    assert {r.pricing_url is None for r in bundle} == {True, False} and {r.requires_js for r in bundle} == {True, False, None}
    quality = q["answer_quality"](spark, SF_CHECK).first().asDict()
    assert all(0 < n < quality["n_answers"] for k, n in quality.items() if k.startswith("n_fail"))
    assert {r.parse_ok for r in q["batch_score"](spark, SF_CHECK).collect()} == {True, False}


def test_answers_hold_every_character(spark):
    """Whole texts: what the answers hold is what the documents hold."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    for r in E.queries()["json_unwrap"](spark, SF_CHECK).collect():
        have = "".join(c for c in r.json_text if c.isalnum())
        want = "".join(c for c in docs[r.doc_id] if c.isalnum())
        assert len(have) >= len(want), r.doc_id
        assert not collections.Counter(want) - collections.Counter(have), r.doc_id
