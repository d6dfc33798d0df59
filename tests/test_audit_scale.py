"""What the audit and outbox queries must not carry or repeat as their input grows."""

import os
from collections import Counter

from conftest import SF_SMALL
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.operators import outbox as O
from sitelens.plans import audit as Au
from sitelens.plans import pages as P
from sitelens.session import drop_tables, has_shared, scratch_path
from sitelens.streaming import streams as ST


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_audit_index_has_no_texts(spark):
    """The audit writes no page text, and its index is the snapshot without texts."""
    drop_tables(spark)
    Au.decisions(spark, SF_SMALL)
    assert has_shared(spark, "crawl_index", SF_SMALL) and not has_shared(spark, "crawl_snapshot", SF_SMALL)
    assert not has_shared(spark, "parsed_answers", SF_SMALL)
    index = P.crawl_index(spark, SF_SMALL)
    assert "text" not in index.columns
    whole = P.crawl_snapshot(spark, SF_SMALL).drop("text").select(*index.columns)
    rows = Counter(tuple(r) for r in index.collect())
    assert rows and rows == Counter(tuple(r) for r in whole.collect())


def test_index_from_features_that_are_there(spark):
    drop_tables(spark)
    want = Counter(tuple(r) for r in P.crawl_index(spark, SF_SMALL).collect())
    drop_tables(spark)
    P.crawl_snapshot(spark, SF_SMALL)
    assert Counter(tuple(r) for r in P.crawl_index(spark, SF_SMALL).collect()) == want
    assert not has_shared(spark, "page_index", SF_SMALL)


def test_results_are_not_joined(spark):
    """The topmost join is the one that brings the answers: none lies above the envelopes."""
    joins = [line for line in plan(Au._deliveries(spark, SF_SMALL)) if "Join " in line]
    assert len(joins) == 2 and "doc_id" in joins[0] and "user_id" in joins[1]


def test_delivery_rounds_read_a_table(spark, monkeypatch):
    """The parked rows are worked out once, not once a round."""
    due = []
    deliver = O.deliver
    monkeypatch.setattr(O, "deliver", lambda df, *a: (due.append(plan(df)), deliver(df, *a))[1])
    assert Au.outbox_delivery(spark, SF_SMALL).count()
    assert len(due) == len(Au.ROUNDS) + 1 and not [x for p in due for x in p if "Join " in x]


def test_files_of_an_epoch(spark, tmp_path):
    """A day and bucket of an epoch is one file, however many tasks the batch has."""
    rows = spark.range(400).select(
        F.col("id").alias("request_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("sheet_id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 4 as int))").alias("created_at")).repartition(16)
    sink = scratch_path(spark, "few-files")
    ST.deliver_reports(sink, T.StructType(rows.schema.fields))(rows, 0)
    found = Counter(at for at, _, names in os.walk(sink) for n in names if n.endswith(".parquet"))
    assert len(found) > 4 and set(found.values()) == {1}
    assert spark.read.option("recursiveFileLookup", "true").schema(rows.schema).parquet(f"{sink}/data").count() == 400
