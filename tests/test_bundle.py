"""Content bundle semantics on a literal snapshot (J-1, J-2, P-14, P-15)."""

from pyspark.sql import functions as F
from sitelens.operators.bundle import content_bundle, snapshot

LONG = "x" * 600
MID = "y" * 120


def test_bundle_cases(spark):
    snap = spark.createDataFrame([
        ("https://a.com", 1, LONG, "https://a.com/prices", "https://a.com/prices"),   # pricing page ok
        ("https://a.com/prices", 2, MID, None, None),
        ("https://b.com", 3, MID, "https://b.com/p", "https://b.com/p"),             # pricing text too short
        ("https://b.com/p", 4, "z" * 50, None, None),
        ("https://c.com", 5, "short", "https://c.com/prices", "https://c.com/prices"),  # home under 50 chars
        ("https://c.com/prices", 6, LONG, None, None),
        ("https://d.com", 7, LONG, "https://d.com/gone", "https://d.com/gone"),      # pricing fetch fails
    ], "norm_url string, page_id long, text string, pricing_link string, pricing_key string") \
        .withColumn("n_text", F.length("text"))
    req = spark.createDataFrame([(1, "www.A.com/"), (2, "b.com"), (3, "http://c.com"), (4, "d.com"), (5, "e.com"),
                                 (6, "   ")], "request_id long, url string")
    got = {r.request_id: r for r in content_bundle(req, snap).collect()}
    a = got[1]
    assert a.fetched and a.home_text == LONG and a.requires_js is False
    assert a.pricing_url == "https://a.com/prices" and a.pricing_text == MID
    b = got[2]
    assert b.requires_js is True and b.pricing_url is None and b.pricing_text is None   # 120 < 500; 50 is not > 50
    c = got[3]
    assert c.home_text == "" and c.requires_js is True and c.pricing_url is None
    d = got[4]
    assert d.fetched and d.pricing_url is None
    assert not got[5].fetched and got[5].home_text is None
    assert got[6].norm_url == "" and not got[6].fetched


def test_latest_page_of_an_address_wins(spark):
    df = spark.createDataFrame([("https://a.com", 1, "old", 3, None, None), ("https://a.com", 9, "new", 3, "l", "k"),
                                ("https://b.com", 4, "b", 1, None, None)],
                               "norm_url string, page_id long, text string, n_text int, pricing_link string, pricing_key string")
    assert {r.norm_url: r.text for r in snapshot(df).collect()} == {"https://a.com": "new", "https://b.com": "b"}


def test_repeated_page_rows_are_one_page(spark):
    """J-1: a page that is in the table twice answers a request once."""
    rows = [("https://a.com", 1, LONG, "https://a.com/p", "https://a.com/p")] * 3 + [("https://a.com/p", 2, MID, None, None)] * 2
    features = spark.createDataFrame(rows, "norm_url string, page_id long, text string, pricing_link string, pricing_key string") \
        .withColumn("n_text", F.length("text"))
    req = spark.createDataFrame([(1, "a.com")], "request_id long, url string")
    got = content_bundle(req, snapshot(features)).collect()
    assert len(got) == 1 and got[0].pricing_text == MID
