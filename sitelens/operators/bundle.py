"""Content bundle: request URL -> home page -> pricing page (J-1, J-2).

The original fetches two pages per audit over HTTP. Here both fetches are
lookups into a page-snapshot table keyed by normalised URL:

* ``page_features`` runs the per-page work once, map-side: URL normalisation,
  HTML -> text, the in-row pricing-link search, the normalised pricing key and
  the text's length. Html does not cross a shuffle.
* ``snapshot`` keeps one row per normalised URL (largest ``page_id`` wins): the
  winner is found on two narrow columns, texts are joined to it afterwards.
* ``bundle_flags`` decides home and pricing page from keys and lengths alone; a
  page without a pricing link has no key and takes no part in the lookup.
* ``content_bundle`` joins requests to the flags and attaches each text once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.html import HOME_MIN_CHARS, JS_SUSPECT_CHARS, PRICING_MIN_CHARS, html_to_text
from sitelens.functions.text import strip_ws
from sitelens.functions.urls import with_normalized_url
from sitelens.operators.links import with_pricing_link

SNAP_COLS = ["page_id", "text", "n_text", "pricing_link", "pricing_key"]


def page_features(pages: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """(page_id, norm_url, text, n_text, pricing_link, pricing_key) for every
    page row; ``pricing_key`` is the pricing link normalised for the lookup, so
    requests never re-parse it; ``n_text`` the stripped text's length."""
    df = with_normalized_url(pages.select("page_id", "url", "html"), "url", "norm_url")
    df = df.withColumn("text", html_to_text("html")).withColumn("n_text", F.length(strip_ws("text")))
    df = with_pricing_link(df, "html", "norm_url", "pricing_link", keywords)
    df = with_normalized_url(df, "pricing_link", "pricing_key")
    return df.select("page_id", "norm_url", "text", "n_text", "pricing_link",
                     F.when(F.col("pricing_link").isNotNull(), F.col("pricing_key")).alias("pricing_key"))


def snapshot(features: DataFrame) -> DataFrame:
    """One row per normalised URL; the largest ``page_id`` wins, and rows repeated
    under one id are one page. ``features`` should be a table: it is read twice, once
    without its texts. Features without ``text`` give a snapshot without it."""
    winners = features.groupBy("norm_url").agg(F.max("page_id").alias("page_id"))
    newest = features.join(winners, ["norm_url", "page_id"], "left_semi")
    return newest.dropDuplicates(["norm_url", "page_id"]).select("norm_url", *[c for c in SNAP_COLS if c in features.columns])


def bundle_flags(snap: DataFrame) -> DataFrame:
    """Per snapshot URL, without texts: ``norm_url, home_ok, requires_js,
    pricing_url, pricing_key`` (the last two set only when the pricing page is kept).

    Home text shorter than 50 characters counts as none (``requires_js`` true,
    no pricing lookup); otherwise ``requires_js`` is ``length < 500``. The
    pricing page is kept only when its text is longer than 50 characters.
    """
    pages = snap.select("norm_url", "n_text", "pricing_link", "pricing_key")
    asked = pages.where((F.col("n_text") >= HOME_MIN_CHARS) & F.col("pricing_key").isNotNull()) \
        .select("norm_url", "pricing_link", "pricing_key")
    found = pages.where(F.col("n_text") > PRICING_MIN_CHARS).select(F.col("norm_url").alias("pricing_key"))
    kept = asked.join(found, "pricing_key", "left_semi").select(
        F.col("norm_url").alias("_of"), F.col("pricing_link").alias("pricing_url"), "pricing_key")
    homes = pages.select("norm_url", (F.col("n_text") >= HOME_MIN_CHARS).alias("home_ok"),
                         (F.col("n_text") < JS_SUSPECT_CHARS).alias("requires_js"))
    return homes.join(kept, F.col("norm_url") == F.col("_of"), "left").drop("_of")


def with_flags(requests: DataFrame, snap: DataFrame) -> DataFrame:
    """``requests`` (with ``norm_url``) and ``fetched`` (a snapshot row exists),
    ``home_ok``, ``requires_js``, ``pricing_url``, ``pricing_key``."""
    flags = bundle_flags(snap).withColumnRenamed("norm_url", "_url").withColumn("_hit", F.lit(True))
    return requests.join(flags, F.col("norm_url") == F.col("_url"), "left") \
        .withColumn("fetched", F.col("_hit").isNotNull()).drop("_hit", "_url")


def content_bundle(requests: DataFrame, snap: DataFrame, url_col: str = "url") -> DataFrame:
    """Per request: ``norm_url``, ``fetched``, ``home_text`` ('' when too
    short), ``requires_js``, ``pricing_url``, ``pricing_text``."""
    df = with_flags(with_normalized_url(requests, url_col, "norm_url"), snap)
    homes = snap.where(F.col("n_text") >= HOME_MIN_CHARS).select(F.col("norm_url").alias("_home"), F.col("text").alias("_htext"))
    prices = snap.select(F.col("norm_url").alias("_price"), F.col("text").alias("pricing_text"))
    df = df.join(homes, F.col("norm_url") == F.col("_home"), "left")
    df = df.join(prices, F.col("pricing_key") == F.col("_price"), "left")
    return df.withColumn("home_text", F.when(F.col("fetched"), F.coalesce("_htext", F.lit("")))) \
        .drop("_home", "_htext", "_price", "pricing_key")
