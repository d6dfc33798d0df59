"""Test stand-ins: what the driver's tables lack, derived from them by fixed rules.

The pages hold no pricing links, hidden elements or hard character references,
no page is blank, and a page that is linked was not crawled. Each rule picks its
rows by id over the whole table; the SQL twins use the same lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.urls import with_normalized_url
from sitelens.sources.tables import pages

# Put before the html of a page, by page_id: anchors for the pricing search.
PRICING_ANCHORS = [
    '<a href="/prices">Цены</a>',
    '<a href="https://other.test/price">Прайс</a><a href="tariffs/">Тарифы</a>',
    '<a href="#цены">цены</a><a href="mailto:price@x.test">p</a>',
    '<a href="/x?plan=1">Cost of it</a>',
    "",
    '<a href="//[bad/price">x</a><a href="/pricing">y</a>',
    '<a href="/about">About</a><a href=\'/payment\'>how</a>',
]
# (html, its text): character references and markup that a plain tag pattern gets wrong.
HARD_MARKUP = [
    ("<p title=\"a>b\">&#8212;&#x27;&eacute;</p>", "—'é"),
    ("<p>&amp;lt;&rsquo;&euro;</p>", "&lt;’€"),
    ("<script>if (a<b) {x()}</script><p data-x='>'>ok</p>", "ok"),
    ("<noscript>no <b>script</b></noscript>1 < 2 ", "1 < 2 "),
    ("<template><p>later</p></template>now", "now"),
    ("", ""),
]
# (html, what is seen of it)
HIDDEN_MARKUP = [
    ('<div style="display:none">a<div>b</div>c</div>seen', "seen"),
    ('<p class="x hidden">a<b>b</b></p><p>shown</p>', "shown"),
    ('<div class=hidden>a<p>b</div><i>c</i>', "c"),
    ("<nav>n</nav><br class='hidden'>d", "d"),
    ('<p title="display:none" data-class="hidden">all seen</p>', "all seen"),
    ("", ""),
]
# Beside every page whose id leaves the remainder lies a further one with next to no text.
BLANK_EVERY, BLANK_AT, BLANK_HTML = 29, 3, "<html><body><p>soon</p></body></html>"
# What users type instead of a page's address, by request_id % TYPED_EVERY.
TYPED_EVERY = 37
TYPED = ["  ", "https://[bad", "www.Missing-1.test/", "missing-2.test?x", f"blank-{BLANK_AT}.test"]


def pick(values: list[str], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def site_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, url, html): every page with pricing anchors, and blank pages as
    further rows (negative ids, addresses of their own)."""
    all_pages = pages(spark, sf)
    blank = all_pages.where(F.pmod("page_id", F.lit(BLANK_EVERY)) == BLANK_AT).select(
        (-1 - F.col("page_id")).alias("page_id"), F.concat(F.lit("https://blank-"), F.col("page_id"), F.lit(".test/")).alias("url"),
        F.lit(BLANK_HTML).alias("html"))
    return all_pages.select("page_id", "url", F.concat(pick(PRICING_ANCHORS, F.col("page_id")), F.col("html")).alias("html")) \
        .unionByName(blank)


def marked_pages(spark: SparkSession, sf: str, markup: list[tuple[str, str]]) -> DataFrame:
    """(page_id, html): a piece of ``markup`` before each page's html."""
    return pages(spark, sf, "page_id", "html").select(
        "page_id", F.concat(pick([m for m, _ in markup], F.col("page_id")), F.col("html")).alias("html"))


def linked_pages(features: DataFrame, crawled: DataFrame) -> DataFrame:
    """The fetch of a pricing page that the crawl lacks: it gets the content of
    the page after the first one that links to it (none: the fetch fails). Only
    addresses that some page names as its pricing page are looked up."""
    firsts = features.where(F.col("pricing_key").isNotNull()).groupBy(F.col("pricing_key").alias("target")) \
        .agg(F.min("page_id").alias("src")).join(crawled.select(F.col("norm_url").alias("target")), "target", "left_anti")
    kept = [c for c in ("text", "n_text") if c in features.columns]
    content = features.select(F.col("page_id").alias("cid"), *kept)
    return firsts.join(content, F.col("cid") == F.col("src") + 1).select(
        F.col("target").alias("norm_url"), F.col("cid").alias("page_id"), *kept,
        F.lit(None).cast("string").alias("pricing_link"), F.lit(None).cast("string").alias("pricing_key"))


def typed_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """(url, norm_url): every address that a request can hold, normalised once."""
    urls = pages(spark, sf, "url").select("url").unionAll(
        spark.range(len(TYPED)).select(pick(TYPED, F.col("id")).alias("url"))).distinct()
    return with_normalized_url(urls, "url", "norm_url").select("url", "norm_url")


def typed_url(request_id: Column, page_url: Column) -> Column:
    """The address that the request was typed with."""
    out = page_url
    for i, text in enumerate(TYPED):
        out = F.when(F.pmod(request_id, F.lit(TYPED_EVERY)) == i, F.lit(text)).otherwise(out)
    return out
