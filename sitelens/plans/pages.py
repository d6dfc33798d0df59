"""Registered page queries: URL hygiene, HTML text, links, content bundle.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole ``pages`` table. The SQL twins live in ``sitelens.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import html as H
from sitelens.functions import urls as U
from sitelens.operators import bundle as B
from sitelens.operators.links import link_targets, page_links, with_pricing_link
from sitelens.plans import standin as Si
from sitelens.session import has_shared, shared_table
from sitelens.sources.tables import pages


def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    df = U.with_normalized_url(pages(spark, sf, "page_id", "url"), "url", "norm_url")
    return df.select("page_id", "url", "norm_url")


def url_valid(spark: SparkSession, sf: str) -> DataFrame:
    df = U.with_valid_url(pages(spark, sf, "page_id", "url"), "url", "is_valid")
    return df.select("page_id", "is_valid")


def url_domain(spark: SparkSession, sf: str) -> DataFrame:
    return U.with_domain(pages(spark, sf, "page_id", "url"), "url", "domain").select("page_id", "domain")


def domain_page_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Pages per site: the natural report over P-3 (partial aggregation
    before the shuffle, so a host holding a third of all pages stays cheap)."""
    return url_domain(spark, sf).groupBy("domain").agg(F.count("*").alias("n_pages"))


def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    """P-6 over every page, with a piece of hard markup before it."""
    return Si.marked_pages(spark, sf, Si.HARD_MARKUP).select("page_id", H.html_to_text("html").alias("text"))


def html_strip_tags(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf, "page_id", "html").select("page_id", H.strip_tags("html").alias("text"))


def page_js_flag(spark: SparkSession, sf: str) -> DataFrame:
    df = Si.site_pages(spark, sf).select("page_id", H.html_to_text("html").alias("text"))
    home, js = H.home_gate("text")
    return df.select("page_id", F.length("text").alias("n_chars"), (home != "").alias("home_ok"),
                     js.alias("requires_js"))


def page_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf, "page_id", "html").select(
        "page_id", H.excerpt_html("html").alias("html_excerpt"),
        H.excerpt_text(H.html_to_text("html")).alias("text_excerpt"))


def html_visible_text(spark: SparkSession, sf: str) -> DataFrame:
    """P-8 over every page, with hidden elements before it."""
    return Si.marked_pages(spark, sf, Si.HIDDEN_MARKUP).select("page_id", H.visible_text("html").alias("visible_text"))


def page_links_q(spark: SparkSession, sf: str) -> DataFrame:
    return page_links(pages(spark, sf, "page_id", "html"))


def url_join(spark: SparkSession, sf: str) -> DataFrame:
    base = U.with_normalized_url(pages(spark, sf), "url", "norm_url")
    return link_targets(base).select("page_id", "pos", "href", "abs_url")


def pricing_link(spark: SparkSession, sf: str) -> DataFrame:
    df = U.with_normalized_url(Si.site_pages(spark, sf), "url", "norm_url")
    df = with_pricing_link(df, "html", "norm_url", "pricing_link")
    return df.select("page_id", "norm_url", "pricing_link")


def crawl_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The crawl as a table, built once per input: one row per address, and the
    stand-ins for pricing pages that were not crawled."""
    features = shared_table(spark, "page_features", sf, lambda: B.page_features(Si.site_pages(spark, sf)))

    def build() -> DataFrame:
        crawled = B.snapshot(features)
        return crawled.unionByName(Si.linked_pages(features, crawled).select("norm_url", *B.SNAP_COLS))
    return shared_table(spark, "crawl_snapshot", sf, build)


def crawl_index(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of ``crawl_snapshot`` without their texts, for queries that need a page's
    flags alone: texts are turned into lengths where they are read, none is written or
    shuffled. Features that lie there with texts are used as they are."""
    if has_shared(spark, "page_features", sf):
        features = shared_table(spark, "page_features", sf, None).drop("text")
    else:
        features = shared_table(spark, "page_index", sf, lambda: B.page_features(Si.site_pages(spark, sf)).drop("text"))

    def build() -> DataFrame:
        crawled = B.snapshot(features)
        return crawled.unionByName(Si.linked_pages(features, crawled))
    return shared_table(spark, "crawl_index", sf, build)


def bundle_requests(spark: SparkSession, sf: str) -> DataFrame:
    """(request_id, url): every page's address as typed, some of them not crawled."""
    p = pages(spark, sf, "page_id", "url")
    return p.select(F.col("page_id").alias("request_id"), Si.typed_url(F.col("page_id"), F.col("url")).alias("url"))


def content_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: every typed address looked up in the crawl snapshot, its
    pricing page looked up in the same snapshot."""
    return B.content_bundle(bundle_requests(spark, sf), crawl_snapshot(spark, sf)).select(
        "request_id", "norm_url", "fetched", "home_text", "requires_js", "pricing_url", "pricing_text")


def page_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A-4: home-text length per site (the lengths the original only logs)."""
    df = U.with_domain(pages(spark, sf, "page_id", "url", "html"), "url", "domain")
    n = F.length(H.html_to_text("html"))
    return df.groupBy("domain").agg(F.count("*").alias("n_pages"), F.min(n).cast("long").alias("min_chars"),
                                    F.max(n).cast("long").alias("max_chars"), F.sum(n).cast("long").alias("sum_chars"))


QUERIES = {
    "page_length_stats": page_length_stats,
    "url_normalize": url_normalize,
    "url_valid": url_valid,
    "url_domain": url_domain,
    "domain_page_counts": domain_page_counts,
    "html_to_text": html_to_text,
    "html_strip_tags": html_strip_tags,
    "page_js_flag": page_js_flag,
    "page_excerpt": page_excerpt,
    "html_visible_text": html_visible_text,
    "page_links": page_links_q,
    "url_join": url_join,
    "pricing_link": pricing_link,
    "content_bundle": content_bundle,
}
