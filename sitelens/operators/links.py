"""Anchor extraction and the pricing-page search (P-12, P-13, W-5).

The pricing search is done inside each page row with higher-order array
functions: the page's anchors are an array, keyword candidates are filtered
in order and the first decisive one is taken. No explode, no shuffle; only
the chosen link is resolved to an absolute URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import urls as U

# The anchor pattern (case-insensitive, dot matches newline):
# link text with nested tags does not match; a greedy prefix means the LAST
# href= inside the tag wins (data-href= too); the href is not entity-decoded.
LINK_PATTERN = r"""(?is)<a[^>]*href=["']([^"']+)["'][^>]*>([^<]*)</a>"""
# Keywords that mark a pricing link (substring match on lower-cased
# "href text").
PRICING_KEYWORDS = ["цены", "цена", "тариф", "тарифы", "стоимость", "прайс",
                    "pricing", "price", "prices", "tariff", "cost", "payment", "план"]
# Links that never count as a pricing page, by raw href prefix.
SKIPPED_HREF_PREFIXES = ["#", "mailto:", "tel:"]


# The same pattern for one whole anchor: the search above it has found its ends.
_ANCHOR = "^" + LINK_PATTERN.removeprefix("(?is)") + "$"


def anchors(html) -> Column:
    """array<struct<href, text>> in document order: one pass over the page, the
    parts are taken from the short anchors."""
    one = "(?is)" + _ANCHOR
    found = F.regexp_extract_all(html if not isinstance(html, str) else F.col(html), F.lit(LINK_PATTERN), F.lit(0))
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, one, 1).alias("href"),
                                                 F.regexp_extract(a, one, 2).alias("text")))


def keyword_regex(keywords: list[str]) -> str:
    """Alternation of literal keywords (each quoted)."""
    return "(" + "|".join(r"\Q" + k + r"\E" for k in keywords) + ")"


def page_links(pages: DataFrame, html_col: str = "html", id_col: str = "page_id",
               keep: list[str] | None = None) -> DataFrame:
    """(page_id, pos, href, text, *keep): every anchor in document order
    (P-12). A narrow explode of each page row; no shuffle."""
    keep = list(keep or [])
    return (pages.select(id_col, *keep, F.posexplode(anchors(html_col)).alias("pos", "link"))
            .select(id_col, "pos", F.col("link.href").alias("href"), F.col("link.text").alias("text"), *keep))


def with_pricing_link(df: DataFrame, html_col: str, base_col: str, out: str,
                      keywords: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the first pricing link of the page as an absolute URL,
    or null (P-13).

    In document order, the first anchor whose lower-cased ``href + ' ' +
    text`` contains a keyword, whose resolved authority equals the base
    URL's (case- and port-sensitive) and whose raw href does not start with
    ``#``, ``mailto:`` or ``tel:``. A keyword link before the hit that cannot
    be resolved (malformed bracketed host) makes the whole page null.
    """
    kw = keyword_regex(keywords or PRICING_KEYWORDS)
    t = f"__{out}"
    df = U.with_url_parts(df, base_col, f"{t}b")
    B = lambda n: F.col(f"{t}b_{n}")

    def skip(h):
        hit = F.lit(False)
        for prefix in SKIPPED_HREF_PREFIXES:
            hit = hit | h.startswith(prefix)
        return hit

    cand = F.filter(
        anchors(html_col), lambda l: F.lower(F.concat(l["href"], F.lit(" "), l["text"])).rlike(kw))
    # Split each candidate href far enough to know the result's authority.
    df = df.withColumn(f"{t}_c1", F.transform(cand, lambda l: F.struct(
        l["href"].alias("href"),
        F.regexp_replace(F.regexp_replace(l["href"], r"^[\x00-\x20]+", ""), r"[\t\r\n]", "").alias("u"))))
    df = df.withColumn(f"{t}_c4", F.transform(F.col(f"{t}_c1"), lambda l: F.struct(
        l["href"].alias("href"),
        F.when(F.regexp_extract(l["u"], U.URL_SPLIT, 1) == "", B("scheme"))
        .otherwise(F.lower(F.regexp_extract(l["u"], U.URL_SPLIT, 1))).alias("scheme"),
        F.regexp_extract(l["u"], U.URL_SPLIT, 2).alias("net"))))
    df = df.withColumn(f"{t}_c5", F.transform(F.col(f"{t}_c4"), lambda l: F.struct(
        l["href"].alias("href"),
        F.when(F.col(base_col) == "", l["net"])
        .when((l["scheme"] != B("scheme")) | ~l["scheme"].isin(U.USES_RELATIVE), l["net"])
        .when(l["scheme"].isin(U._USES_NETLOC) & (l["net"] == ""), B("netloc"))
        .otherwise(l["net"]).alias("res_net"),
        (B("err") | ((F.instr(l["net"], "[") > 0) != (F.instr(l["net"], "]") > 0))
         | ((F.instr(l["net"], "[") > 0) & ~U._before(U._after(l["net"], "["), "]").rlike(U._IPV6)
            & ~U._before(U._after(l["net"], "["), "]").rlike(U._IPVFUTURE))).alias("err"))))
    hit = F.get(F.filter(F.col(f"{t}_c5"), lambda l: l["err"] | ((l["res_net"] == B("netloc")) & ~skip(l["href"]))), 0)
    df = df.withColumn(f"{t}_href", F.when(hit["err"], F.lit(None).cast("string")).otherwise(hit["href"]))
    df = U.with_url_join(df, base_col, f"{t}_href", f"{t}_abs")
    df = df.withColumn(out, F.when(F.col(f"{t}_href").isNull(), F.lit(None).cast("string"))
                       .otherwise(F.col(f"{t}_abs")))
    drop = [f"{t}_{n}" for n in ("c1", "c4", "c5", "href", "abs", "abs_netloc", "abs_err")]
    return df.drop(*drop, *U._part_names(f"{t}b"))


def link_targets(pages: DataFrame, base_col: str = "norm_url") -> DataFrame:
    """(page_id, pos, href, text, abs_url, abs_netloc, err): every anchor
    resolved against its page's URL (P-4 applied to P-12)."""
    links = page_links(pages, keep=[base_col])
    links = U.with_url_join(links, base_col, "href", "abs_url")
    return links.withColumnRenamed("abs_url_netloc", "abs_netloc").withColumnRenamed("abs_url_err", "err")
