"""URL filter rules by hash-prefix join.

Every URL is expanded into expressions (host suffix + path prefix ending at a
slash), each expression is hashed, the short hash prefix is the equi-join key
with the rule table, and the surviving pairs are confirmed by the full digest
and the rule's whole path. The longest confirmed rule decides.

Defined results: null URL or none with ``://``: empty host and path, no rule,
the default verdict. Repeated rows and null ids keep one output row each.
Rules of equal text and opposite verdict: block wins. Rules of equal length:
the longer host wins, then block. An empty rule table or page table is allowed.
Only the id and URL columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import ASCII_UPPER

PREFIX_HEX = 8          # 32-bit hash prefixes are the join key
URL_PARTS = r"://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 1)
    return F.translate(host, ASCII_UPPER, ASCII_UPPER.lower())


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 2)


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with the digest of the expression that a
    matching URL is sure to have: the host and the path up to its last slash."""
    anchor = F.regexp_extract("path", r"(?s)^(.*/)?", 0)
    expr = F.concat("host", anchor)
    return (rules.select("host", "path", "verdict")
            .where(F.col("host").isNotNull() & F.col("path").isNotNull())
            .select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"),
                    F.col("verdict").alias("rule_verdict"),
                    F.substring(_digest(expr), 1, PREFIX_HEX).alias("hash_prefix"),
                    _digest(expr).alias("rule_digest"),
                    F.size(F.split("host", r"\.", -1)).alias("labels"),
                    (F.size(F.split("path", "/", -1)) - 1).alias("depth")))


def judge_urls(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """Returns id, host, path, rule (host and path of the rule) and verdict.

    Expressions go no deeper than the deepest rule (two numbers read from the
    rule table), which loses no match. A short rule table is broadcast by
    Spark's own size check; a long one is joined by shuffle. The final grouping
    is by row, so a host with a third of all rows stays spread out.
    """
    table = rule_table(rules)
    deepest = table.agg(F.max("labels"), F.max("depth")).first()
    max_labels, max_depth = deepest[0] or 0, deepest[1] or 0

    urls = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                     url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    labels, parts = F.split("host", r"\.", -1), F.split("path", "/", -1)
    suffixes = F.when(F.col("host") != "", F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, max_labels)))),
        lambda k: F.array_join(F.slice(labels, -k, k), "."))).otherwise(F.array().cast("array<string>"))
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(max_depth))),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))

    hashed = (urls.withColumn("expression", F.explode_outer(expressions))
              .withColumn("digest", _digest(F.col("expression")))
              .withColumn("hash_prefix", F.substring("digest", 1, PREFIX_HEX)))
    paired = hashed.join(table, "hash_prefix", "left")
    confirmed = (F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path"))
    rule = F.when(confirmed, F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"),
        (F.col("rule_verdict") == "block").alias("blocks"),
        F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")))
    return (paired.groupBy("row", "id", "host", "path").agg(F.max(rule).alias("best"))
            .select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
