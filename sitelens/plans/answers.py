"""Registered answer queries (R-1..R-6, R-11, R-13, F-7, F-8).

The driver's tables hold no model answers, so ``synthetic_answers`` derives one
raw answer per document by a fixed rule that both Spark and the SQL oracle
apply: the document's letters and digits are split by length over the fields,
every character once, and wrapped in the shapes real answers come in (plain,
fenced, text around, truncated, a number, a list, missing keys, an extra key, a
null). It reads the whole ``documents`` table and whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import answers as A
from sitelens.operators import scoring as Sc
from sitelens.plans import pages as P
from sitelens.schemas import FIELDS, FIELD_KEYS
from sitelens.operators import bundle as B
from sitelens.session import has_shared, shared_table
from sitelens.sources.tables import documents

N_SHAPES = 10
# Text after the object; one with braces stays behind the object when the answer is unwrapped.
CLOSING, BRACED = "Готово.", " {конец}"
# Shapes by doc_id % 10: 1 and 5 fenced, 2 text around, 3 truncated, 4 a number,
# 6 a list, 7 the first half of the keys only, 8 an extra key, 9 a null.
FEW_KEYS = 12
# Field positions with special content.
PAINS, PRICES, FAQ, SUMMARY, NOTES, BENEFITS, GUARANTEES = (
    FIELDS.index(c) for c in ("target_audience_pains", "prices_tariffs", "faq", "brief_summary", "notes",
                              "benefits", "guarantees"))
PRICED_URL = "https://x.test/prices"  # the pricing page of documents with an even id
SPARE_KEY = "Лишнее поле"


def _pieces(s: Column, count: Column) -> Column:
    """``s`` cut into ``count`` pieces of one length (the last may be shorter or empty)."""
    width = F.ceil(F.length(s) / count).cast("int")
    return F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda j: F.substr(s, j * width + 1, width))


def synthetic_answers(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, raw): one raw model answer per document."""
    d = F.col("doc_id")
    shape = F.pmod(d, F.lit(N_SHAPES))
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.col("text"), r"[^\p{L}\p{N} ]", " "), " +", " "))
    df = docs.select("doc_id", "n_chars", clean.alias("s"))
    df = df.withColumn("p", _pieces(F.col("s"), F.when(shape == 7, F.lit(FEW_KEYS)).otherwise(F.lit(len(FIELDS)))))

    def lines(v: Column, count: Column) -> Column:
        return F.array_join(_pieces(v, count), "\\n")

    vals = []
    for i in range(len(FIELDS)):
        v = F.get("p", i)
        if i == PAINS:
            v = lines(v, F.pmod(d, F.lit(7)) + 3)
        elif i == FAQ:
            v = lines(v, F.pmod(d, F.lit(8)) + 10)
        elif i == PRICES:
            v = F.concat(v, F.when(F.pmod(d, F.lit(3)) == 0, F.lit(" (главная)"))
                         .when(F.pmod(d, F.lit(3)) == 1, F.lit(f" (цены: {PRICED_URL})")).otherwise(F.lit("")))
        elif i == NOTES:
            v = F.when(F.col("n_chars") < 500, F.concat(v, F.lit(" " + A.JS_NOTE))).otherwise(v)
        elif i == SUMMARY:
            p = [F.get(_pieces(v, F.lit(3)), k) for k in range(3)]
            m = F.pmod(d, F.lit(5))
            v = (F.when(m == 0, F.concat(F.lit("- "), p[0], F.lit("\\n- "), p[1], F.lit("\\n- "), p[2]))
                 .when(m == 1, F.concat(F.lit("• "), p[0], F.lit("\\n• "), p[1], p[2]))
                 .when(m == 2, F.concat(p[0], F.lit(". "), p[1], F.lit(". "), p[2], F.lit(".")))
                 .when(m == 3, F.lit("")).otherwise(v))
        rendered = F.concat(F.lit('"'), v, F.lit('"'))
        if i == GUARANTEES:
            rendered = F.when(shape == 4, F.lit("12")).otherwise(rendered)
        if i == BENEFITS:
            rendered = F.when(shape == 6, F.concat(F.lit('["'), v, F.lit('", "x"]'))).otherwise(rendered)
        if i == NOTES:
            rendered = F.when(shape == 9, F.lit("null")).otherwise(rendered)
        pair = F.concat(F.lit('"' + FIELD_KEYS[i] + '": '), rendered)
        if i >= FEW_KEYS:
            pair = F.when(shape != 7, pair)
        vals.append(pair)
    # what a number, a null or an empty summary has displaced goes to a key that no field has
    spare = F.concat(F.when(shape == 4, F.get("p", GUARANTEES)).otherwise(F.lit("")),
                     F.when(shape == 9, F.get("p", NOTES)).otherwise(F.lit("")),
                     F.when((F.pmod(d, F.lit(5)) == 3) & (shape != 7), F.get("p", SUMMARY)).otherwise(F.lit("")))
    extra = F.when((shape == 8) | (spare != ""), F.concat(F.lit(f'"{SPARE_KEY}": "'), spare, F.lit('"')))
    obj = F.concat(F.lit("{"), F.concat_ws(", ", *vals, extra), F.lit("}"))
    raw = (F.when(shape == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
           .when(shape == 2, F.concat(F.lit("Вот ответ:\n"), obj, F.lit("\n" + CLOSING),
                                  F.when(F.pmod(d, F.lit(20)) == 2, F.lit(BRACED)).otherwise(F.lit(""))))
           .when(shape == 3, F.substr(obj, F.lit(1), F.length(obj) - 2))
           .when(shape == 5, F.concat(F.lit("```\n"), obj, F.lit("\n```")))
           .otherwise(obj))
    return df.select("doc_id", "n_chars", raw.alias("raw"))


def raw_answers(spark: SparkSession, sf: str) -> DataFrame:
    return synthetic_answers(documents(spark, sf, "doc_id", "text", "n_chars"))


def parsed_answers(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, n_chars, parse_ok, 24 fields), a table built once per input."""
    def build() -> DataFrame:
        df = raw_answers(spark, sf).withColumn("json_text", A.json_unwrap("raw"))
        return A.with_answer_fields(df, "json_text").select("doc_id", "n_chars", "parse_ok", *FIELDS)
    return shared_table(spark, "parsed_answers", sf, build)


def checked_answers(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, parse_ok) of ``parsed_answers``, for queries that need no field: from that
    table if it is there, else parsed alike and written without the fields."""
    if has_shared(spark, "parsed_answers", sf):
        return parsed_answers(spark, sf).select("doc_id", "parse_ok")

    def build() -> DataFrame:
        df = raw_answers(spark, sf).withColumn("json_text", A.json_unwrap("raw"))
        return A.with_answer_fields(df, "json_text").select("doc_id", "parse_ok")
    return shared_table(spark, "checked_answers", sf, build)


def json_unwrap(spark: SparkSession, sf: str) -> DataFrame:
    return raw_answers(spark, sf).select("doc_id", A.json_unwrap("raw").alias("json_text"))


def answer_fields(spark: SparkSession, sf: str) -> DataFrame:
    return parsed_answers(spark, sf).select("doc_id", "parse_ok", *FIELDS)


def summary_points(spark: SparkSession, sf: str) -> DataFrame:
    df = parsed_answers(spark, sf)
    pts = F.when(F.col("parse_ok"), A.short_summary())
    return df.select("doc_id", F.when(F.col("parse_ok"), F.size(pts)).alias("n_points"),
                     F.to_json(pts).alias("points"))


def answer_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Per-rule counts over all parsed answers (F-7, F-8)."""
    df = parsed_answers(spark, sf)
    df = df.withColumn("short_summary", A.short_summary()) \
        .withColumn("requires_js", F.col("n_chars") < 500) \
        .withColumn("pricing_url", F.when(F.pmod("doc_id", F.lit(2)) == 0, F.lit(PRICED_URL)))
    flags = A.quality_flags()
    ok = F.col("parse_ok")
    aggs = [F.count("*").alias("n_answers"), F.count_if(ok).alias("n_parsed")]
    aggs += [F.count_if(ok & ~flag).alias(f"n_fail_{name[:-3]}") for name, flag in flags.items()]
    return df.agg(*aggs)


def prompted(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts of the requests whose home page has text: without it the audit ends before the model."""
    bundle = B.content_bundle(P.bundle_requests(spark, sf), P.crawl_snapshot(spark, sf))
    return Sc.prompt_requests(bundle.filter(F.col("fetched") & (F.col("home_text") != "")))


def prompt_requests(spark: SparkSession, sf: str) -> DataFrame:
    return prompted(spark, sf).select("request_id", (F.col("n_chars") + len(Sc.SYSTEM_PROMPT)).alias("n_chars"),
                                      F.sha2("user", 256).alias("user_sha"))


def batch_score(spark: SparkSession, sf: str) -> DataFrame:
    """R-13 with the deterministic stand-in model of ``operators.scoring``."""
    scored = Sc.score(prompted(spark, sf), Sc.stub_client_factory)
    df = A.with_answer_fields(scored.withColumn("json_text", A.json_unwrap("raw_answer")), "json_text")
    return df.select("request_id", "attempts", "error", "parse_ok", "offer_first_screen", "notes")


QUERIES = {
    "json_unwrap": json_unwrap,
    "answer_fields": answer_fields,
    "summary_points": summary_points,
    "answer_quality": answer_quality,
    "prompt_requests": prompt_requests,
    "batch_score": batch_score,
}
