"""Model answer handling as column expressions (R-1..R-8, R-12, F-7, F-8).

The answer is parsed once into a VARIANT (``try_parse_json``, made strict about
text after the value), not into a ``map<string,string>``: a map cast would turn ``1`` into ``'1'`` and hide
the type errors the answer record must reject. Each of the 24 fields is then
read by path and type-checked: absent -> '', string -> value, anything else
(number, bool, null, list, object) -> the whole record fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import WS, strip_ws
from sitelens.schemas import ANSWER_FIELDS, ERROR_CELL_PREFIX, FIELDS, REPORT_COLUMNS

# List markers recognised at the start of a summary line, the
# number of summary points kept, and the fallback's per-field length.
SUMMARY_MARKERS = ["-", "•", "*"]
SUMMARY_MAX_POINTS = 4
FALLBACK_FIELDS = ["offer_first_screen", "product_services", "marketing_insights"]
FALLBACK_CHARS = 100
# Quality rules stated for the answer.
MIN_PAIN_LINES = 7
MAX_FAQ_ITEMS = 15
MIN_SUMMARY_POINTS, MAX_SUMMARY_POINTS = 3, 4
PRICE_SOURCE_HOME = "главная"
PRICE_SOURCE_PAGE = "цены: "
JS_NOTE = "Возможен JS-рендеринг"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_unwrap(raw) -> Column:
    """R-1: drop every ```` ```json ```` fence opener and a trailing fence,
    strip, then keep the first ``{`` through the last ``}`` when present."""
    x = F.regexp_replace(F.coalesce(_col(raw), F.lit("")), f"```json{WS}*", "")
    x = F.regexp_replace(x, f"```{WS}*$", "")
    x = strip_ws(x)
    return F.coalesce(F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit("")), x)


def with_json(df: DataFrame, json_col: str, name: str) -> DataFrame:
    """``df`` with the VARIANT ``name`` of a text that is one JSON value, else null.

    Spark's parser stops at the end of the first value and ignores what follows. So
    the text is parsed as the first of two list elements, the second being the text's
    own digest: only a text that is one whole value leaves the digest in its place."""
    digest = F.sha2(F.col(json_col), 256)
    both = F.try_parse_json(F.concat(F.lit("["), F.col(json_col), F.lit(',"'), digest, F.lit('"]')))
    df = df.withColumns({"__both": both, "__digest": digest})
    alone = F.try_variant_get(F.col("__both"), "$[1]", "string") == F.col("__digest")
    return df.withColumn(name, F.when(alone, F.try_variant_get(F.col("__both"), "$[0]", "variant"))).drop("__both", "__digest")


def field_path(key: str) -> str:
    return "$['" + key + "']"


def with_answer_fields(df: DataFrame, json_col: str, keys: list[tuple[str, str]] | None = None,
                       ok_col: str = "parse_ok") -> DataFrame:
    """R-2..R-4: adds ``ok_col`` and one column per answer field.

    ``ok_col`` is true when the text is a JSON object whose listed keys are
    all absent or strings; the field columns hold the value ('' when absent)
    when ``ok_col`` is true and null otherwise.
    """
    keys = keys or ANSWER_FIELDS
    df = with_json(df, json_col, "__v")
    v = F.col("__v")
    types = {f"__t_{c}": F.schema_of_variant(F.try_variant_get(v, field_path(k), "variant")) for c, k in keys}
    vals = {f"__s_{c}": F.coalesce(F.try_variant_get(v, field_path(k), "string"), F.lit("")) for c, k in keys}
    df = df.withColumns({"__obj": F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)),
                         **types, **vals})
    ok = F.col("__obj")
    for c, _ in keys:
        t = F.col(f"__t_{c}")
        ok = ok & (t.isNull() | (t == "STRING"))
    df = df.withColumn(ok_col, ok)
    df = df.withColumns({c: F.when(F.col(ok_col), F.col(f"__s_{c}")) for c, _ in keys})
    return df.drop("__v", "__obj", *types, *vals)


def summary_points(text) -> Column:
    """R-5: up to 4 points from a summary text.

    Lines (split on newline, stripped) starting with ``-``, ``•`` or ``*``
    lose one marker and the spaces after it; empty points are dropped. With
    no such line the whole text is split on ``.`` instead. Empty -> [].
    """
    t = F.coalesce(_col(text), F.lit(""))
    marker = "^[" + "".join("\\" + m if m in "-*" else m for m in SUMMARY_MARKERS) + "]"
    lines = F.transform(F.split(t, "\n"), lambda l: strip_ws(l))
    marked = F.filter(lines, lambda l: l.rlike(marker))
    points = F.filter(F.transform(marked, lambda l: strip_ws(F.regexp_replace(l, marker + WS + "*", ""))),
                      lambda p: p != "")
    sentences = F.filter(F.transform(F.split(t, r"\."), lambda s: strip_ws(s)), lambda s: s != "")
    chosen = F.when(t == "", F.array().cast("array<string>")) \
        .when(F.size(points) > 0, points).otherwise(sentences)
    return F.slice(chosen, 1, SUMMARY_MAX_POINTS)


def summary_fallback(*fields) -> Column:
    """R-6: first 100 characters of three fields, empties dropped."""
    cols = [F.substring(_col(c), 1, FALLBACK_CHARS) for c in (fields or FALLBACK_FIELDS)]
    return F.slice(F.filter(F.array(*cols), lambda x: x != ""), 1, SUMMARY_MAX_POINTS)


def short_summary(brief_col="brief_summary", fallback_fields=None) -> Column:
    """R-5 with R-6 as fallback when no point was found."""
    pts = summary_points(brief_col)
    return F.when(F.size(pts) > 0, pts).otherwise(summary_fallback(*(fallback_fields or FALLBACK_FIELDS)))


def iso_timestamp(ts) -> Column:
    """``datetime.isoformat()``: microseconds only when non-zero."""
    ts = _col(ts)
    frac = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")))


def sheet_timestamp(ts) -> Column:
    """Report-row time format ``%Y-%m-%d %H:%M:%S``."""
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm:ss")


def envelope_json(fields_prefix: str = "", pricing_url="pricing_url", timestamp="timestamp",
                  summary="short_summary") -> Column:
    """R-7: ``{"full_result": {24 fields}, "pricing_url", "timestamp",
    "short_summary"}`` as JSON text; nulls are written (``pricing_url: null``)."""
    fr = F.struct(*[F.col(f"{fields_prefix}{c}").alias(c) for c in FIELDS])
    env = F.struct(fr.alias("full_result"), _col(pricing_url).alias("pricing_url"),
                   _col(timestamp).alias("timestamp"), _col(summary).alias("short_summary"))
    return F.to_json(env, {"ignoreNullFields": "false"})


def with_report_row(df: DataFrame, json_col: str = "result_json", user_col: str = "user_id",
                    url_col: str = "url", time_col: str = "created_at", fill_timestamp: bool = False) -> DataFrame:
    """R-8 + R-9: the 28 report cells of a stored result.

    ``full_result`` fields default to ''; ``pricing_url`` null or absent ->
    ''; the timestamp cell stays '' as in the original. Anything that fails
    (not JSON, not an object, ``full_result`` not an object, a field or
    ``pricing_url`` not a string) gives the error row: time of the stored
    row, user, url, '', the error text, then 23 empty cells.

    ``fill_timestamp=True`` writes the stored row's time into the timestamp
    cell of good rows too (the record-from-result form, R-10).
    """
    df = with_json(df, json_col, "__r_e")
    e = F.col("__r_e")
    fr_t = F.schema_of_variant(F.try_variant_get(e, "$.full_result", "variant"))
    pu_t = F.schema_of_variant(F.try_variant_get(e, "$.pricing_url", "variant"))
    df = df.withColumns({
        "__r_obj": F.coalesce(F.schema_of_variant(e).startswith("OBJECT"), F.lit(False)),
        "__r_fr_ok": fr_t.isNull() | fr_t.startswith("OBJECT"),
        "__r_pu_ok": pu_t.isNull() | pu_t.isin("STRING", "VOID"),
        "__r_fr": F.to_json(F.try_variant_get(e, "$.full_result", "variant")),
        "__r_pu": F.coalesce(F.try_variant_get(e, "$.pricing_url", "string"), F.lit(""))})
    df = with_answer_fields(df.withColumn("__r_frj", F.coalesce(F.col("__r_fr"), F.lit("{}"))), "__r_frj",
                            [(f"__f_{c}", c) for c in FIELDS], "__r_fields_ok")
    ok = F.col("__r_obj") & F.col("__r_fr_ok") & F.col("__r_pu_ok") & F.col("__r_fields_ok")
    reason = (F.when(F.col("__r_e").isNull(), F.lit("invalid JSON"))
              .when(~F.col("__r_obj"), F.lit("not an object"))
              .when(~F.col("__r_fr_ok"), F.lit("full_result is not an object"))
              .when(~F.col("__r_pu_ok"), F.lit("pricing_url is not a string"))
              .otherwise(F.lit("field is not a string")))
    df = df.withColumn("row_ok", ok)
    cells = {
        "timestamp": sheet_timestamp(time_col) if fill_timestamp
        else F.when(ok, F.lit("")).otherwise(sheet_timestamp(time_col)),
        "user_id": F.col(user_col).cast("string"),
        "analyzed_url": F.col(url_col),
        "pricing_url": F.when(ok, F.col("__r_pu")).otherwise(F.lit("")),
    }
    for i, c in enumerate(FIELDS):
        err_cell = F.concat(F.lit(ERROR_CELL_PREFIX), reason) if i == 0 else F.lit("")
        cells[c] = F.when(ok, F.col(f"__f_{c}")).otherwise(err_cell)
    df = df.withColumns(cells)
    return df.drop("__r_e", "__r_obj", "__r_fr_ok", "__r_pu_ok", "__r_fr", "__r_pu", "__r_frj", "__r_fields_ok",
                   *[f"__f_{c}" for c in FIELDS])


def quality_flags(pains="target_audience_pains", faq="faq", summary="short_summary",
                  prices="prices_tariffs", notes="notes", requires_js="requires_js",
                  pricing_url="pricing_url") -> dict[str, Column]:
    """F-7/F-8: rule checks on an answer (true = rule met)."""
    n_pains = F.when(_col(pains) == "", F.lit(0)).otherwise(F.size(F.split(_col(pains), "\n")))
    faq_items = F.size(F.filter(F.split(_col(faq), "\n"), lambda x: strip_ws(x) != ""))
    price_src = F.when(_col(pricing_url).isNotNull(),
                       F.instr(_col(prices), F.concat(F.lit(PRICE_SOURCE_PAGE), _col(pricing_url))) > 0) \
        .otherwise(F.instr(_col(prices), F.lit(PRICE_SOURCE_HOME)) > 0)
    return {
        "pains_ok": (_col(pains) == "") | (n_pains >= MIN_PAIN_LINES),
        "faq_ok": faq_items <= MAX_FAQ_ITEMS,
        "summary_ok": F.size(_col(summary)).between(MIN_SUMMARY_POINTS, MAX_SUMMARY_POINTS),
        "price_source_ok": (_col(prices) == "") | price_src,
        "js_note_ok": ~F.coalesce(_col(requires_js), F.lit(False)) | (F.instr(_col(notes), F.lit(JS_NOTE)) > 0),
    }
