"""HTML -> text as column expressions.

One regular expression tokenises the page: comments, elements whose content is
no text, declarations and tags, with quoted attribute values respected and
unclosed elements running to the end. What lies between the tokens is the text;
its character references are decoded as the HTML parser does, and white space
is collapsed. Text nodes are joined without a separator, so
``<p>a</p><p>b</p>`` gives ``ab`` like a DOM text walk.

Visible text needs the nesting of elements: a state (open elements, where the
hidden part began) is folded over a page's tokens with ``aggregate``. Everything
runs in the JVM; nothing is shuffled.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import WS, collapse_ws, strip_ws

# Elements whose whole subtree carries no page text.
DROPPED_ELEMENTS = ["script", "style", "noscript", "head", "template", "rt", "rp"]
# Elements that are also dropped when only visible text is wanted.
INVISIBLE_ELEMENTS = ["nav", "footer"]
# Elements that never have content.
VOID_ELEMENTS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta",
                 "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex",
                 "nextid", "spacer"]
# Page text gates.
HOME_MIN_CHARS = 50        # home text shorter than this counts as empty
JS_SUSPECT_CHARS = 500     # home text shorter than this suggests JS rendering
PRICING_MIN_CHARS = 50     # pricing text must be longer than this
HTML_EXCERPT_CHARS = 10000
TEXT_EXCERPT_CHARS = 8000

# The rest of a tag after its name: quoted values may hold a ">".
_ATTRS = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+>"""
_RAW = ["script", "style"]  # their content is no markup
# Marks where a token stood, so that text around it is not read as one (a noncharacter, never part of a text).
_CUT = "﷐"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _element(tag: str) -> str:
    """A whole element up to its closing tag, the end of its ruby, or the end."""
    stop = r"|(?=</ruby)" if tag in ("rt", "rp") else ""
    return rf"<{tag}(?=[\s/>]){_ATTRS}.*?(?:</{tag}(?=[\s/>])[^>]*+>{stop}|\z)"


def token_pattern(dropped: list[str]) -> str:
    """Comments, dropped elements as wholes, declarations and single tags."""
    parts = [r"<!--(?:-?>|.*?(?:--!?>|\z))", *map(_element, dropped), rf"<[a-z]{_ATTRS}", r"</[a-z][^>]*+>",
             r"</[^a-z>][^>]*+>|</>", r"<!(?!--)[^>]*+>", r"<\?[^>]*+>"]
    return "(?is)" + "|".join(parts)


def _reference_table() -> tuple[Column, str]:
    """The public HTML5 names: all as one map, those valid without a semicolon as a pattern."""
    open_names = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
    return F.from_json(F.lit(json.dumps(html5)), "map<string,string>"), "^(?:" + "|".join(open_names) + ")"


# The characters that windows-1252 has where Latin-1 has controls 128 to 159.
_WINDOWS = "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(128, 160))


def _code_point(code: Column) -> Column:
    """The character of a numeric reference: windows-1252 for 128 to 159, the
    replacement character for null, surrogates and numbers beyond Unicode,
    nothing for other controls and noncharacters."""
    nothing = ((code < 9) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF)
               | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("�"))
            .when(code.between(128, 159), F.lit(_WINDOWS).substr((code - 127).cast("int"), F.lit(1)))
            .when(nothing, F.lit("")).otherwise(char))


def decode_references(c) -> Column:
    """Character references of a text: decimal, hexadecimal and named, with the
    longest name that is valid without a semicolon; unknown ones stay."""
    x = _col(c)
    names, open_names = _reference_table()

    def decode(part: Column) -> Column:
        digits = F.regexp_extract(part, r"^#([0-9]+);?", 1)
        hexed = F.regexp_extract(part, r"^#[xX]([0-9a-fA-F]+);?", 1)
        number = F.when(digits != "", F.least(F.lit(0x110000), F.substring(F.ltrim(digits, F.lit("0")), 1, 8).try_cast("long"))) \
            .otherwise(F.conv(F.substring(F.ltrim(hexed, F.lit("0")), 1, 7), 16, 10).try_cast("long"))
        rest = F.regexp_replace(part, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", "")
        name = F.regexp_extract(part, r"^[^\t\n\f <&#;]{1,32};?", 0)
        known = F.try_element_at(names, name)
        legacy = F.regexp_extract(name, open_names, 0)
        return (F.when((digits != "") | (hexed != ""), F.concat(_code_point(F.coalesce(number, F.lit(0))), rest))
                .when(known.isNotNull(), F.concat(known, F.substr(part, F.length(name) + 1)))
                .when(legacy != "", F.concat(F.try_element_at(names, legacy), F.substr(part, F.length(legacy) + 1)))
                .otherwise(F.concat(F.lit("&"), part)))

    parts = F.split(x, "&", -1)
    decoded = F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), decode), ""))
    return F.when(F.contains(x, F.lit("&")), decoded).otherwise(x)


def _finished(marked: Column) -> Column:
    return strip_ws(collapse_ws(F.replace(decode_references(marked), F.lit(_CUT), F.lit(""))))


def html_to_text(c, extra_dropped: list[str] | None = None) -> Column:
    """Text of an HTML document, whitespace collapsed (P-6). Null or blank
    input gives ''. ``extra_dropped`` adds elements whose subtree goes too."""
    x = F.coalesce(_col(c), F.lit(""))
    return _finished(F.regexp_replace(x, token_pattern(DROPPED_ELEMENTS + list(extra_dropped or [])), _CUT))


def strip_tags(c) -> Column:
    """Fallback extraction: delete ``<...>`` runs, collapse, strip (P-7)."""
    x = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"<[^>]+>", "")
    return strip_ws(collapse_ws(x))


def _attribute(name: str, holds: str) -> str:
    """A tag whose own attribute ``name`` has a value with ``holds`` in it."""
    value = r"""(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?"""
    other = rf"[\s/]++(?!{name}[\s=/>])[^\s/=>]++{value}"
    return rf"""(?is)^<[^\s/>]++(?:{other})*+[\s/]++{name}\s*+=\s*+(?:"[^"]*?{holds}|'[^']*?{holds}|[^\s>"']*?{holds})"""


HIDDEN_STYLE = _attribute("style", r"display\s*:\s*none")
HIDDEN_CLASS = _attribute("class", "hidden")
_MAY_HIDE = r"(?is)display\s*:\s*none|hidden"
_TOKENS_AT_A_TIME = 256


def _visible_by_nesting(x: Column) -> Column:
    """Text outside hidden elements. An end tag closes the most recent open
    element of its name and all opened since; one without an open element is
    ignored; unclosed elements stay open. Tokens are folded in runs, so that the
    text gathered so far is copied once per run and not once per token."""
    pattern = token_pattern(_RAW)
    tokens = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    texts = F.split(x, pattern, -1)
    steps = F.zip_with(tokens, F.slice(texts, F.lit(2), F.size(tokens)),
                       lambda tag, text: F.struct(tag.alias("tag"), text.alias("text")))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / _TOKENS_AT_A_TIME).cast("int")),
                       lambda i: F.slice(steps, i * _TOKENS_AT_A_TIME + 1, F.lit(_TOKENS_AT_A_TIME)))
    dropped = DROPPED_ELEMENTS + INVISIBLE_ELEMENTS

    def state(open_, hidden, out):
        return F.struct(open_.alias("open"), hidden.cast("int").alias("hidden"), out.alias("out"))

    def step(acc, s):
        tag = s["tag"]
        name = F.lower(F.regexp_extract(tag, r"^</?([a-zA-Z][^\s/>]*)", 1))
        closes = tag.startswith("</")
        opens = (name != "") & ~closes & ~tag.endswith("/>") & ~name.isin(VOID_ELEMENTS + _RAW)
        depth = F.size(acc["open"])
        found = F.when(closes & (name != ""), F.array_position(F.reverse(acc["open"]), name)).otherwise(F.lit(0))
        left = F.when(found > 0, depth - found.cast("int")).otherwise(depth)
        now = F.when(opens, F.concat(acc["open"], F.array(name))).when(found > 0, F.slice(acc["open"], F.lit(1), left)) \
            .otherwise(acc["open"])
        hides = opens & (name.isin(dropped) | tag.rlike(HIDDEN_STYLE) | tag.rlike(HIDDEN_CLASS))
        hidden = F.when((acc["hidden"] == 0) & hides, depth + 1).when(acc["hidden"] > left, F.lit(0)) \
            .otherwise(acc["hidden"])
        out = F.when(hidden == 0, F.concat(acc["out"], F.lit(_CUT), s["text"])).otherwise(acc["out"])
        return state(now, hidden, out)

    def run(acc, part):
        inner = F.aggregate(part, state(acc["open"], acc["hidden"], F.lit("")), step)
        return state(inner["open"], inner["hidden"], F.concat(acc["out"], inner["out"]))

    start = state(F.array().cast("array<string>"), F.lit(0), F.get(texts, 0))
    return F.when(F.size(tokens) == 0, x).otherwise(F.aggregate(runs, start, run, lambda a: a["out"]))


def visible_text(c) -> Column:
    """Text that a reader sees (P-8): without hidden elements (``display:none``
    in the style, ``hidden`` in the class), navigation and footer. Pages that
    cannot hide anything take the linear tokeniser alone; both ways agree there."""
    x = F.coalesce(_col(c), F.lit(""))
    plain = F.regexp_replace(x, token_pattern(DROPPED_ELEMENTS + INVISIBLE_ELEMENTS), _CUT)
    return _finished(F.when(x.rlike(_MAY_HIDE), _visible_by_nesting(x)).otherwise(plain))


def with_visible_text(df: DataFrame, html_col: str, out: str) -> DataFrame:
    return df.withColumn(out, visible_text(html_col))


def home_gate(text) -> tuple[Column, Column]:
    """(home_text, requires_js) after the length gate (P-14): under
    ``HOME_MIN_CHARS`` the text is dropped and JS rendering assumed."""
    t = _col(text)
    n = F.length(strip_ws(t))
    short = n < HOME_MIN_CHARS
    return (F.when(short, F.lit("")).otherwise(t),
            F.when(short, F.lit(True)).otherwise(n < JS_SUSPECT_CHARS))


def pricing_ok(text) -> Column:
    """Pricing text is kept only when longer than ``PRICING_MIN_CHARS`` (P-15)."""
    t = _col(text)
    return F.coalesce(F.length(strip_ws(t)) > PRICING_MIN_CHARS, F.lit(False))


def excerpt_html(c) -> Column:
    """Page payload cap for the model's page tool: first 10,000 characters (P-16)."""
    return F.substring(_col(c), 1, HTML_EXCERPT_CHARS)


def excerpt_text(c) -> Column:
    """Text payload cap: first 8,000 characters of the extracted text (P-16)."""
    return F.substring(_col(c), 1, TEXT_EXCERPT_CHARS)
