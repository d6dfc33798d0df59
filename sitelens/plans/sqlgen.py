"""DuckDB SQL fragments for the correctness oracle.

that it checks: only values that are fixed by the contract (word lists, the link
pattern, headers, prompt texts) and the stand-in data (``plans.standin``) are
shared. Stages are chained as nested ``SELECT *, expr AS name`` subqueries so
every expression refers to earlier results by name.
"""

from __future__ import annotations

# Fixed values of the contract.
from sitelens.functions.urls import _USES_NETLOC as WITH_AUTHORITY
from sitelens.functions.urls import USES_PARAMS, USES_RELATIVE

# Python's white space, by asking Python.
WS = "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace()) + "]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def inlist(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


class Stages:
    """Builder for a chain of projections over a source query."""

    def __init__(self, source: str):
        self.sql = source

    def add(self, name: str, expr: str) -> "Stages":
        self.sql = f"SELECT *, {expr} AS {name} FROM ({self.sql})"
        return self

    def replace(self, name: str, expr: str) -> "Stages":
        self.sql = f"SELECT * REPLACE ({expr} AS {name}) FROM ({self.sql})"
        return self

    def drop(self, *names: str) -> "Stages":
        self.sql = f"SELECT * EXCLUDE ({', '.join(names)}) FROM ({self.sql})"
        return self

    def where(self, cond: str) -> "Stages":
        self.sql = f"SELECT * FROM ({self.sql}) WHERE {cond}"
        return self

    def select(self, cols: str) -> "Stages":
        self.sql = f"SELECT {cols} FROM ({self.sql})"
        return self

    def __str__(self) -> str:
        return self.sql


def rx(x: str, pat: str, rep: str = "") -> str:
    return f"regexp_replace({x}, {q(pat)}, {q(rep)}, 'g')"


def strip_ws(x: str) -> str:
    return rx(x, f"^{WS}+|{WS}+$")


def collapse_ws(x: str) -> str:
    return rx(x, f"{WS}+", " ")


def crc32(x: str) -> str:
    """CRC-32 of an ASCII text, byte by byte (polynomial 0xEDB88320)."""
    step = "CASE WHEN {v} & 1 = 1 THEN xor({v} >> 1, 3988292384) ELSE {v} >> 1 END"
    rounds = f"list_reduce(range(0, 8), lambda v, i: {step.format(v='v')}, xor(acc, b))"
    codes = f"list_transform(string_split({x}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda acc, b: {rounds}, 4294967295::BIGINT), 4294967295::BIGINT)"


def after(x: str, ch: str) -> str:
    return f"(CASE WHEN strpos({x}, {q(ch)}) > 0 THEN substr({x}, strpos({x}, {q(ch)}) + 1) ELSE '' END)"


def before(x: str, ch: str) -> str:
    return f"(CASE WHEN strpos({x}, {q(ch)}) > 0 THEN substr({x}, 1, strpos({x}, {q(ch)}) - 1) ELSE {x} END)"


def bad_host(netloc: str) -> str:
    """Brackets that do not pair, or that hold neither an IPv6 address nor v<hex>.<any>."""
    x = before(after(netloc, "["), "]")
    groups = f"string_split({x}, ':')"
    full = f"list_filter({groups}, lambda g: g <> '')"
    v6 = (f"(regexp_full_match({x}, '[0-9A-Fa-f:]+') AND len(list_filter({groups}, lambda g: length(g) > 4)) = 0 AND "
          f"CASE WHEN contains({x}, '::') THEN NOT contains({x}, ':::') AND len(string_split({x}, '::')) = 2 "
          f"AND len({full}) <= 7 AND NOT regexp_matches({x}, '^:[^:]|[^:]:$') "
          f"ELSE len({groups}) = 8 AND len({full}) = 8 END)")
    return (f"(CASE WHEN contains({netloc}, '[') <> contains({netloc}, ']') THEN true WHEN contains({netloc}, '[') "
            f"THEN NOT {v6} AND NOT regexp_full_match({x}, 'v[0-9A-Fa-f]+[.](.|\\n)+') ELSE false END)")


def url_parts(st: Stages, src: str, p: str, default_scheme: str = "") -> Stages:
    """The standard library's order: scheme up to the first colon, fragment after
    the first #, query after the first ?, authority after //, parameters after
    the last segment's first semicolon."""
    c = lambda n: f"{p}_{n}"
    st.add(c("u"), rx(rx(f"coalesce({src}, '')", r"^[\x00-\x20]+"), r"[\t\r\n]"))
    st.add(c("pre"), f"(CASE WHEN contains({c('u')}, ':') THEN {before(c('u'), ':')} ELSE '' END)")
    st.add(c("has"), f"regexp_full_match({c('pre')}, '[A-Za-z][A-Za-z0-9+.-]*')")
    st.add(c("scheme"), f"(CASE WHEN {c('has')} THEN lower({c('pre')}) ELSE {q(default_scheme)} END)")
    st.add(c("rest"), f"(CASE WHEN {c('has')} THEN {after(c('u'), ':')} ELSE {c('u')} END)")
    st.add(c("fragment"), after(c("rest"), "#")).replace(c("rest"), before(c("rest"), "#"))
    st.add(c("query"), after(c("rest"), "?")).replace(c("rest"), before(c("rest"), "?"))
    st.add(c("netloc"), f"(CASE WHEN starts_with({c('rest')}, '//') THEN {before(f'substr({p}_rest, 3)', '/')} ELSE '' END)")
    st.add(c("pathall"), f"(CASE WHEN starts_with({c('rest')}, '//') THEN substr({c('rest')}, 3 + length({c('netloc')})) "
                         f"ELSE {c('rest')} END)")
    st.add(c("lastseg"), f"string_split({c('pathall')}, '/')[-1]")
    st.add(c("semi"), f"(CASE WHEN {c('scheme')} IN {inlist(USES_PARAMS)} THEN strpos({c('lastseg')}, ';') ELSE 0 END)")
    st.add(c("path"), f"(CASE WHEN {c('semi')} > 0 THEN substr({c('pathall')}, 1, length({c('pathall')}) - "
                      f"length({c('lastseg')}) + {c('semi')} - 1) ELSE {c('pathall')} END)")
    st.add(c("params"), f"(CASE WHEN {c('semi')} > 0 THEN substr({c('lastseg')}, {c('semi')} + 1) ELSE '' END)")
    st.add(c("err"), bad_host(c("netloc")))
    return st.drop(*[c(n) for n in ("u", "pre", "has", "rest", "pathall", "lastseg", "semi")])


def drop_parts(st: Stages, p: str) -> Stages:
    return st.drop(*[f"{p}_{n}" for n in ("scheme", "netloc", "path", "params", "query", "fragment", "err")])


def url_unparse(st: Stages, out: str, scheme: str, netloc: str, path: str, params: str, query: str,
                fragment: str) -> Stages:
    t = f"{out}__"
    st.add(t + "p1", f"(CASE WHEN {params} <> '' THEN {path} || ';' || {params} ELSE {path} END)")
    st.add(t + "p2", f"(CASE WHEN {netloc} <> '' AND {t}p1 <> '' AND NOT starts_with({t}p1, '/') "
                     f"THEN '/' || {t}p1 ELSE {t}p1 END)")
    st.add(t + "body", f"(CASE WHEN {netloc} <> '' THEN '//' || {netloc} || {t}p2 "
                       f"WHEN starts_with({t}p2, '//') THEN '//' || {t}p2 "
                       f"WHEN {scheme} IN {inlist(WITH_AUTHORITY)} AND ({t}p2 = '' OR starts_with({t}p2, '/')) "
                       f"THEN '//' || {t}p2 ELSE {t}p2 END)")
    st.add(out, f"(CASE WHEN {scheme} <> '' THEN {scheme} || ':' || {t}body ELSE {t}body END)"
                f" || (CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END)"
                f" || (CASE WHEN {fragment} <> '' THEN '#' || {fragment} ELSE '' END)")
    return st.drop(t + "p1", t + "p2", t + "body")


def normalize_url(st: Stages, src: str, out: str) -> Stages:
    t = f"{out}__"
    st.add(t + "s", strip_ws(f"coalesce({src}, '')"))
    st.add(t + "pre", f"(CASE WHEN starts_with({t}s, 'http://') OR starts_with({t}s, 'https://') THEN {t}s "
                      f"ELSE 'https://' || {t}s END)")
    url_parts(st, t + "pre", t)
    st.add(t + "host", rx(f"lower({t}_netloc)", r"^www\."))
    st.add(t + "p2", f"(CASE WHEN {t}_path = '/' THEN '' ELSE {t}_path END)")
    url_unparse(st, t + "res", "'https'", t + "host", t + "p2", t + "_params", t + "_query", t + "_fragment")
    st.add(out, f"(CASE WHEN {t}s = '' OR {t}_err THEN '' ELSE {t}res END)")
    drop_parts(st, t)
    return st.drop(t + "s", t + "pre", t + "host", t + "p2", t + "res")


def valid_url(st: Stages, src: str, out: str) -> Stages:
    t = f"{out}__"
    url_parts(st, src, t)
    st.add(out, f"(coalesce({src}, '') <> '' AND NOT {t}_err AND {t}_scheme <> '' AND {t}_netloc <> '')")
    return drop_parts(st, t)


def domain(st: Stages, src: str, out: str) -> Stages:
    t = f"{out}__"
    url_parts(st, src, t)
    st.add(out, f"(CASE WHEN {t}_err THEN '' ELSE {rx(f'lower({t}_netloc)', r'^www\.')} END)")
    return drop_parts(st, t)


def url_join(st: Stages, base: str, href: str, out: str) -> Stages:
    """Adds {out}, {out}_netloc, {out}_err like ``with_url_join``."""
    t = f"{out}__"
    b, h = t + "b", t + "h"
    st.add(t + "base", f"coalesce({base}, '')").add(t + "href", f"coalesce({href}, '')")
    url_parts(st, t + "base", b)
    url_parts(st, t + "href", h)
    B = lambda n: f"{b}_{n}"
    H = lambda n: f"{h}_{n}"
    st.add(t + "hs", f"(CASE WHEN {H('scheme')} = '' THEN {B('scheme')} ELSE {H('scheme')} END)")
    st.add(t + "foreign", f"({t}hs <> {B('scheme')} OR {t}hs NOT IN {inlist(USES_RELATIVE)})")
    st.add(t + "nets", f"({t}hs IN {inlist(WITH_AUTHORITY)})")
    st.add(t + "net", f"(CASE WHEN {t}nets AND {H('netloc')} = '' THEN {B('netloc')} ELSE {H('netloc')} END)")
    st.add(t + "bp0", f"string_split({B('path')}, '/')")
    st.add(t + "bp", f"(CASE WHEN {t}bp0[len({t}bp0)] <> '' THEN {t}bp0[1:len({t}bp0) - 1] ELSE {t}bp0 END)")
    st.add(t + "m0", f"(CASE WHEN starts_with({H('path')}, '/') THEN string_split({H('path')}, '/') "
                     f"ELSE list_concat({t}bp, string_split({H('path')}, '/')) END)")
    st.add(t + "m", f"(CASE WHEN len({t}m0) >= 2 THEN list_concat({t}m0[1:1], "
                    f"list_filter({t}m0[2:len({t}m0) - 1], lambda x: x <> ''), {t}m0[len({t}m0):len({t}m0)]) "
                    f"ELSE {t}m0 END)")
    st.add(t + "res", f"list_reduce({t}m, lambda acc, seg: CASE WHEN seg = '..' THEN "
                      f"(CASE WHEN len(acc) > 0 THEN acc[1:len(acc) - 1] ELSE acc END) "
                      f"WHEN seg = '.' THEN acc ELSE list_append(acc, seg) END, []::VARCHAR[])")
    st.add(t + "rp", f"array_to_string(CASE WHEN {t}m[len({t}m)] IN ('.', '..') THEN list_append({t}res, '') "
                     f"ELSE {t}res END, '/')")
    st.add(t + "rp2", f"(CASE WHEN {t}rp = '' THEN '/' ELSE {t}rp END)")
    st.add(t + "q", f"(CASE WHEN {H('query')} = '' THEN {B('query')} ELSE {H('query')} END)")
    url_unparse(st, t + "u1", t + "hs", H("netloc"), H("path"), H("params"), H("query"), H("fragment"))
    url_unparse(st, t + "u2", t + "hs", t + "net", B("path"), B("params"), t + "q", H("fragment"))
    url_unparse(st, t + "u3", t + "hs", t + "net", t + "rp2", H("params"), H("query"), H("fragment"))
    st.add(out, f"(CASE WHEN {t}base = '' THEN {t}href WHEN {t}href = '' THEN {t}base "
                f"WHEN {t}foreign THEN {t}href WHEN {t}nets AND {H('netloc')} <> '' THEN {t}u1 "
                f"WHEN {H('path')} = '' AND {H('params')} = '' THEN {t}u2 ELSE {t}u3 END)")
    st.add(out + "_netloc", f"(CASE WHEN {t}base = '' THEN {H('netloc')} WHEN {t}href = '' THEN {B('netloc')} "
                            f"WHEN {t}foreign THEN {H('netloc')} ELSE {t}net END)")
    st.add(out + "_err", f"(({B('err')} OR {H('err')}) AND {t}base <> '' AND {t}href <> '')")
    drop_parts(st, b)
    drop_parts(st, h)
    return st.drop(*[t + n for n in ("base", "href", "hs", "foreign", "nets", "net", "bp0", "bp", "m0", "m",
                                     "res", "rp", "rp2", "q", "u1", "u2", "u3")])


# ---------------------------------------------------------------------------
# HTML and links

def html_to_text(x: str, invisible: bool = False) -> str:
    """Comments, elements without page text and tags go, in this order; the few
    character references that the tables hold are decoded."""
    e = rx(f"coalesce({x}, '')", r"(?s)<!--.*?-->")
    quoted = """(?:"[^"]*"|'[^']*'|[^'">])*"""
    for tag in ["script", "style", "noscript", "head", "template"] + (["nav", "footer"] if invisible else []):
        e = rx(e, rf"(?is)<{tag}(?:\s{quoted})?>.*?(?:</{tag}\s*>|$)")
    e = rx(e, rf"(?is)</?[a-z!]{quoted}>")
    for name, ch in [("middot", "·"), ("copy", "©"), ("quot", '"'), ("amp", "&")]:
        e = rx(e, f"&{name};?", ch)
    return strip_ws(collapse_ws(e))


def marked_text(markup: list[tuple[str, str]], text: str) -> str:
    """The known text of the piece put before a page, and the page's own."""
    known = "[" + ", ".join(q(t) for _, t in markup) + "]"
    return strip_ws(collapse_ws(f"({known}[(page_id % {len(markup)}) + 1] || {text})"))


def raw_text(x: str, invisible: bool = False) -> str:
    """Text of a page with its outer white space: the text of <i>|</i> + page, less the mark."""
    return f"substr({html_to_text(f'({q(chr(124))} || {x})', invisible)}, 2)"


def strip_tags(x: str) -> str:
    return strip_ws(collapse_ws(rx(f"coalesce({x}, '')", r"<[^>]+>")))


def site_pages() -> str:
    from sitelens.plans import standin as Si
    anchors = "[" + ", ".join(q(x) for x in Si.PRICING_ANCHORS) + "]"
    return (f"SELECT page_id, url, {anchors}[(page_id % {len(Si.PRICING_ANCHORS)}) + 1] || html AS html FROM pages UNION ALL "
            f"SELECT -1 - page_id, 'https://blank-' || page_id || '.test/', {q(Si.BLANK_HTML)} FROM pages "
            f"WHERE page_id % {Si.BLANK_EVERY} = {Si.BLANK_AT}")


def typed_url(request_id: str, page_url: str) -> str:
    from sitelens.plans import standin as Si
    cases = " ".join(f"WHEN {request_id} % {Si.TYPED_EVERY} = {i} THEN {q(t)}" for i, t in enumerate(Si.TYPED))
    return f"(CASE {cases} ELSE {page_url} END)"


def pricing_link(st: Stages, html: str, base: str, out: str) -> Stages:
    """Walk the anchors in order: the first keyword link of the page's own
    authority; a keyword link with a bad host before it ends the walk."""
    from sitelens.operators.links import LINK_PATTERN, PRICING_KEYWORDS, SKIPPED_HREF_PREFIXES
    links = page_links(f"SELECT page_id, {base}, {html} FROM ({st})", keep=[base])
    keyword = " OR ".join(f"contains(lower(href || ' ' || text), {q(k)})" for k in PRICING_KEYWORDS)
    ln = Stages(f"SELECT * FROM ({links}) WHERE {keyword}")
    url_join(ln, base, "href", "abs")
    url_parts(ln, base, "home")
    skip = " OR ".join(f"starts_with(href, {q(p)})" for p in SKIPPED_HREF_PREFIXES)
    ln.where(f"abs_err OR home_err OR (abs_netloc = home_netloc AND NOT ({skip}))")
    first = f"SELECT _of, _link FROM (SELECT page_id AS _of, CASE WHEN NOT abs_err AND NOT home_err THEN abs END AS _link, " \
            f"row_number() OVER (PARTITION BY page_id ORDER BY pos) AS _k FROM ({ln})) WHERE _k = 1"
    return Stages(f"SELECT t.*, f._link AS {out} FROM ({st}) t LEFT JOIN ({first}) f ON f._of = t.page_id")


def page_links(pages_sql: str, keep: list[str] | None = None) -> str:
    from sitelens.operators.links import LINK_PATTERN
    keep = list(keep or [])
    kc = "".join(f", {k}" for k in keep)
    inner = (f"SELECT page_id{kc}, regexp_extract_all(html, {q(LINK_PATTERN)}, 1) AS hr, "
             f"regexp_extract_all(html, {q(LINK_PATTERN)}, 2) AS tx FROM ({pages_sql})")
    ex = (f"SELECT page_id{kc}, unnest(list_transform(range(1, len(hr) + 1), lambda i: "
          f"{{'pos': i - 1, 'href': hr[i], 'text': tx[i]}})) AS l FROM ({inner})")
    return f"SELECT page_id, l.pos::BIGINT AS pos, l.href AS href, l.text AS text{kc} FROM ({ex})"


def page_features() -> str:
    st = Stages(site_pages())
    normalize_url(st, "url", "norm_url")
    st = pricing_link(st, "html", "norm_url", "pricing_link")
    st.add("text", html_to_text("html"))
    normalize_url(st, "pricing_link", "pricing_key")
    st.replace("pricing_key", "(CASE WHEN pricing_link IS NOT NULL THEN pricing_key END)")
    return str(st.select("page_id, norm_url, text, pricing_link, pricing_key"))


def crawl_snapshot() -> str:
    """``WITH`` prefix that defines feats, snap (one row per address) and site
    (with the contents of linked pages that were not crawled)."""
    return (f"WITH RECURSIVE feats AS MATERIALIZED ({page_features()}), "
            "snap AS MATERIALIZED (SELECT * FROM feats QUALIFY row_number() OVER (PARTITION BY norm_url ORDER BY page_id DESC) = 1), "
            "wanted AS (SELECT pricing_key AS target, min(page_id) AS src FROM feats WHERE pricing_key IS NOT NULL "
            "AND pricing_key NOT IN (SELECT norm_url FROM snap) GROUP BY pricing_key), "
            "site AS MATERIALIZED (SELECT norm_url, text, pricing_link, pricing_key FROM snap UNION ALL "
            "SELECT w.target, c.text, NULL, NULL FROM wanted w JOIN feats c ON c.page_id = w.src + 1) ")


def content_bundle(requests_sql: str) -> Stages:
    """Needs ``crawl_snapshot()`` before it; ``requests_sql`` has norm_url."""
    st = Stages(f"SELECT r.*, s.text AS _home, s.pricing_link AS _plink, s.pricing_key AS _pkey "
                f"FROM ({requests_sql}) r LEFT JOIN site s ON r.norm_url = s.norm_url")
    n = f"length({strip_ws('_home')})"
    st.add("fetched", "_home IS NOT NULL")
    st.add("home_text", f"(CASE WHEN {n} < 50 THEN '' ELSE _home END)")
    st.add("requires_js", f"({n} < 500)")
    st = Stages(f"SELECT b.*, p.text AS _price FROM ({st}) b LEFT JOIN site p ON b._pkey = p.norm_url "
                f"AND b.home_text <> '' AND length({strip_ws('p.text')}) > 50")
    st.add("pricing_url", "(CASE WHEN _price IS NOT NULL THEN _plink END)").add("pricing_text", "_price")
    return st.drop("_home", "_plink", "_pkey", "_price")


def typed_requests() -> str:
    st = Stages(f"SELECT page_id AS request_id, {typed_url('page_id', 'url')} AS url FROM pages")
    return str(normalize_url(st, "url", "norm_url"))


# ---------------------------------------------------------------------------
# Text

def clean_text(x: str) -> str:
    from sitelens.functions.text import CLEAN_TEXT_EXTRA
    e = collapse_ws(strip_ws(f"coalesce({x}, '')"))
    return rx(e, rf"[^\p{{L}}\p{{N}}_ {CLEAN_TEXT_EXTRA}]")


def nav_patterns(x: str) -> str:
    from sitelens.functions.text import NAV_NOISE_PATTERNS
    e = x
    for p in NAV_NOISE_PATTERNS:  # RE2 reads them but for Python's white space and digits
        e = rx(e, "(?i)" + p.replace(r"\s", WS).replace(r"\d", r"\p{Nd}"))
    return e


def split_ws(x: str) -> str:
    s = strip_ws(x)
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({s}, {q(WS + '+')}) END)"


def words(docs_sql: str, text: str = "text") -> str:
    ex = (f"SELECT doc_id, unnest(list_transform(range(1, len(ws) + 1), lambda i: {{'pos': i - 1, 'word': ws[i]}})) AS l "
          f"FROM (SELECT doc_id, {split_ws(text)} AS ws FROM ({docs_sql}) WHERE len({split_ws(text)}) > 10)")
    return (f"SELECT doc_id, l.pos AS pos, l.word AS word, "
            f"CASE WHEN length(l.word) > 3 THEN lower(l.word) END AS lw FROM ({ex})")


def frequent_words(docs_sql: str, text: str = "text") -> str:
    return (f"SELECT doc_id, lw AS word, count(*) AS n FROM ({words(docs_sql, text)}) "
            f"WHERE lw IS NOT NULL GROUP BY doc_id, lw HAVING count(*) > 3")


def drop_frequent_words(docs_sql: str, text: str = "text", out: str = "text_out") -> str:
    short = f"SELECT doc_id, {strip_ws(text)} AS {out} FROM ({docs_sql}) WHERE len({split_ws(text)}) <= 10"
    w = f"SELECT *, count(lw) OVER (PARTITION BY doc_id, lw) AS cnt FROM ({words(docs_sql, text)})"
    joined = (f"SELECT doc_id, coalesce(string_agg(CASE WHEN cnt <= 3 THEN word END, ' ' ORDER BY pos), '') AS {out} "
              f"FROM ({w}) GROUP BY doc_id")
    return f"{short} UNION ALL {joined}"


# ---------------------------------------------------------------------------
# Answers

def synthetic_answers() -> str:
    """The stand-in answers, text by text: pieces by length, then shapes."""
    from sitelens.functions.answers import JS_NOTE
    from sitelens.plans import answers as AP
    from sitelens.schemas import FIELD_KEYS, FIELDS

    def pieces(x: str, count: str) -> str:
        width = f"CAST(ceil(length({x}) / ({count})::DOUBLE) AS BIGINT)"
        return f"list_transform(range(0, {count}), lambda j: substr({x}, j * {width} + 1, {width}))"

    lines = lambda x, count: f"array_to_string({pieces(x, count)}, {q(chr(92) + 'n')})"
    nl, shape, pairs = q(chr(92) + "n"), "(doc_id % 10)", []
    for i, c in enumerate(FIELDS):
        v = f"coalesce(p[{i + 1}], '')"
        if c == "target_audience_pains":
            v = lines(v, "(doc_id % 7) + 3")
        elif c == "faq":
            v = lines(v, "(doc_id % 8) + 10")
        elif c == "prices_tariffs":
            v = (f"{v} || (CASE doc_id % 3 WHEN 0 THEN ' (главная)' WHEN 1 THEN {q(f' (цены: {AP.PRICED_URL})')} "
                 f"ELSE '' END)")
        elif c == "notes":
            v = f"{v} || (CASE WHEN n_chars < 500 THEN {q(' ' + JS_NOTE)} ELSE '' END)"
        elif c == "brief_summary":
            p3 = [f"{pieces(v, '3')}[{k}]" for k in (1, 2, 3)]
            v = (f"(CASE doc_id % 5 WHEN 0 THEN '- ' || {p3[0]} || {nl} || '- ' || {p3[1]} || {nl} || '- ' || {p3[2]} "
                 f"WHEN 1 THEN '• ' || {p3[0]} || {nl} || '• ' || {p3[1]} || {p3[2]} "
                 f"WHEN 2 THEN {p3[0]} || '. ' || {p3[1]} || '. ' || {p3[2]} || '.' WHEN 3 THEN '' ELSE {v} END)")
        r = f"('\"' || {v} || '\"')"
        if c == "guarantees":
            r = f"(CASE WHEN {shape} = 4 THEN '12' ELSE {r} END)"
        if c == "benefits":
            r = f"(CASE WHEN {shape} = 6 THEN '[\"' || {v} || '\", \"x\"]' ELSE {r} END)"
        if c == "notes":
            r = f"(CASE WHEN {shape} = 9 THEN 'null' ELSE {r} END)"
        pair = f"{q(chr(34) + FIELD_KEYS[i] + chr(34) + ': ')} || {r}"
        pairs.append(f"(CASE WHEN {shape} <> 7 THEN {pair} END)" if i >= 12 else pair)
    at = lambda c: f"p[{FIELDS.index(c) + 1}]"
    spare = (f"((CASE WHEN {shape} = 4 THEN {at('guarantees')} ELSE '' END) || (CASE WHEN {shape} = 9 THEN {at('notes')} ELSE '' END) "
             f"|| (CASE WHEN doc_id % 5 = 3 AND {shape} <> 7 THEN {at('brief_summary')} ELSE '' END))")
    extra = (f"(CASE WHEN {shape} = 8 OR {spare} <> '' THEN {q(chr(34) + AP.SPARE_KEY + chr(34) + ': ' + chr(34))} || {spare} "
             f"|| '\"' END)")
    clean = f"trim({rx(rx('text', r'[^\p{L}\p{N} ]', ' '), ' +', ' ')})"
    st = Stages(f"SELECT doc_id, n_chars, {clean} AS s FROM documents")
    st.add("p", pieces("s", f"(CASE WHEN {shape} = 7 THEN 12 ELSE 24 END)"))
    st.add("obj", f"('{{' || concat_ws(', ', {', '.join(pairs)}, {extra}) || '}}')")
    st.add("raw", f"(CASE {shape} WHEN 1 THEN '```json' || chr(10) || obj || chr(10) || '```' "
                  f"WHEN 2 THEN 'Вот ответ:' || chr(10) || obj || chr(10) || {q(AP.CLOSING)} || (CASE WHEN doc_id % 20 = 2 THEN {q(AP.BRACED)} ELSE '' END) "
                  f"WHEN 3 THEN substr(obj, 1, length(obj) - 2) "
                  f"WHEN 5 THEN '```' || chr(10) || obj || chr(10) || '```' ELSE obj END)")
    return str(st.select("doc_id, n_chars, raw"))


def parsed_answers() -> str:
    from sitelens.schemas import ANSWER_FIELDS, FIELDS
    st = Stages(f"SELECT doc_id, n_chars, {json_unwrap('raw')} AS json_text FROM ({synthetic_answers()})")
    return f"SELECT doc_id, n_chars, parse_ok, {', '.join(FIELDS)} FROM ({answer_fields(st, 'json_text', ANSWER_FIELDS)})"


def json_unwrap(x: str) -> str:
    e = strip_ws(rx(rx(f"coalesce({x}, '')", f"```json{WS}*"), f"```{WS}*$"))
    return f"coalesce(nullif(regexp_extract({e}, {q(r'(?s)\{.*\}')}, 0), ''), {e})"


def answer_fields(st: Stages, json_col: str, keys: list[tuple[str, str]], ok_col: str = "parse_ok") -> Stages:
    jp = lambda k: q('$."' + k + '"')
    st.add("_valid", f"coalesce(json_valid({json_col}), false)")
    st.add("_obj", f"(CASE WHEN _valid THEN json_type({json_col}) = 'OBJECT' ELSE false END)")
    for c, k in keys:
        st.add(f"_t_{c}", f"(CASE WHEN _obj THEN json_type({json_col}, {jp(k)}) END)")
    ok = " AND ".join(["_obj"] + [f"(_t_{c} IS NULL OR _t_{c} = 'VARCHAR')" for c, _ in keys])
    st.add(ok_col, f"({ok})")
    for c, k in keys:
        st.add(c, f"(CASE WHEN {ok_col} THEN coalesce(json_extract_string({json_col}, {jp(k)}), '') END)")
    return st.drop("_valid", "_obj", *[f"_t_{c}" for c, _ in keys])


def summary_points(x: str) -> str:
    t = f"coalesce({x}, '')"
    lines = f"list_transform(string_split({t}, chr(10)), lambda l: {strip_ws('l')})"
    marked = f"list_filter({lines}, lambda l: left(l, 1) IN ('-', '•', '*'))"
    pts = f"list_filter(list_transform({marked}, lambda l: {strip_ws('substr(l, 2)')}), lambda p: p <> '')"
    sent = f"list_filter(list_transform(string_split({t}, '.'), lambda z: {strip_ws('z')}), lambda z: z <> '')"
    return f"(CASE WHEN len({pts}) > 0 THEN {pts} ELSE {sent} END)[1:4]"


def short_summary(brief: str = "brief_summary") -> str:
    fb = ("list_filter([substr(offer_first_screen, 1, 100), substr(product_services, 1, 100), "
          "substr(marketing_insights, 1, 100)], lambda z: z <> '')[1:4]")
    sp = summary_points(brief)
    return f"(CASE WHEN len({sp}) > 0 THEN {sp} ELSE {fb} END)"


def quality_flags() -> dict[str, str]:
    lines = lambda c: f"string_split({c}, chr(10))"
    return {
        "pains_ok": f"(target_audience_pains = '' OR len({lines('target_audience_pains')}) >= 7)",
        "faq_ok": f"(len(list_filter({lines('faq')}, lambda z: {strip_ws('z')} <> '')) <= 15)",
        "summary_ok": "(len(short_summary) IN (3, 4))",
        "price_source_ok": ("(prices_tariffs = '' OR contains(prices_tariffs, CASE WHEN pricing_url IS NULL THEN 'главная' "
                            "ELSE 'цены: ' || pricing_url END))"),
        "js_note_ok": "(NOT requires_js OR contains(notes, 'Возможен JS-рендеринг'))",
    }


# ---------------------------------------------------------------------------
# Event logs

def k_of() -> str:
    return "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def audit_requests() -> str:
    from sitelens.sources.eventlog import FAILED_KIND, REQUEST_KINDS
    return (f"SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS user_id, ts, event_type AS kind, "
            f"event_type <> {q(FAILED_KIND)} AS would_succeed FROM events WHERE event_type IN {inlist(REQUEST_KINDS)}")


def sheet_id(x: str) -> str:
    from sitelens.functions.urls import SHEET_ID_PATTERNS
    hits = [f"nullif(regexp_extract({x}, {q(p)}, 1), '')" for p in SHEET_ID_PATTERNS]
    return f"coalesce({', '.join(hits)}, '')"


def sheet_links() -> str:
    from sitelens.schemas import SHEET_URL_PREFIX
    from sitelens.sources.eventlog import COMMAND_MIN_K, NEVER_CONNECTS, SETTING_KIND
    k = k_of()
    never = f"user_id % {NEVER_CONNECTS[0]} = {NEVER_CONNECTS[1]}"
    link = (f"(CASE WHEN {k} % 10 = 0 OR {never} THEN 'https://docs.google.com/spreadsheets/u/0/' "
            f"ELSE {q(SHEET_URL_PREFIX)} || 'sh' || CAST({k} AS VARCHAR) || '/edit#gid=0' END)")
    inner = (f"SELECT event_id, ts, CAST(user_id AS VARCHAR) AS user_id, {link} AS link FROM events "
             f"WHERE event_type = {q(SETTING_KIND)} AND {k} < {COMMAND_MIN_K}")
    return f"SELECT *, {sheet_id('link')} AS sheet_id FROM ({inner})"


def limit_commands() -> str:
    from sitelens.sources.eventlog import COMMAND_MIN_K, SETTING_KIND
    k = k_of()
    t = f"CAST({k} AS VARCHAR)"
    n = "CAST(CAST(floor(value) AS BIGINT) % 30 AS VARCHAR)"
    args = (f"(CASE WHEN {k} % 5 = 0 THEN [{t}] WHEN {k} % 5 = 1 THEN [{t}, 'ten'] "
            f"WHEN {k} % 5 = 2 THEN [{t}, CAST(-({k} % 3) - 1 AS VARCHAR)] ELSE [{t}, {n}] END)")
    return (f"SELECT event_id, ts, user_id AS actor, {args} AS args FROM events "
            f"WHERE event_type = {q(SETTING_KIND)} AND {k} >= {COMMAND_MIN_K}")


def is_admin(actor: str) -> str:
    from sitelens.sources.eventlog import ADMIN_IDS
    ids = (f"list_transform(list_filter(list_transform(string_split({q(ADMIN_IDS)}, ','), lambda x: {strip_ws('x')}), "
           f"lambda x: x <> ''), lambda x: TRY_CAST(x AS BIGINT))")
    return f"(NOT list_bool_or(list_transform({ids}, lambda x: x IS NULL)) AND list_contains({ids}, {actor}))"


def limit_changes() -> str:
    ok = f"{is_admin('actor')} AND len(args) = 2 AND coalesce(TRY_CAST(args[2] AS BIGINT) >= 0, false)"
    return (f"SELECT event_id, ts, args[1] AS user_id, CAST(args[2] AS BIGINT) AS max_limit "
            f"FROM ({limit_commands()}) WHERE {ok}")


def timeline() -> str:
    return (f"SELECT user_id, ts, request_id, CAST(would_succeed AS BIGINT) AS ws, NULL::BIGINT AS new_limit "
            f"FROM ({audit_requests()}) UNION ALL "
            f"SELECT user_id, ts, event_id AS request_id, 0 AS ws, max_limit AS new_limit FROM ({limit_changes()})")


# ---------------------------------------------------------------------------
# Audit pipeline and outbox

def iso_ts(ts: str) -> str:
    return (f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({ts}) % 1000000 <> 0 "
            f"THEN '.' || lpad(CAST(epoch_us({ts}) % 1000000 AS VARCHAR), 6, '0') ELSE '' END)")


def replay(timeline_sql: str, name: str = "walk") -> str:
    """Common tables that walk each user's timeline event by event: check, then
    count, with the limits row as the only state."""
    from sitelens.schemas import DEFAULT_USER_LIMIT as D
    return (f"{name}_log AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, request_id) AS k "
            f"FROM ({timeline_sql})), "
            f"{name}(user_id, k, request_id, is_change, admitted, used, lim) AS ("
            f"SELECT user_id, k, request_id, new_limit IS NOT NULL, new_limit IS NULL AND 0 < {D}, "
            f"CASE WHEN new_limit IS NULL AND 0 < {D} THEN ws ELSE 0 END::BIGINT, coalesce(new_limit, {D})::BIGINT "
            f"FROM {name}_log WHERE k = 1 UNION ALL "
            f"SELECT e.user_id, e.k, e.request_id, e.new_limit IS NOT NULL, e.new_limit IS NULL AND w.used < w.lim, "
            f"w.used + CASE WHEN e.new_limit IS NULL AND w.used < w.lim THEN e.ws ELSE 0 END, coalesce(e.new_limit, w.lim) "
            f"FROM {name} w JOIN {name}_log e ON e.user_id = w.user_id AND e.k = w.k + 1)")


def audit() -> str:
    """``WITH`` prefix that defines answers, decided (a row per request) and results."""
    from sitelens.schemas import FIELDS
    req = (f"SELECT r.*, {typed_url('r.request_id', 'p.url')} AS url FROM ({audit_requests()}) r "
           f"LEFT JOIN pages p ON p.page_id = r.request_id % (SELECT count(*) FROM pages)")
    st = Stages(req)
    normalize_url(st, "url", "norm_url")
    bundle = str(content_bundle(str(st)))
    checked = (f"SELECT b.*, coalesce(a.parse_ok, false) AS parsed, a.doc_id FROM ({bundle}) b LEFT JOIN answers a "
               f"ON a.doc_id = b.request_id % (SELECT count(*) FROM documents)")
    pre = ("(CASE WHEN norm_url = '' THEN 'invalid_url' WHEN NOT fetched THEN 'internal_error' "
           "WHEN home_text = '' THEN 'fetch_failed' WHEN would_succeed AND parsed THEN 'ok' ELSE 'internal_error' END)")
    fault = ("(CASE WHEN pre <> 'internal_error' THEN NULL WHEN NOT fetched THEN 'page not reached' "
             "WHEN NOT would_succeed THEN 'model call failed' ELSE 'answer is not a record' END)")
    checked = str(Stages(checked).add("pre", pre).add("fault", fault))
    tl = (f"SELECT user_id, ts, request_id, (pre = 'ok')::BIGINT AS ws, NULL::BIGINT AS new_limit FROM checked UNION ALL "
          f"SELECT user_id, ts, event_id, 0, max_limit FROM ({limit_changes()})")
    conn = (f"SELECT user_id, ts, event_id AS id, sheet_id FROM ({sheet_links()}) WHERE sheet_id <> ''")
    decided = ("SELECT c.request_id, c.user_id, c.ts, c.doc_id, c.norm_url, c.pricing_url, "
               "CASE WHEN w.admitted THEN c.pre ELSE 'limit' END AS reason, CASE WHEN w.admitted THEN c.fault END AS error, "
               f"(SELECT arg_max(l.sheet_id, (l.ts, l.id)) FROM ({conn}) l WHERE l.user_id = c.user_id "
               "AND (l.ts, l.id) < (c.ts, c.request_id)) AS sheet_id "
               "FROM checked c JOIN walk w ON w.request_id = c.request_id AND w.user_id = c.user_id AND NOT w.is_change")
    fr = "{" + ", ".join(f"'{c}': {c}" for c in FIELDS) + "}"
    env = (f"to_json({{'full_result': {fr}, 'pricing_url': pricing_url, 'timestamp': {iso_ts('ts')}, "
           f"'short_summary': {short_summary()}}})::VARCHAR")
    results = (f"SELECT request_id, user_id, ts, norm_url AS url, sheet_id, {env} AS result_json "
               f"FROM decided d JOIN answers a ON a.doc_id = d.doc_id WHERE reason = 'ok'")
    return (f"{crawl_snapshot()}, answers AS MATERIALIZED ({parsed_answers()}), checked AS MATERIALIZED ({checked}), "
            f"{replay(tl)}, decided AS MATERIALIZED ({decided}), results AS ({results}) ")


def first_connections() -> str:
    return (f"SELECT user_id, min(ts) AS conn_ts, arg_min(event_id, (ts, event_id)) AS conn_event_id, "
            f"arg_min(sheet_id, (ts, event_id)) AS conn_sheet_id FROM ({sheet_links()}) WHERE sheet_id <> '' "
            f"GROUP BY user_id")


def pending_rows() -> str:
    """Needs ``audit()`` before it."""
    return (f"SELECT row_number() OVER (ORDER BY r.ts, r.request_id) AS row_id, c.conn_ts AS flushed_at, "
            f"r.request_id AS id, sha256(r.request_id || '|' || r.user_id || '|' || r.norm_url) AS row_key, r.user_id, "
            f"r.norm_url AS url, r.ts AS created_at, "
            f"c.conn_event_id IS NOT NULL AS written, c.conn_event_id AS flush_event_id, c.conn_sheet_id AS flushed_to "
            f"FROM decided r LEFT JOIN ({first_connections()}) c ON r.user_id = c.user_id "
            f"WHERE r.reason = 'ok' AND r.sheet_id IS NULL")


def deliveries() -> str:
    from sitelens.plans import audit as Au
    stored = " ".join(
        f"WHEN request_id % {Au.BROKEN_EVERY} = {at} THEN "
        + ("substr(result_json, 1, length(result_json) - 5)" if text == "cut" else q(text))
        for at, text in Au.BROKEN_RESULTS.items())
    sent = (f"SELECT request_id, r.user_id, url, result_json, ts AS created_at, "
            f"coalesce(sheet_id, conn_sheet_id) AS sheet_id FROM results r LEFT JOIN ({first_connections()}) c "
            f"ON c.user_id = r.user_id WHERE coalesce(sheet_id, conn_sheet_id) IS NOT NULL")
    broken = ", ".join(str(at) for at in Au.BROKEN_RESULTS)
    return (f"SELECT * FROM ({sent}) UNION ALL SELECT -1 - request_id, user_id, url, CASE {stored} END, created_at, sheet_id "
            f"FROM ({sent}) WHERE request_id % {Au.BROKEN_EVERY} IN ({broken})")


def report_row(src_sql: str, stamped: bool = False) -> str:
    from sitelens.schemas import ERROR_CELL_PREFIX, FIELDS
    st = Stages(src_sql)
    st.add("_ev", "coalesce(json_valid(result_json), false)")
    st.add("_eobj", "(CASE WHEN _ev THEN json_type(result_json) = 'OBJECT' ELSE false END)")
    st.add("_frt", "(CASE WHEN _eobj THEN json_type(result_json, '$.full_result') END)")
    st.add("_put", "(CASE WHEN _eobj THEN json_type(result_json, '$.pricing_url') END)")
    st.add("_fr_ok", "(_frt IS NULL OR _frt = 'OBJECT')")
    st.add("_pu_ok", "(_put IS NULL OR _put IN ('VARCHAR', 'NULL'))")
    st.add("_frj", "coalesce(CASE WHEN _eobj THEN json_extract(result_json, '$.full_result')::VARCHAR END, '{}')")
    st.add("_pu", "coalesce(CASE WHEN _eobj THEN json_extract_string(result_json, '$.pricing_url') END, '')")
    answer_fields(st, "_frj", [(f"_f_{c}", c) for c in FIELDS], "_fields_ok")
    st.add("row_ok", "(_eobj AND _fr_ok AND _pu_ok AND _fields_ok)")
    reason = ("(CASE WHEN NOT _ev THEN 'invalid JSON' WHEN NOT _eobj THEN 'not an object' "
              "WHEN NOT _fr_ok THEN 'full_result is not an object' WHEN NOT _pu_ok THEN 'pricing_url is not a string' "
              "ELSE 'field is not a string' END)")
    stamp = "strftime(created_at, '%Y-%m-%d %H:%M:%S')"
    cells = [f"{stamp} AS timestamp" if stamped else f"(CASE WHEN row_ok THEN '' ELSE {stamp} END) AS timestamp",
             "CAST(user_id AS VARCHAR) AS user_id", "url AS analyzed_url",
             "(CASE WHEN row_ok THEN _pu ELSE '' END) AS pricing_url"]
    for i, c in enumerate(FIELDS):
        err = f"{q(ERROR_CELL_PREFIX)} || {reason}" if i == 0 else "''"
        cells.append(f"(CASE WHEN row_ok THEN _f_{c} ELSE {err} END) AS {c}")
    return f"SELECT request_id, sheet_id, row_ok, {', '.join(cells)} FROM ({st})"
