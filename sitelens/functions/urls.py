"""URL column functions.

All of them follow the Python standard library's URL splitting rules
(RFC 3986 appendix B style: scheme, ``//authority``, path, ``?query``,
``#fragment``), written as regex/substring column expressions so they run in
whole-stage codegen. ``parse_url`` is not used: it rejects spaces and
underscores in hosts, which the audited application accepts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import strip_ws

# Schemes for which a relative reference is resolved against a
# base (others are returned unchanged), as in the standard library.
USES_RELATIVE = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https",
                 "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn",
                 "svn+ssh", "ws", "wss"]
# Schemes whose path may carry ";params".
USES_PARAMS = ["", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp",
               "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel"]

_H4 = "[0-9A-Fa-f]{1,4}"
# A bracketed host must be an IPv6 literal (or an IPvFuture "v<hex>.<x>").
_IPV6 = ("^(" + "|".join([
    f"({_H4}:){{7}}{_H4}",
    f"({_H4}:){{1,7}}:",
    f"({_H4}:){{1,6}}:{_H4}",
    f"({_H4}:){{1,5}}(:{_H4}){{1,2}}",
    f"({_H4}:){{1,4}}(:{_H4}){{1,3}}",
    f"({_H4}:){{1,3}}(:{_H4}){{1,4}}",
    f"({_H4}:){{1,2}}(:{_H4}){{1,5}}",
    f"{_H4}:(:{_H4}){{1,6}}",
    f":((:{_H4}){{1,7}}|:)",
]) + ")$")
_IPVFUTURE = r"^v[a-fA-F0-9]+\.[\s\S]+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _after(s: Column, ch: str) -> Column:
    """Text after the first ``ch``; '' when absent."""
    pos = F.instr(s, ch)
    return F.when(pos > 0, s.substr(pos + 1, F.lit(1 << 30))).otherwise(F.lit(""))


def _before(s: Column, ch: str) -> Column:
    """Text before the first ``ch``; all of it when absent."""
    return F.substring_index(s, ch, 1)


# One pass over a URL in the standard library's order: scheme (only when every
# character before the first ':' is a scheme character), "//" authority,
# path, "?query", "#fragment" (the fragment starts at the first '#').
URL_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"


def with_url_parts(df: DataFrame, src, p: str, default_scheme: str = "") -> DataFrame:
    """Split a URL like ``urllib.parse.urlparse`` does.

    Adds ``{p}_scheme, {p}_netloc, {p}_path, {p}_params, {p}_query,
    {p}_fragment`` and ``{p}_err`` (true where the standard library raises:
    unbalanced or invalid bracketed host), plus ``{p}_``-prefixed helper
    columns the caller drops. Null input is treated as ''.
    """
    c = lambda n: F.col(f"{p}_{n}")
    df = df.withColumn(f"{p}_u", F.regexp_replace(F.regexp_replace(
        F.coalesce(_col(src), F.lit("")), r"^[\x00-\x20]+", ""), r"[\t\r\n]", ""))
    x = lambda k: F.regexp_extract(c("u"), URL_SPLIT, k)
    df = df.withColumns({
        f"{p}_scheme": F.when(x(1) != "", F.lower(x(1))).otherwise(F.lit(default_scheme)),
        f"{p}_netloc": x(2), f"{p}_pathall": x(3), f"{p}_query": x(4), f"{p}_fragment": x(5),
        # ;params live in the last path segment (after the last '/').
        f"{p}_lastseg": F.substring_index(x(3), "/", -1)})
    semi = F.when(c("scheme").isin(USES_PARAMS), F.instr(c("lastseg"), ";")).otherwise(F.lit(0))
    br = _before(_after(c("netloc"), "["), "]")
    return df.withColumns({
        f"{p}_path": F.when(semi > 0, c("pathall").substr(
            F.lit(1), F.length(c("pathall")) - F.length(c("lastseg")) + semi - 1)).otherwise(c("pathall")),
        f"{p}_params": F.when(semi > 0, c("lastseg").substr(semi + 1, F.lit(1 << 30))).otherwise(F.lit("")),
        f"{p}_err": F.when((F.instr(c("netloc"), "[") > 0) != (F.instr(c("netloc"), "]") > 0), F.lit(True))
        .when(F.instr(c("netloc"), "[") > 0, ~br.rlike(_IPV6) & ~br.rlike(_IPVFUTURE))
        .otherwise(F.lit(False))})


def _part_names(p: str) -> list[str]:
    return [f"{p}_{n}" for n in ("u", "pathall", "lastseg", "scheme", "netloc", "path", "params", "query",
                                 "fragment", "err")]


def _unparse_expr(scheme, netloc, path, params, query, fragment) -> Column:
    p1 = F.when(params != "", F.concat(path, F.lit(";"), params)).otherwise(path)
    p2 = F.when((netloc != "") & (p1 != "") & ~p1.startswith("/"), F.concat(F.lit("/"), p1)).otherwise(p1)
    return (F.when(netloc != "", F.concat(F.lit("//"), netloc, p2))
            .when(p2.startswith("//"), F.concat(F.lit("//"), p2))
            .when(scheme.isin(_USES_NETLOC) & ((p2 == "") | p2.startswith("/")), F.concat(F.lit("//"), p2))
            .otherwise(p2))


def with_url_unparse(df: DataFrame, specs: list[tuple]) -> DataFrame:
    """Adds one column per ``(out, scheme, netloc, path, params, query,
    fragment)`` spec: ``urllib.parse.urlunparse`` of the six components
    (column names or columns). All specs share two projections."""
    bodies = {}
    for out, *parts in specs:
        sch, net, path, params, query, frag = map(_col, parts)
        bodies[f"__{out}_body"] = _unparse_expr(sch, net, path, params, query, frag)
    df = df.withColumns(bodies)
    outs = {}
    for out, *parts in specs:
        sch, _, _, _, query, frag = map(_col, parts)
        b = F.col(f"__{out}_body")
        outs[out] = F.concat(F.when(sch != "", F.concat(sch, F.lit(":"), b)).otherwise(b),
                             F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
                             F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(F.lit("")))
    return df.withColumns(outs).drop(*bodies)


# Schemes whose URLs are written with "//" even without a host.
_USES_NETLOC = ["", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms",
                "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync",
                "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services"]


def _drop_parts(df: DataFrame, p: str) -> DataFrame:
    return df.drop(*_part_names(p))


def with_normalized_url(df: DataFrame, src, out: str) -> DataFrame:
    """Canonical https URL of a user-typed address (P-1).

    Null/blank -> ''. Whitespace stripped; ``https://`` prefixed unless the
    text starts (case-sensitively) with ``http://`` or ``https://``; scheme
    forced to https; authority lower-cased and one leading ``www.`` dropped;
    a bare ``/`` path removed; params, query and fragment kept (empty ones
    vanish). Parse errors -> ''.
    """
    t = f"__{out}"
    s0 = strip_ws(F.coalesce(_col(src), F.lit("")))
    df = df.withColumn(f"{t}_s", s0)
    s = F.col(f"{t}_s")
    pre = F.when(s.startswith("http://") | s.startswith("https://"), s).otherwise(F.concat(F.lit("https://"), s))
    df = with_url_parts(df, pre, t)
    c = lambda n: F.col(f"{t}_{n}")
    df = df.withColumns({f"{t}_host": F.regexp_replace(F.lower(c("netloc")), r"^www\.", ""),
                         f"{t}_p2": F.when(c("path") == "/", F.lit("")).otherwise(c("path"))})
    df = with_url_unparse(df, [(f"{t}_res", F.lit("https"), c("host"), c("p2"), c("params"), c("query"),
                                c("fragment"))])
    df = df.withColumn(out, F.when((s == "") | c("err"), F.lit("")).otherwise(c("res")))
    return df.drop(*_part_names(t), f"{t}_s", f"{t}_host", f"{t}_p2", f"{t}_res")


def with_valid_url(df: DataFrame, src, out: str) -> DataFrame:
    """Scheme and authority both present (P-2); null/'' and parse errors -> false."""
    t = f"__{out}"
    df = with_url_parts(df, src, t)
    c = lambda n: F.col(f"{t}_{n}")
    df = df.withColumn(out, (F.coalesce(_col(src), F.lit("")) != "") & ~c("err")
                       & (c("scheme") != "") & (c("netloc") != ""))
    return _drop_parts(df, t)


def with_domain(df: DataFrame, src, out: str) -> DataFrame:
    """Lower-cased authority minus one leading ``www.`` (P-3); '' without one."""
    t = f"__{out}"
    df = with_url_parts(df, src, t)
    c = lambda n: F.col(f"{t}_{n}")
    df = df.withColumn(out, F.when(c("err"), F.lit(""))
                       .otherwise(F.regexp_replace(F.lower(c("netloc")), r"^www\.", "")))
    return _drop_parts(df, t)


def _resolve_path(bpath: Column, path: Column) -> Column:
    """RFC 3986 merge + dot-segment removal as the standard library does it.
    Both arguments must be plain column references."""
    base_parts = F.split(bpath, "/")
    base_parts = F.when(F.element_at(base_parts, -1) != "",
                        F.slice(base_parts, 1, F.size(base_parts) - 1)).otherwise(base_parts)
    merged = F.when(path.startswith("/"), F.split(path, "/")).otherwise(F.concat(base_parts, F.split(path, "/")))
    return merged


def _dot_segments(merged: Column) -> Column:
    n = F.size(merged)
    m = F.when(n >= 2, F.concat(F.slice(merged, 1, 1),
                                F.filter(F.slice(merged, 2, n - 2), lambda x: x != ""),
                                F.slice(merged, -1, 1))).otherwise(merged)
    return m


def with_url_join(df: DataFrame, base, href, out: str) -> DataFrame:
    """``urllib.parse.urljoin(base, href)`` (P-4). Adds ``{out}`` (the URL),
    ``{out}_netloc`` (authority of the result) and ``{out}_err`` (inputs the
    standard library rejects)."""
    t = f"__{out}"
    b, h = f"{t}b", f"{t}h"
    df = df.withColumns({f"{t}_base": F.coalesce(_col(base), F.lit("")),
                         f"{t}_href": F.coalesce(_col(href), F.lit(""))})
    df = with_url_parts(df, f"{t}_base", b)
    df = with_url_parts(df, f"{t}_href", h)
    B = lambda n: F.col(f"{b}_{n}")
    H = lambda n: F.col(f"{h}_{n}")
    tc = lambda n: F.col(f"{t}_{n}")
    hs = F.when(H("scheme") == "", B("scheme")).otherwise(H("scheme"))
    df = df.withColumns({f"{t}_hs": hs,
                         f"{t}_q": F.when(H("query") == "", B("query")).otherwise(H("query")),
                         f"{t}_merged": _resolve_path(B("path"), H("path"))})
    nets = tc("hs").isin(_USES_NETLOC)
    df = df.withColumns({
        f"{t}_foreign": (tc("hs") != B("scheme")) | ~tc("hs").isin(USES_RELATIVE),
        f"{t}_nets": nets,
        f"{t}_net": F.when(nets & (H("netloc") == ""), B("netloc")).otherwise(H("netloc")),
        f"{t}_merged2": _dot_segments(tc("merged"))})
    df = df.withColumn(f"{t}_res", F.aggregate(
        tc("merged2"), F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
                                .otherwise(acc))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg)))))
    rpath = F.array_join(F.when(F.element_at(tc("merged2"), -1).isin(".", ".."),
                                F.concat(tc("res"), F.array(F.lit("")))).otherwise(tc("res")), "/")
    df = df.withColumn(f"{t}_rpath2", F.when(rpath == "", F.lit("/")).otherwise(rpath))
    df = with_url_unparse(df, [
        (f"{t}_u1", tc("hs"), H("netloc"), H("path"), H("params"), H("query"), H("fragment")),
        (f"{t}_u2", tc("hs"), tc("net"), B("path"), B("params"), tc("q"), H("fragment")),
        (f"{t}_u3", tc("hs"), tc("net"), tc("rpath2"), H("params"), H("query"), H("fragment"))])
    base_c, href_c = tc("base"), tc("href")
    url = (F.when(base_c == "", href_c)
           .when(href_c == "", base_c)
           .when(tc("foreign"), href_c)
           .when(tc("nets") & (H("netloc") != ""), tc("u1"))
           .when((H("path") == "") & (H("params") == ""), tc("u2"))
           .otherwise(tc("u3")))
    out_net = (F.when(base_c == "", H("netloc"))
               .when(href_c == "", B("netloc"))
               .when(tc("foreign"), H("netloc"))
               .otherwise(tc("net")))
    df = df.withColumns({out: url, f"{out}_netloc": out_net,
                         f"{out}_err": (B("err") | H("err")) & (base_c != "") & (href_c != "")})
    return df.drop(*_part_names(b), *_part_names(h),
                   *[f"{t}_{n}" for n in ("base", "href", "hs", "foreign", "nets", "net", "merged", "merged2",
                                          "res", "rpath2", "q", "u1", "u2", "u3")])


# Patterns of a spreadsheet id inside a destination link, tried
# in this order.
SHEET_ID_PATTERNS = [r"/spreadsheets/d/([a-zA-Z0-9_-]+)", r"id=([a-zA-Z0-9_-]+)"]


def extract_sheet_id(c) -> Column:
    """First id found by ``SHEET_ID_PATTERNS`` anywhere in the text, else ''
    (P-5). ``#gid=0`` matches the second pattern and yields ``0``."""
    u = F.coalesce(_col(c), F.lit(""))
    hits = [F.nullif(F.regexp_extract(u, p, 1), F.lit("")) for p in SHEET_ID_PATTERNS]
    return F.coalesce(*hits, F.lit(""))


def sheet_url(sheet_id, default_id: str) -> Column:
    """Destination link for an id; an unset or '' id falls back to the default."""
    from sitelens.schemas import SHEET_URL_PREFIX
    return F.concat(F.lit(SHEET_URL_PREFIX),
                    F.coalesce(F.nullif(_col(sheet_id), F.lit("")), F.lit(default_id)))
