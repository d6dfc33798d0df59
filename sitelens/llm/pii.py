"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, schemes
and account cues) in one pass; a deterministic local parser expands
each anchor to its boundaries and validates it. No regular expression runs over
the text.

Base kinds: email, ip, card, phone. Added kinds: login (user and password in a
URL) and iban (country cue, mod-97 check).

Defined results: null text: empty, no spans. Spans are code points, end
exclusive, leftmost and non-overlapping within a kind. Very long texts are
parsed whole; each parser is linear in the text. Repeated rows and null ids
keep one output row each. Only id and text are read, so other columns cannot
clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import batches_of

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("login", "iban")
BATCH_ROWS = 1024

DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
SCHEME = ALNUM | frozenset("+.-")
# Country codes and lengths of the public IBAN registry, as cues.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31,
    "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20, "YE": 30}

_AUTOMATON = None


def automaton():
    """Built once per worker: single characters and cues with their anchor kind."""
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick
        a = ahocorasick.Automaton()
        for c in "0123456789":
            a.add_word(c, "digit")
        a.add_word("@", "at")
        a.add_word("+", "plus")
        a.add_word("://", "scheme")
        for c in IBAN_LENGTHS:
            for d in "0123456789":
                a.add_word(c + d, "iban")
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def _run(text: str, i: int, allowed: frozenset) -> int:
    """End of the run of allowed characters that starts at i."""
    n = len(text)
    while i < n and text[i] in allowed:
        i += 1
    return i


def _run_back(text: str, i: int, allowed: frozenset, floor: int) -> int:
    """Start of the run of allowed characters that ends before i."""
    while i > floor and text[i - 1] in allowed:
        i -= 1
    return i


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = _run_back(text, at, LOCAL, floor)
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    last = None
    while end < len(text) and text[end] == ".":
        more = _run(text, end + 1, LABEL)
        if more == end + 1:
            break
        end = last = more
    return (start, last) if last else None


def ip_at(text: str, start: int, end: int) -> tuple[int, bool] | None:
    """A digit run start:end as the first of four parts: end and validity."""
    parts = [text[start:end]]
    while len(parts) < 4:
        more = _run(text, end + 1, DIGITS)
        if end >= len(text) or text[end] != "." or more == end + 1:
            return None
        parts.append(text[end + 1:more])
        end = more
    small = (p.lstrip("0") for p in parts)
    return end, all(len(p) <= 3 and int(p or 0) <= 255 for p in small)


def card_at(text: str, start: int, end: int) -> tuple[int, bool]:
    """A digit run start:end and the runs joined to it by one blank or hyphen."""
    runs = [text[start:end]]
    while end + 1 < len(text) and text[end] in " -" and text[end + 1] in DIGITS:
        more = _run(text, end + 1, DIGITS)
        runs.append(text[end + 1:more])
        end = more
    size = sum(map(len, runs))
    if not 13 <= size <= 19:
        return end, False
    total = 0
    for k, c in enumerate(reversed("".join(runs))):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return end, total % 10 == 0


def phone_at(text: str, plus: int) -> tuple[int, bool] | None:
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None
    end = _run(text, plus + 2, PHONE)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= plus + 3 or text[end - 1] not in DIGITS:
        return None
    return end, 9 <= sum(c in DIGITS for c in text[plus:end]) <= 15


def login_at(text: str, colon: int, floor: int) -> tuple[int, int] | None:
    """scheme://user:password@host from the colon of ``://``."""
    start = _run_back(text, colon, SCHEME, floor)
    user = _run(text, colon + 3, LOCAL)
    if start == colon or user == colon + 3 or user >= len(text) or text[user] != ":":
        return None
    end = user + 1
    while end < len(text) and not text[end].isspace() and text[end] not in "@/?#":
        end += 1
    if end == user + 1 or end >= len(text) or text[end] != "@":
        return None
    host = _run(text, end + 1, LABEL | {"."})
    return (start, host) if host > end + 1 else None


def iban_at(text: str, start: int) -> int | None:
    """Country code at start; blanks between groups are allowed, mod 97 must be 1."""
    if start and text[start - 1] in ALNUM:
        return None
    size, got, i = IBAN_LENGTHS[text[start:start + 2]], [], start
    while i < len(text) and len(got) < size:
        if text[i] in ALNUM and not text[i].islower():
            got.append(text[i])
        elif text[i] != " " or text[i - 1] == " ":
            return None
        i += 1
    if len(got) < size or (i < len(text) and text[i] in ALNUM):
        return None
    moved = "".join(str(int(c, 36)) for c in got[4:] + got[:4])
    return i if int(moved) % 97 == 1 else None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans as (kind, start, end), by kind as listed, then start."""
    found: dict[str, list] = {k: [] for k in BASE_KINDS + ADDED_KINDS}
    past = dict.fromkeys(BASE_KINDS + ADDED_KINDS, 0)
    run_end = 0
    for last, anchor in automaton().iter(text):
        if anchor == "digit":
            if last < run_end:  # inside a run that was parsed already
                continue
            run_end = _run(text, last, DIGITS)
            for kind, parse in (("ip", ip_at), ("card", card_at)):
                # what an earlier match of this kind has used is gone
                start = max(last, past[kind])
                if start >= run_end:
                    continue
                if kind == "card" and run_end - start < 2 and not text[run_end:run_end + 1] in (" ", "-"):
                    continue
                got = parse(text, start, run_end)
                if got:
                    if got[0] - start >= 2:
                        past[kind] = got[0]
                    if got[1]:
                        found[kind].append((kind, start, got[0]))
        elif anchor == "at":
            if last >= past["email"] and (got := email_at(text, last, past["email"])):
                past["email"] = got[1]
                found["email"].append(("email", *got))
        elif anchor == "plus":
            if last >= past["phone"] and (got := phone_at(text, last)):
                past["phone"] = got[0]
                if got[1]:
                    found["phone"].append(("phone", last, got[0]))
        elif anchor == "scheme":
            if last - 2 >= past["login"] and (got := login_at(text, last - 2, past["login"])):
                past["login"] = got[1]
                found["login"].append(("login", *got))
        elif last - 2 >= past["iban"] and (end := iban_at(text, last - 2)):
            past["iban"] = end
            found["iban"].append(("iban", last - 2, end))
    return [s for k in BASE_KINDS + ADDED_KINDS for s in found[k]]


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _report(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches_of(BATCH_ROWS, it):
        cols: list[list] = [[] for _ in range(7)]
        for text in b.column(1).to_pylist():
            spans = find_spans(text or "")
            base = [s for s in spans if s[0] in BASE_KINDS]
            row = [*(sum(s[0] == k for s in base) for k in BASE_KINDS),
                   hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans),
                   [{"kind": k, "start": s, "end": e} for k, s, e in spans]]
            for c, v in zip(cols, row):
                c.append(v)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.list_(pa.struct(
            [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))],
            ["id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "found"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of the base kinds, the digest of the base spans, all spans as
    text and as an array ``found`` of (kind, start, end). Row-local: no shuffle."""
    schema = ("id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
              "found array<struct<kind:string,start:bigint,end:bigint>>")
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_report, schema)
    return out.withColumnRenamed("id", id_col)
