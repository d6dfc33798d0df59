"""Text column functions: whitespace parity, cleaning, navigation noise.

Python's ``str.strip``/``str.split``/``\\s`` treat 29 characters as
whitespace; Java's ``\\s`` and Spark's ``trim`` do not. Every function here
uses the explicit class ``WS`` so that results equal the Python semantics.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters Python's str.isspace() accepts.
WS = (r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# Same set without the brackets, for use inside another character class.
WS_CHARS = WS[1:-1]
# Python's \w for str patterns: letters, numbers and underscore.
WORD = r"[\p{L}\p{N}_]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace."""
    return F.regexp_replace(_col(c), f"^{WS}+|{WS}+$", "")


def collapse_ws(c) -> Column:
    """Every whitespace run to one space (``re.sub(r'\\s+', ' ', s)``)."""
    return F.regexp_replace(_col(c), f"{WS}+", " ")


def split_ws(c) -> Column:
    """Python ``str.split()``: the non-empty pieces between whitespace runs
    (leading/trailing whitespace yields no empty word; '' -> [])."""
    return F.array_remove(F.split(_col(c), f"{WS}+"), "")


# Characters kept by the text cleaner besides letters, digits,
# underscore and whitespace.
CLEAN_TEXT_EXTRA = r"\-.,!?@#$%&*()+=<>:;/\\|{}\[\]~`"


def clean_text(c) -> Column:
    """Null/empty -> ''; strip; collapse whitespace; then delete every
    character outside ``[\\w\\s<CLEAN_TEXT_EXTRA>]``. Deleting last can leave
    double or edge spaces, as the original does."""
    x = F.coalesce(_col(c), F.lit(""))
    x = collapse_ws(strip_ws(x))
    return F.regexp_replace(x, rf"[^\p{{L}}\p{{N}}_{WS_CHARS}{CLEAN_TEXT_EXTRA}]", "")


# Navigation noise patterns, applied case-insensitively in this
# order. Written with \s, . and \d as in the original; translated below.
NAV_NOISE_PATTERNS = [
    r"главная\s+о\s+нас\s+услуги\s+контакты",
    r"home\s+about\s+services\s+contact",
    r"меню\s+\|",
    r"©\s*\d{4}.*?права защищены",
    r"cookie.*?согласие",
    r"политика конфиденциальности",
    r"пользовательское соглашение",
]


def python_pattern_to_java(p: str) -> str:
    """Translate the Python classes used by ``NAV_NOISE_PATTERNS`` to
    explicit classes: ``\\s`` -> WS, ``\\d`` -> ``\\p{Nd}``, ``.`` -> ``[^\\n]``."""
    out, i = [], 0
    while i < len(p):
        ch = p[i]
        if ch == "\\" and i + 1 < len(p):
            nxt = p[i + 1]
            out.append(WS if nxt == "s" else r"\p{Nd}" if nxt == "d" else p[i:i + 2])
            i += 2
            continue
        out.append(r"[^\n]" if ch == "." else ch)
        i += 1
    return "".join(out)


NAV_NOISE_JAVA = [python_pattern_to_java(p) for p in NAV_NOISE_PATTERNS]


def remove_nav_patterns(c) -> Column:
    """Step 1 of navigation-noise removal: delete each pattern (Unicode
    case-insensitive; ``.`` does not cross a newline)."""
    x = _col(c)
    for p in NAV_NOISE_JAVA:
        x = F.regexp_replace(x, "(?iu)" + p, "")
    return x
