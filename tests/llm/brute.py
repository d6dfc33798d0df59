"""Brute-force versions of the scanning contracts, by regular expression."""

import hashlib
import re

PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
       ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
       ("card", r"[0-9]([\x20-]?[0-9])+"),
       ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
SECRETS = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
           ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")]


def luhn(s):
    d = [int(c) for c in s if c in "0123456789"]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0


def pii_ok(kind, s):
    digits = sum(c in "0123456789" for c in s)
    return {"email": lambda: True, "ip": lambda: all(int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in s.split(".")),
            "card": lambda: 13 <= digits <= 19 and luhn(s), "phone": lambda: 9 <= digits <= 15}[kind]()


def secret_ok(kind, m):
    return len(m[2]) >= 12 if kind == "assign" else len(m[0]) >= (18 if kind == "access" else 16)


def pii(text):
    return [(k, m.start(), m.end()) for k, r in PII for m in re.finditer(r, text or "") if pii_ok(k, m[0])]


def secrets(text):
    got = [(m.start(), i, m.end(), k) for i, (k, r) in enumerate(SECRETS) for m in re.finditer(r, text or "", re.ASCII)
           if secret_ok(k, m)]
    return [(k, s, e) for s, _, e, k in sorted(got)]


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest(spans):
    return hashlib.sha256(joined(spans).encode()).hexdigest()
