"""Random strings: parts and joins against the standard library, and what
normalisation must leave true."""

import random
from urllib.parse import urljoin, urlparse

from conftest import one_col
from sitelens.functions import urls as U

ALPHABET = list("abcxyzABC019") + list(":/?#[]@!$&'()*+,;=.-_~%") + [" ", "\t", "\n", "\u00a0", "\u3000",
                                                                    "é", "Ж", "www.", "http://", "https://",
                                                                    "//", "../", "./", ";"]


def _strings(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(0, 14))) for _ in range(n)]


def test_random_parts_match_stdlib(spark):
    vals = _strings(600, 11)
    for r in U.with_valid_url(U.with_url_parts(one_col(spark, vals), "v", "p"), "v", "ok").collect():
        try:
            want = urlparse(vals[r.i])
        except ValueError:
            assert r.p_err and not r.ok
            continue
        assert not r.p_err
        assert (r.p_scheme, r.p_netloc, r.p_path, r.p_params, r.p_query, r.p_fragment) == tuple(want), vals[r.i]
        assert r.ok == (want.scheme != "" and want.netloc != "")


def test_normalisation_invariants(spark):
    vals = _strings(600, 12)
    df = U.with_normalized_url(one_col(spark, vals), "v", "n")
    df = U.with_normalized_url(df, "n", "again")
    for r in U.with_url_parts(df, "n", "p").collect():
        if r.n == "":
            continue
        assert r.n.startswith("https:") and not r.p_err
        assert r.p_netloc == r.p_netloc.lower() and (r.p_path != "/" or r.p_params)
        # once more only strips what the first round brought to the front or the end
        if not r.p_netloc.startswith("www.") and r.n == r.n.strip() and r.n.startswith("https://"):
            assert r.again == r.n, vals[r.i]


def test_random_url_join(spark):
    rnd = random.Random(5)
    bases = ["https://h.com/a/b", "https://h.com", "https://h.com/a/b/", "https://h.com/a;p?q#f", "http://x.org/"]
    hrefs = _strings(400, 23)
    pairs = [(rnd.choice(bases), h) for h in hrefs]
    df = spark.createDataFrame(pairs, "b string, h string")
    for r in U.with_url_join(df, "b", "h", "j").collect():
        try:
            exp = urljoin(r.b, r.h)
        except ValueError:
            assert r.j_err, (r.b, r.h)
            continue
        assert not r.j_err and r.j == exp, (r.b, r.h, r.j, exp)
        assert r.j_netloc == urlparse(exp).netloc, (r.b, r.h)
