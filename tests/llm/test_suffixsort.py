"""Two-stage suffix sorting against sorted()."""

import random

import numpy as np
import pytest
from sitelens.llm import suffixsort
from sitelens.llm.suffixsort import Suffixes, repeated_starts

TEXTS = [[b"banana"], [b"a" * 30, b"a" * 12, b"a" * 12], [b"\0\0\1", b"\0", b"\0\0"], [b"mississippi", b"issip", b"ssi"],
         [b"abcdefg", b"abcdefgh", b"abcdefg"], [b"ab" * 20, b"ba" * 20], [b"\xff\xff", b"\xff"], [b"x"], [b"", b"a", b""]]
R = random.Random(5)
TEXTS += [[bytes(R.choice(alphabet) for _ in range(R.randint(0, 60))) for _ in range(R.randint(1, 30))]
          for alphabet in (b"ab", b"\0\xff", bytes(range(256)), b"aab") for _ in range(12)]


@pytest.mark.parametrize("strings", TEXTS)
def test_order_and_prefixes(strings):
    s = Suffixes(strings)
    rows = [(t[i:], n, a + i) for n, (t, a) in enumerate(zip(strings, s.starts.tolist())) for i in range(len(t) + 1)]
    rows.sort(key=lambda r: (r[0], r[1]))
    order = s.order().tolist()
    text = {p: t for t, _, p in rows}
    assert [text[p] for p in order] == [t for t, _, _ in rows] and sorted(order) == sorted(text)
    shared = s.common_prefixes(s.order(), 20)
    for k in range(1, len(order)):
        x, y = text[order[k - 1]], text[order[k]]
        n = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
        assert shared[k] == min(n, 20)


def test_repeated_starts():
    r = random.Random(2)
    core = bytes(r.choice(b"abc") for _ in range(90))
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 5))) + core[r.randint(0, 9):] + b"q" * r.randint(0, 3) for _ in range(40)]
    starts = [max(1, len(s) - 29) for s in strings]
    got = repeated_starts(strings, starts, 30)
    seen = {}
    for n, (s, k) in enumerate(zip(strings, starts)):
        for i in range(k):
            seen.setdefault(s[i:i + 30], []).append((n, i))
    for n, flags in enumerate(got):
        assert [bool(f) for f in flags] == [len(seen[strings[n][i:i + 30]]) > 1 for i in range(starts[n])]


@pytest.mark.parametrize("strings", TEXTS)
@pytest.mark.parametrize("share", [0.1, 0.7])
def test_order_of_wanted(strings, share):
    s = Suffixes(strings)
    r = random.Random(len(strings))
    wanted = np.array([r.random() < share for _ in s.codes], bool)
    full = s.order()
    assert s.order(wanted).tolist() == full[wanted[full]].tolist()
    text = {a + i: t[i:] for t, a in zip(strings, s.starts.tolist()) for i in range(len(t) + 1)}
    for at_most in (1, 7, 8, 20):
        got = s.order(wanted, at_most).tolist()
        assert sorted(got) == np.flatnonzero(wanted).tolist()
        heads = [text[p][:at_most] for p in got]
        assert heads == sorted(heads)
        long = np.array([p for p in got if len(text[p]) >= at_most], np.int64)
        agree = s.agree(long, at_most).tolist()
        assert agree == [k > 0 and text[long[k - 1]][:at_most] == text[p][:at_most] for k, p in enumerate(long.tolist())]


def test_tails_are_not_sorted(monkeypatch):
    """A stretch's last run reaches far beyond its last start: only starts are sorted, and what they follow from."""
    r = random.Random(3)
    strings = [bytes(r.choice(b"abcd") for _ in range(300)) for _ in range(50)]
    sizes, sort = [], Suffixes.sort_directly

    def seen(self, suffixes, *rest):
        sizes.append(len(suffixes))
        return sort(self, suffixes, *rest)

    monkeypatch.setattr(Suffixes, "sort_directly", seen)
    assert not np.concatenate(repeated_starts(strings, [20] * 50, 200)).any()
    assert 0 < sum(sizes) <= 50 * 21


def test_equal_suffixes_are_not_sorted_again(monkeypatch):
    """Suffixes that stay equal to their neighbours word after word are left where they are."""
    r = random.Random(4)
    core = bytes(r.choice(b"abcdefgh") for _ in range(300))
    strings = [core + b"%04d" % n for n in range(40)]
    rows, sort = [], np.lexsort

    def seen(keys):
        rows.append(len(keys[0]))
        return sort(keys)

    monkeypatch.setattr(suffixsort.np, "lexsort", seen)
    assert np.concatenate(repeated_starts(strings, [101] * 40, 200)).all()
    assert sum(rows) <= 40 * 101
