"""Repeated runs against a table of all runs, and anchors against their definition."""

import hashlib
import random
from collections import Counter

import pytest
from conftest import SF_CHECK, SF_SMALL
from sitelens.llm import queries, repeats


def plain(docs, length):
    raws = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(hash(r[a:a + length]) if length > 64 else r[a:a + length] for _, r in raws for a in range(len(r) - length + 1))
    rows = []
    for i, r in raws:
        gone = bytearray(len(r))
        for a in range(len(r) - length + 1):
            if seen[hash(r[a:a + length]) if length > 64 else r[a:a + length]] > 1:
                gone[a:a + length] = b"\1" * length
        kept = bytes(c for c, g in zip(r, gone) if not g)
        runs = sum(1 for n, g in enumerate(gone) if g and (n == 0 or not gone[n - 1]))
        rows.append((i, len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(rows)


@pytest.mark.parametrize("sf", [SF_SMALL, SF_CHECK])
def test_query_against_plain(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_repeats(spark, sf)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain(docs, 200)


def hard():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 7)))
    passage = " ".join(word() for _ in range(40))
    texts = [None, "", "x", "a" * 500, "ab" * 90, passage, passage, passage[:30], passage[3:33]]
    for n in range(120):
        inner = passage if n % 3 else passage[r.randint(0, 60):r.randint(90, 160)]
        texts.append(" ".join(word() for _ in range(r.randint(0, 20))) + inner + " ".join(word() for _ in range(r.randint(0, 20))))
    texts.append(passage + word() + passage)
    return [(i, t) for i, t in enumerate(texts)] + [(None, "null id " + passage), (5, passage), (5, passage)]


@pytest.mark.parametrize("most", [1, 10, 2048])
def test_hard_texts(spark, most, monkeypatch):
    """Rims of a common passage, sorted or counted; texts in slices."""
    monkeypatch.setattr(repeats, "BLOCKS", (5, 1))
    docs = hard()
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, digest int, key string").repartition(4)
    got = repeats.without_repeats(df, length=30, gram=8, most=most, with_bytes=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == plain(docs, 30)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert repeats.without_repeats(df.where("false"), length=30, gram=8).count() == 0


def test_pieces_are_dealt_from_tables(spark, monkeypatch):
    """No join may lie below the dealing by anchor: Spark would take the join's shuffle for
    it, and read that shuffle in other parts once the join runs as a broadcast."""
    plans, deal = [], repeats._sorted_marks

    def seen(pieces, length):
        plans.append(pieces._jdf.queryExecution().optimizedPlan().toString())
        return deal(pieces, length)

    monkeypatch.setattr(repeats, "_sorted_marks", seen)
    docs = [(i, t) for i, t in hard() if t and len(t) > 60][:40]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = repeats.without_repeats(df, length=30, gram=8, most=10).collect()
    assert Counter(tuple(r) for r in got) == plain(docs, 30)
    assert len(plans) > 1 and not [p for p in plans if "Join" in p]


def test_stretches_of_sliced_texts(monkeypatch):
    """Every start lies in one stretch, and equal runs have equal anchors at equal places."""
    raws = [(t or "").encode() for _, t in hard()]
    anchor = {}
    of, first, count, found, lead = repeats.anchored(raws, 30, 8)
    held = Counter()
    for n, a, k, x, p in zip(of.tolist(), first.tolist(), count.tolist(), found.tolist(), lead.tolist()):
        for s in range(a, a + k):
            held[n, s] += 1
            assert anchor.setdefault(raws[n][s:s + 30], (x, a + p - s)) == (x, a + p - s)
    assert held == Counter((n, s) for n, t in enumerate(raws) for s in range(len(t) - 29))
