"""Importance resampling: scores and ranks against a plain version; the radix sort on hard keys."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from sitelens.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, buckets=10000, ngrams=(1, 1), least=20, percent=10):
    def found(text):
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        runs = [" ".join(words[i:i + n]) for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    s = Counter(b for _, t in docs for b in found(t)[1])
    t = Counter(b for x in target for b in found(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    rows = []
    for i, (doc, text) in enumerate(docs):
        n, f = found(text)
        w = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n, i])
    may = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[:percent * len(may) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize("block_rows, bits, ngrams", [(7, 3, (1, 1)), (1 << 15, 11, (1, 1)), (16, 16, (1, 3))])
def test_draw_against_plain(spark, block_rows, bits, ngrams):
    texts = [None, "", "-", "Éa É a \x00b", "a " * 25, "word " * 30000] + [
        " ".join(f"W{(i * j) % 17}x" for j in range(i % 40 + 5)) for i in range(60)]
    docs = [(i * 1000003 - 5, t) for i, t in enumerate(texts)] + [(None, "a b c " * 9), (7, "same " * 20), (7, "same " * 20)]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, rank int, block int, score int") \
        .repartition(3)
    target = spark.createDataFrame([("w1x W2x w3x",), (None,), ("",)], "text string")
    got = resample.resample(df, target, ngrams=ngrams, percent=50, block_rows=block_rows, digit_bits=bits).collect()
    assert Counter(tuple(r) for r in got) == plain(docs, ["w1x W2x w3x", None, ""], ngrams=ngrams, percent=50)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b " * 50)], none.schema)
    assert [r["rank"] for r in resample.resample(one, none, percent=100).collect()] == [1]


def test_radix_sort_of_hard_keys(spark):
    ends = [-(1 << 63), (1 << 63) - 1, 0, -1, 1, None]
    rows = [(i % 5 << 40 | i // 25, i // 5 % 5, ends[i % 6], ends[i * 7 % 5] if i % 3 else 4, i) for i in range(120)]
    df = spark.createDataFrame(rows, "block long, pos long, doc_id long, score long, row long")
    got = {r.row: r["rank"] for r in resample.radix_ranked(df, block_rows=9, digit_bits=13).collect()}
    want = sorted(rows, key=lambda r: (-r[3], r[2] is None, r[2] or 0, r[0], r[1]))
    assert got == {r[4]: k + 1 for k, r in enumerate(want)}


def test_one_score_for_all(spark):
    rows = [(i // 50, i % 50, 3, 9) for i in range(400)]
    df = spark.createDataFrame(rows, "block long, pos long, doc_id long, score long")
    assert sorted(r["rank"] for r in resample.radix_ranked(df, block_rows=50).collect()) == list(range(1, 401))
