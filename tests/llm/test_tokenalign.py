"""Token alignment against a plain version with the two libraries' own readers; bitmaps round trip."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_SMALL
from sitelens.llm import queries, tokenalign

HARD = [None, "", " ", "a", " a", "a ", "  a  b ", "\n a\tb\r\n", "x  y", "tabs\t and \x1c blanks", "Привет, мир! €5",
        "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "▁", "日本語のテキスト 日本", "👩‍👩‍👧 🎉🎉", "ﬁ ① ½", "é é",
        "=" * 700, "ab" * 900, "don't DON'T we'll", "1234567 890", "\x00\x01", "  " * 50 + "x", "word " * 3000,
        "　 wide   em", "a\u0085 b", "﻿bom", "q" * 3000]


@pytest.fixture(scope="module")
def readers():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(queries.tokenizer_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(queries.OTHER_TOKENIZER))
    visible = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    others = [c for c in range(256) if c not in visible]
    decode = {chr(c): c for c in visible} | {chr(256 + i): c for i, c in enumerate(others)}
    return a, b, decode


def plain(docs, readers):
    a, b, decode = readers
    per, counts = [], Counter()
    for doc, text in docs:
        groups = []
        if text:
            raw = b" " + text.encode()
            ea = a.encode(" " + text, add_special_tokens=False)
            sa = [bytes(decode[c] for c in t) for t in ea.tokens]
            ib = b.encode(text)
            sb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
            if b"".join(sa) == raw and b"".join(sb) == raw:
                i = j = x = y = 0
                ga, gb = [], []
                while i < len(sa) or j < len(sb):
                    if x <= y:
                        x += len(sa[i])
                        ga.append(ea.ids[i])
                        i += 1
                    else:
                        y += len(sb[j])
                        gb.append(ib[j])
                        j += 1
                    if x == y:
                        groups.append((ga, gb))
                        ga, gb = [], []
        links = Counter((p, q) for ga, gb in groups for p in ga for q in gb)
        counts.update(links.keys())
        per.append((doc, groups, links))
    best = defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    rows = []
    for doc, groups, links in per:
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        rows.append((doc, sum(len(g) for g, _ in groups), sum(len(g) for _, g in groups), len(groups), sum(links.values()),
                     sum(n for k, n in links.items() if counts[k] == best[k[0]]), sum(n * counts[k] for k, n in links.items()),
                     hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
    return Counter(rows)


def test_query_against_plain(spark, readers):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_token_alignment(spark, SF_SMALL)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain(docs, readers)


def test_hard_texts_repeats_and_small_containers(spark, readers, monkeypatch):
    docs = list(enumerate(HARD)) + [(None, "a b"), (3, "word up"), (3, "word up")]
    df = spark.createDataFrame([(*d, "c", 1) for d in docs], "doc_id long, text string, groups string, pair int").repartition(3)
    args = queries.tokenizer_path(), queries.tokenizer_path(queries.OTHER_TOKENIZER)
    got = tokenalign.alignment_report(df, *args, with_groups=True).collect()
    assert Counter(tuple(r)[:8] for r in got) == plain(docs, readers)
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in got)
    assert tokenalign.alignment_report(df.where("false"), *args).count() == 0


def test_cuts_change_nothing():
    """Pieces in a small cache, whole texts, wide groups by distinct ids: the same links."""
    args = queries.tokenizer_path(), queries.tokenizer_path(queries.OTHER_TOKENIZER)
    texts = HARD + ["the quick brown fox " * 40]
    whole = tokenalign.Aligner(*args)
    assert whole.cuts
    whole.cuts = False
    want = whole.align(texts)
    limits = tokenalign.CACHED_PIECES, tokenalign.OUTER
    try:
        tokenalign.CACHED_PIECES, tokenalign.OUTER = 5, 1
        cut = tokenalign.Aligner(*args)
        for part in ([texts[:7], texts[7:]], [texts]):
            got = [cut.align(p) for p in part]
            assert [s for g in got for s in g[0]] == want[0]
            assert np.array_equal(np.concatenate([g[1] for g in got], axis=1), want[1])
        assert all(np.array_equal(x, y) for x, y in zip(got[0][2], want[2]))
    finally:
        tokenalign.CACHED_PIECES, tokenalign.OUTER = limits


@pytest.mark.parametrize("slots", [1, 9, 64, 5000])
def test_bitmaps_round_trip(slots):
    r = np.random.default_rng(slots)
    cells = {(int(p), int(s)): int(m) for p, s, m in zip(r.integers(0, 6, 3 * slots) ** 3, r.integers(0, slots, 3 * slots),
                                                       r.integers(1, 70, 3 * slots))}
    keys = sorted(cells)
    pair, slot = (np.array(c, np.int64) for c in zip(*keys))
    pairs, n_docs, planes = tokenalign.bitmaps(pair, slot, np.array([cells[k] for k in keys]), slots)
    assert dict(zip(pairs.tolist(), n_docs.tolist())) == Counter(p for p, _ in keys)
    score = r.integers(1, 1000, len(pairs))
    total = tokenalign.add_scores(pa.concat_arrays([planes]), [score, score * 0 + 1], slots)
    of = dict(zip(pairs.tolist(), score.tolist()))
    for s in range(slots):
        assert total[0][s] == sum(m * of[p] for (p, q), m in cells.items() if q == s)
        assert total[1][s] == sum(m for (p, q), m in cells.items() if q == s)
