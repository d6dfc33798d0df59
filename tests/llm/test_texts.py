"""Language, decontamination and fingerprints."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF_CHECK
from sitelens.llm import decontam, langid, minhash, queries


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}


def path_value(s, path, penalty):
    return sum(s[i, x] for i, x in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("block", [2, 3, 256])
def test_viterbi_finds_the_best_path(block, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = np.random.default_rng(block)
    for _ in range(20):
        items = [rng.normal(size=(int(rng.integers(1, 8)), 3)) * 2 for _ in range(4)]
        for s, path in zip(items, langid.viterbi(items, 1.5)):
            best = max(path_value(s, p, 1.5) for p in itertools.product(range(3), repeat=len(s)))
            assert path_value(s, path, 1.5) == pytest.approx(best)


def test_language_held_out_accuracy(spark, docs):
    rows = queries.op6_language(spark, SF_CHECK).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in out]) > 0.97


def test_language_spans_scripts_and_edges(spark):
    en, ru = "the house and the garden of the king with the children", "дом и сад короля и дети его там где они были"
    rows = [(i, en, "en", 1) for i in range(0, 40)] + [(i, ru, "ru", 1) for i in range(40, 80)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.train(train)
    assert model.langs == ["en", "ru"]
    texts = [None, "", "12 34 !!", en, ru, en + ". " + ru, (en + " ") * 900, "λόγος", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert [got[i].lang_pred for i in range(7)] == ["und", "und", "und", "en", "ru", "en", "en"]
    assert got[0].score == 0 and got[0].spans == [] and got[7].lang_pred in model.langs
    assert [(s["lang"], texts[5][s["start"]:s["end"]]) for s in got[5].spans] == [("en", en + ". "), ("ru", ru)]
    assert langid.train(train.where("false")).langs == []
    assert {r.lang_pred for r in langid.identify(df, langid.train(train.where("false"))).collect()} == {"und"}
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {3, 4, 6}
    assert not {r.doc_id for r in kept.collect()} & {0, 1, 2}


def plain_path(s, penalty):
    """Best path of labels, word by word."""
    value, back = s[0].copy(), []
    for x in s[1:]:
        other = value.max() - penalty
        back.append([j if value[j] >= other else int(value.argmax()) for j in range(len(value))])
        value = np.maximum(value, other) + x
    path = [int(value.argmax())]
    for came in reversed(back):
        path.append(came[path[-1]])
    return np.array(path[::-1])


def test_language_stage_keeps_the_rows_of_a_plain_loop(spark, docs):
    import corpus_pipeline as P
    rows = [(i, r.text, r.lang) for i, r in docs.items()][:400]
    texts = [t for _, t, _ in rows]
    mixed = [" ".join(w for t in texts[i:i + 4] for w in t.split()[:9]) for i in range(0, 80, 4)]
    rows += [(10 ** 6 + i, t, None) for i, t in enumerate([None, "", "12 34 !!", *mixed])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, want = langid.train(df), set()
    for i, text, _ in rows:
        words = langid.words_of(text or "")
        if words:
            s = model.score(words)
            path = plain_path(s, langid.SWITCH)
            letters = [sum(len(w) for w, x in zip(words, path) if x == j) for j in range(len(model.langs))]
            top = max(range(len(letters)), key=lambda j: (letters[j], -j))
            total = s[path == top].sum(axis=0)
            sure = min(1, 1 / np.exp(np.clip(total - total[top], -700, 50)).sum())
            if letters[top] / sum(letters) * sure >= 0.5:
                want.add(i)
    got = [r.doc_id for r in P.language_id(spark, df, SF_CHECK).collect()]
    assert sorted(got) == sorted(want) and 0 < len(want) < len(rows) - 3


def test_language_stage_without_labels_keeps_texts_with_letters(spark):
    import corpus_pipeline as P
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    for ids, lang in (((1, 2, 3, 4), None), ((held,) * 4, "en")):
        rows = list(zip(ids, ["the house and the garden", "дом и сад", "12 34 !!", None], [lang] * 4))
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        kept = P.language_id(spark, df, SF_CHECK)
        assert kept.columns == df.columns
        assert sorted(r.text for r in kept.collect()) == ["the house and the garden", "дом и сад"]


def plain_edits(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_alignment():
    r = random.Random(1)
    for _ in range(400):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(*b))) for b in ((1, 9), (0, 14)))
        want = plain_edits(p, t)
        assert decontam.within(p, t, 3) == (want if want <= 3 else None)


def test_edited_passages_are_found_and_clean_texts_are_not():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    items = [" ".join(word() for _ in range(r.randint(12, 60))) for _ in range(40)]
    index = decontam.Index.of(items)
    for _ in range(150):
        p = r.choice(index.passages)[2]
        x = list(p)
        for _ in range(int(len(p) * decontam.EDIT_RATE)):
            j = r.randrange(len(x))
            x[j:j + r.randint(0, 1)] = r.choice(["", r.choice("abcdef "), r.choice("xyz")])
        clean = " ".join(word() for _ in range(300))
        got = decontam.matches_in(["", clean, clean[:500] + "".join(x) + clean[500:], ""], index)
        assert not got[0] and not got[1] and got[2] and not got[3]


def aligned_passages(item, text):
    """(passages within their edits, least edits) by plain alignment of every passage, or None."""
    n = min(len(item), 100)
    got = [plain_edits(item[s:s + n], text) for s in range(len(item) - n + 1)]
    got = [e for e in got if e <= int(n * 0.08)]
    return (len(got), min(got)) if got else None


@pytest.mark.parametrize("dense, pairs", [(32, 1 << 21), (1, 40)])
def test_excerpts_at_every_offset_against_plain_alignment(monkeypatch, dense, pairs):
    monkeypatch.setattr(decontam, "SCAN_CHARS", 400)
    monkeypatch.setattr(decontam, "DENSE", dense)
    monkeypatch.setattr(decontam, "PAIRS", pairs)
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    items = [" ".join(word() for _ in range(40))[:130], " ".join(word() for _ in range(20))[:70], "ab cd " * 20]
    index = decontam.Index.of(items)
    texts, always = [], []
    for run, step in ((88, 6), (92, 1), (96, 6)):
        for at in range(0, len(items[0]) - run + 1, step):
            texts.append("".join(r.choice("qrstuvwxyz ") for _ in range(20)) + items[0][at:at + run]
                         + "".join(r.choice("qrstuvwxyz ") for _ in range(20)))
            always.append(run >= 92)
    for _ in range(12):
        x = list(r.choice(items))
        for _ in range(r.randint(0, 9)):
            j = r.randrange(len(x))
            x[j:j + r.randint(0, 1)] = r.choice(["", r.choice("abcdef "), r.choice("xyz")])
        texts.append("".join(x))
        always.append(False)
    got = decontam.matches_in(texts, index)
    for text, found, sure in zip(texts, got, always):
        want = {i: w for i, w in ((i, aligned_passages(item, text)) for i, item in enumerate(items)) if w}
        assert found == want and (0 in want or not sure)


def test_long_text_is_scanned_whole(monkeypatch):
    monkeypatch.setattr(decontam, "SCAN_CHARS", 1000)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    item = " ".join(word() for _ in range(40))
    index = decontam.Index.of([item])
    filler = " ".join(word() for _ in range(3000))
    for at in (0, 950, 1000, 1960, len(filler)):
        assert decontam.matches_in([filler[:at] + " " + item + " " + filler[at:]], index)[0][0] == (len(index.passages), 0)


def test_repetitive_text_takes_bounded_memory():
    """Every place of such a text meets every posting of such an item: 480 million pairs."""
    import tracemalloc
    index = decontam.Index.of([decontam.normalised("0 " * 3000), decontam.normalised("0 1 " * 40)])
    text = decontam.normalised("0 " * 80000)
    tracemalloc.start()
    try:
        assert decontam.matches_in([text, "0 1 " * 60], index) == [{0: (5900, 0)}, {1: (60, 0)}]
        assert tracemalloc.get_traced_memory()[1] < 300 << 20
    finally:
        tracemalloc.stop()


def test_contamination_of_the_table(spark, docs):
    items = {r.item_id: decontam.normalised(r.text) for r in spark.read.parquet(f"{SF_CHECK}/benchmark.parquet").collect()}
    want = {(i, k) for i, d in docs.items() for k, t in items.items() if t in decontam.normalised(d.text)}
    got = {(r.doc_id, r.item_id): r for r in queries.op4_contamination(spark, SF_CHECK).collect()}
    assert want and want <= set(got) and len(got) <= 1.2 * len(want)
    assert all(got[x].edits == 0 for x in want)


def test_contamination_edges(spark):
    bench = spark.createDataFrame([(1, "short words here"), (2, None), (3, "")], "item_id long, text string")
    df = spark.createDataFrame([(None, "so: SHORT, words here!"), (5, "shorter words here"), (6, None), (6, None)],
                               "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.find_contamination(df, bench).collect()] == [(None, 1)]
    kept = decontam.without_contamination(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [5, 6, 6]
    assert decontam.find_contamination(df, bench.where("false")).count() == 0
    assert decontam.without_contamination(df.where("false"), bench).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 30])
def test_equal_benchmark_items_are_all_reported(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", block)
    long = "a longer item of the benchmark that holds well over forty characters"
    texts = ["Short words!", "short words", "short words", long, long.upper()]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    df = spark.createDataFrame([(1, f"so: short words, {long}."), (2, "shorter words")], "doc_id long, text string")
    got = decontam.find_contamination(df, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in got) == [(1, i, 0) for i in range(5)]


def plain_fingerprint(text, k, hashes, tuple_size):
    """Order MinHash with plain loops over the k-mers."""
    if not text:
        return [0] * hashes
    k = min(k, len(text))
    kmers = minhash._kmers(text, k)
    seen, keys = {}, []
    for x in kmers.tolist():
        seen[x] = seen.get(x, -1) + 1
        keys.append(int(minhash._mix(np.array([x], np.uint64) + np.array([seen[x]], np.uint64) * minhash._BASE)[0]) >> 32)
    out = []
    for f in minhash._FACTORS[:hashes].tolist():
        order = sorted(range(len(keys)), key=lambda i: (keys[i] * f % (1 << 32), i))[:tuple_size]
        entry = np.array([min(tuple_size, len(keys))], np.uint64)
        for i in sorted(order):
            entry = minhash._mix(entry * minhash._BASE + kmers[i])
        out.append(int(entry[0]) >> 32)
    return out


def test_fingerprint_against_plain_loops(monkeypatch):
    r = random.Random(6)
    for block in (7, 1 << 13):
        monkeypatch.setattr(minhash, "BLOCK", block)
        for n in (0, 1, 3, 6, 7, 20, 200):
            text = "".join(r.choice("ab\U0001f600") for _ in range(n))
            assert minhash.fingerprint(text, 6, 8, 2).tolist() == plain_fingerprint(text, 6, 8, 2)


def test_order_counts():
    r = random.Random(8)
    parts = ["".join(r.choice("abcdefgh") for _ in range(30)) for _ in range(20)]
    a, b = "".join(parts), "".join(parts[10:] + parts[:10])
    whole, moved = minhash.fingerprint(a), minhash.fingerprint(b)
    assert minhash.likeness(whole, whole) == 1 and minhash.likeness(whole, moved) < 0.8
    assert minhash.likeness(whole, minhash.fingerprint(a[:300] + "x" + a[300:])) > 0.8


def held_to_order(rows, docs):
    order = sorted(docs, key=lambda i: -i)
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for i, nxt in zip(order, order[1:] + order[:1]):
        own, other = docs[i] or "", docs[nxt] or ""
        cut = len(own) // 2
        edited = own[:len(own) - cut] + other[:cut]
        assert got[i].n_chars == len(own) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        marks = [minhash.fingerprint(x) for x in (own, edited, other)]
        assert got[i].fingerprint == minhash.printed(marks[0]) and got[i].edited_fingerprint == minhash.printed(marks[1])
        assert got[i].near_edited == minhash.likeness(*marks[:2]) and got[i].near_next == minhash.likeness(marks[0], marks[2])


def test_neighbours_of_the_table(spark, docs):
    rows = queries.op8_order_minhash(spark, SF_CHECK).collect()
    held_to_order(rows, {i: d.text for i, d in docs.items()})
    assert np.mean([r.near_edited > r.near_next for r in rows if r.n_chars > 200]) > 0.97


def test_neighbour_edges(spark):
    texts = {5: None, 2: "", 9: "x", -3: "\U0001f600" * 9, 40: "ab" * 5000}
    df = spark.createDataFrame([(i, t, "c") for i, t in texts.items()], "doc_id long, text string, fingerprint string")
    held_to_order(minhash.neighbour_report(df.repartition(3)).collect(), texts)
    one = minhash.neighbour_report(df.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert minhash.neighbour_report(df.where("false")).count() == 0
    twice = df.select("text").selectExpr("cast(null as long) as doc_id", "text").unionAll(df.selectExpr("7L", "text"))
    assert minhash.neighbour_report(twice).count() == 10


def test_neighbours_under_hot_ids(spark):
    """A third of the rows under null, a third under one id: cut by the hash of the text, in order all the same."""
    r = random.Random(8)
    rows = [(None if n % 3 == 0 else 7 if n % 3 == 1 else n, "".join(r.choice("abc ") for _ in range(r.randint(0, 30)))) for n in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    ranges = minhash.Ranges(df.selectExpr("doc_id AS id"), 24)
    assert ranges.parts[-1] > 4 and sorted(ranges.parts)[-2] > 4
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), hashlib.blake2b(x[1].encode(), digest_size=8).digest()))
    want = Counter()
    for (i, own), (_, other) in zip(order, order[1:] + order[:1]):
        cut = len(own) // 2
        want[i, hashlib.sha256((own[:len(own) - cut] + other[:cut]).encode()).hexdigest()] += 1
    got = minhash.neighbour_report(df).collect()
    assert Counter((x.doc_id, x.edited_sha256) for x in got) == want
