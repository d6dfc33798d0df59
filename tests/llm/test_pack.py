"""Packing: exact round trip through the windows."""

import random
import zlib
from collections import defaultdict

import numpy as np
from conftest import SF_CHECK
from sitelens.llm import pack, queries
from tokenizers import Tokenizer


def check(rows, texts, encode, window=2048):
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        ids = [*encode(text or ""), 1]
        at = 0
        for r in sorted(pieces.pop(doc), key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            own = np.array(ids[at:at + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(own.tobytes())
            at += r.length
        assert at == len(ids)
    assert not pieces
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    return sum(n for s in places.values() for _, n in s) / (window * len(places))


def reference():
    t = Tokenizer.from_file(queries.tokenizer_path())
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_whole_table_round_trip(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    filled = check(queries.op1_pack(spark, SF_CHECK).collect(), texts, reference())
    assert filled > 0.98


def test_packing_stage_round_trip(spark):
    import corpus_pipeline as P
    df = spark.read.parquet(f"{SF_CHECK}/documents.parquet").limit(300).localCheckpoint()
    texts, encode = {r.doc_id: r.text for r in df.collect()}, reference()
    rows = P.packing(spark, df, SF_CHECK).collect()
    check(rows, texts, encode)
    whole = {i: [*encode(t or ""), 1] for i, t in texts.items()}
    assert all(r.ids == whole[r.doc_id][r.start:r.start + r.length] for r in rows)


def test_hard_texts(spark):
    r = random.Random(7)
    bits = ["<|endoftext|>", " ", "  ", "\n", "a", "the", "'s", "é", "\U0001f600", "123", "_", "\r\n", "中文", "!!", "\x00", "²"]
    texts = {i: "".join(r.choice(bits) for _ in range(r.randint(0, 30))) for i in range(2000)}
    texts |= {2000: None, 2001: "", 2002: "a " * 30000, 2003: "x" * 50000, 2004: texts[0], 2005: texts[0]}
    df = spark.createDataFrame([(i, t, "c", 5) for i, t in texts.items()], "doc_id long, text string, start string, length int")
    check(pack.pack_documents(df.repartition(3), queries.tokenizer_path()).collect(), texts, reference())


def test_ids_column_empty_table_and_nulls(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    rows = pack.pack_documents(df.coalesce(1), queries.tokenizer_path(), with_ids=True).collect()
    assert len(rows) == 2 and all(r.ids[-1] == 1 and len(r.ids) == r.length for r in rows)
    assert pack.pack_documents(df.where("false"), queries.tokenizer_path()).count() == 0


def test_group_of_tiny_documents_has_few_sizes(monkeypatch):
    asked, plain = [], pack.differenced
    monkeypatch.setattr(pack, "differenced", lambda sizes, k: asked.append(len(sizes)) or plain(sizes, k))
    packer = pack._Packer(0, 64, 16, 32)
    r = random.Random(4)
    sizes = [r.choice((1, 1, 1, 1, 2, 15, 16, 40, 200)) if i > 4000 else 1 for i in range(6000)]
    for doc, n in enumerate(sizes):
        packer.add(doc, np.full(n, doc, np.uint32))
    packer.flush()
    rows = packer.take(True).to_pylist()
    places, lengths = defaultdict(list), defaultdict(int)
    for x in rows:
        assert set(x["ids"]) == {x["doc_id"]} and x["start"] == lengths[x["doc_id"]]
        lengths[x["doc_id"]] += x["length"]
        places[x["sequence_id"]].append((x["offset"], x["length"]))
    assert [lengths[d] for d in range(len(sizes))] == sizes
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(sizes) / (64 * len(places)) > 0.95
    assert max(asked) <= 2 * 32 * 62 / 16 + 1  # two runs in a row hold more than a grain


def test_differencing_balances_and_count_rises():
    r = random.Random(3)
    for _ in range(30):
        k = r.randint(2, 12)
        sizes = [r.randint(1, 256) for _ in range(k * 10)]
        loads = np.bincount(pack.differenced(sizes, k), weights=sizes, minlength=k)
        assert loads.sum() == sum(sizes) and loads.max() - loads.min() <= 20
    window = pack.fill([1500, 1500, 1500], 2048)  # two windows would do by sum, none of them by fit
    assert sorted(window.tolist()) == [0, 1, 2]
    assert pack.fill([2048], 2048).tolist() == [0]
