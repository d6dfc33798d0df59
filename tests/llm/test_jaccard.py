"""The n-gram join against plain sets, and its two filters."""

import os
import random
import time
from pathlib import Path

import brute_jaccard as brute
import numpy as np
from conftest import SF_CHECK, SF_SMALL
from sitelens.llm import graph, jaccard, queries
from sitelens.session import checkpoint_dir, materialize


def family(r, base, n, rate):
    out = []
    for _ in range(n):
        w = [x if r.random() > rate else r.choice(["uno", "dos", "tres"]) for x in base]
        out.append(" ".join(w[:r.randint(max(1, len(w) - 3), len(w))]))
    return out


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    texts = [None, "", " \n\t", "one", "One", "one two three", "one two\x0bthree", "ONE two three four", "é É", "É É"]
    for size in (3, 5, 8, 20, 40, 120, 300):
        texts += family(r, [word() for _ in range(size)], 25, 0.02)
    passage = [word() for _ in range(60)]  # a passage that many documents share
    texts += [" ".join([word() for _ in range(r.randint(5, 80))] + passage) for _ in range(80)]
    texts += texts[10:40]
    return dict(enumerate(texts))


def rows_of(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()],
                                 "doc_id long, text string, label string, n int").repartition(3)


def written(spark, df, tmp_path, name):
    df.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def test_small_corpus(spark, tmp_path):
    docs = corpus()
    df = written(spark, frame(spark, docs), tmp_path, "d")
    assert rows_of(jaccard.components_of(df)) == brute.components(docs)
    assert rows_of(jaccard.components_of(df, words=5, percent=80)) == brute.components(docs, 5, 80)


def test_many_leaves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF_DOCS", 4)
    docs = corpus(2)
    df = written(spark, frame(spark, docs), tmp_path, "d")
    assert rows_of(jaccard.components_of(df)) == brute.components(docs)


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    want = brute.components(docs)
    assert rows_of(queries.op5_ngram_jaccard(spark, SF_CHECK)) == want
    assert sum(c != i for i, (_, c) in want.items()) > 20


def test_nulls_repeats_and_empty(spark, tmp_path):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (3, text + " i j k l"), (None, None), (9, "")],
                               "doc_id long, text string")
    df = written(spark, df, tmp_path, "d")
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id) for r in jaccard.components_of(df).collect())
    assert got == [(0, 0, None), (0, 5, 7), (3, 9, 3), (7, 5, 7), (7, 5, 7), (9, 0, 9)]
    assert jaccard.components_of(df.where("false")).count() == 0
    kept = jaccard.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 7, 9]


def test_kept_rows_do_not_depend_on_the_splits_of_the_scan(spark, tmp_path, monkeypatch):
    """The scan is split in another way before the last pass, as when an executor is lost or added."""
    spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(8).write.parquet(str(tmp_path / "d"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def kept():
        docs = spark.read.parquet(str(tmp_path / "d"))
        return sorted(r.doc_id for r in jaccard.keep_one_of_each(docs).collect())

    want, plain = kept(), jaccard._components_of

    def other_splits(*args):
        out = plain(*args)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        return out

    monkeypatch.setattr(jaccard, "_components_of", other_splits)
    try:
        assert kept() == want and len(want) < 200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_linked_sets_share_a_key():
    r = random.Random(5)
    linked = 0
    for _ in range(4000):
        percent, m = r.choice([80, 85]), r.choice([1, 2, 3, 5, 6, 7, 8, 9, 15, 16, 17, 33, 64, 130, 300])
        a = {r.getrandbits(64) for _ in range(m)}
        b = {x for x in a if r.random() > 0.06} | {r.getrandbits(64) for _ in range(r.randint(0, m // 10 + 1))}
        if b and 100 * len(a & b) >= percent * len(a | b):
            linked += 1
            keys = [set(jaccard.partition_keys(np.array(sorted(s), np.uint64), percent).tolist()) for s in (a, b)]
            assert keys[0] & keys[1]
    assert linked > 1000


def test_rounds_go_on_until_nothing_changes(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_ROUNDS", 2, raising=False)  # a bound on the rounds must not decide the labels
    pairs = [(i, i + 1) for i in range(60)]
    random.Random(2).shuffle(pairs)
    got = {x.node: x.label for x in graph.components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    assert got == dict.fromkeys(range(61), 0)


def test_components_of_chains_and_stars(spark):
    r = random.Random(1)
    chain = [(i, i + 1) for i in range(0, 120)]
    star = [(500, i) for i in range(501, 600)]
    pairs = chain + star + [(900, 901), (901, 900), (5, 5)]
    r.shuffle(pairs)
    got = {x.node: x.label for x in graph.components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    assert got == {i: 0 for i in range(121)} | {i: 500 for i in range(500, 600)} | {900: 900, 901: 900}


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}


def tables_written(spark):
    return {p.name for p in (Path(checkpoint_dir(spark).removeprefix("file:")) / "tables").glob("*")}


def test_tables_leave_no_shuffle_files(spark):
    """They went only when the driver's JVM collected its garbage, so disk followed from luck."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(setting), shuffle_files(spark)
    counts = spark.range(1000).groupBy((jaccard.F.col("id") % 7).alias("k")).count()
    assert sorted(r.k for r in materialize(counts).collect()) == list(range(7))
    until = time.time() + 10  # files go in the background
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and spark.conf.get(setting) == was


def test_step_keeps_only_the_tables_that_its_result_reads(spark, tmp_path):
    docs = corpus(3)
    df = written(spark, frame(spark, docs), tmp_path, "d")
    want = brute.components(docs, 5, 80)
    before = tables_written(spark)
    kept = jaccard.keep_one_of_each(df)
    left = [n.rsplit("-", 1)[0] for n in tables_written(spark) - before]
    assert {"ngram-rows", "ngram-gone"} <= set(left) and len(left) == len(set(left))
    assert not {"ngram-sets", "ngram-shared", "ngram-leaves", "ngram-units", "ngram-links"} & set(left)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (n, c) in want.items() if not n or c == i)
    before = tables_written(spark)
    found = jaccard.components_of(df)
    assert not any(n.startswith("ngram-rows") for n in tables_written(spark) - before)
    assert rows_of(found) == brute.components(docs)
