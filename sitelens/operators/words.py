"""Frequent-word removal (P-10) and per-document word counts (A-2).

A document with more than 10 words loses every occurrence of each word
(compared lower-cased, only words longer than 3 characters) that occurs more
than 3 times; the kept words are re-joined with single spaces. Shorter
documents are only stripped.

Both run inside each document row (sort + neighbour tests), so they need no
shuffle at all; only the few frequent words of the report are exploded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import remove_nav_patterns, split_ws, strip_ws

MIN_WORDS = 10       # documents with at most this many words are left as they are
MIN_WORD_CHARS = 3   # only words longer than this are counted
MAX_REPEATS = 3      # words counted more often than this are dropped


def frequent_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, word, n): lower-cased long words occurring more than 3 times
    in a document of more than 10 words (A-2).

    Counted inside each row: the sorted long words form runs of equal
    words; run starts are the positions where the word changes, and a run's
    length is the distance to the next start. Only the (few) frequent words
    are exploded; no shuffle.
    """
    words = split_ws(text_col)
    df = docs.select("doc_id", words.alias("_w")).filter(F.size("_w") > MIN_WORDS)
    df = df.withColumn("_s", F.sort_array(F.filter(F.transform("_w", lambda w: F.lower(w)),
                                                   lambda w: F.length(w) > MIN_WORD_CHARS)))
    s = F.col("_s")
    df = df.withColumn("_st", F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                                       lambda j: (j == 0) | (F.get(s, j) != F.get(s, j - 1))))
    st = F.col("_st")
    runs = F.transform(st, lambda b, i: F.struct(
        F.get(s, b).alias("word"),
        (F.coalesce(F.get(st, i + 1), F.size(s)) - b).cast("long").alias("n")))
    df = df.filter(F.size(s) > 0).select("doc_id", F.explode(F.filter(runs, lambda r: r["n"] > MAX_REPEATS)).alias("r"))
    return df.select("doc_id", "r.word", "r.n")


def drop_frequent_words(docs: DataFrame, text_col: str = "text", out: str = "text_out") -> DataFrame:
    """(doc_id, out) for every document, computed inside each row.

    The (lower-cased long word, position, word) triples are sorted by word,
    so equal words are adjacent; a word occurs more than 3 times iff one of
    the four 4-long windows around it holds a single word (4 index lookups).
    Kept words are re-sorted by position and joined. O(n log n) per
    document, whole documents, no shuffle and no Python.
    """
    words = split_ws(text_col)
    df = docs.select("doc_id", strip_ws(text_col).alias("_stripped"), words.alias("_w"))
    df = df.withColumn("_srt", F.sort_array(F.transform(
        "_w", lambda w, i: F.struct(F.when(F.length(w) > MIN_WORD_CHARS, F.lower(w)).alias("k"),
                                    i.alias("pos"), w.alias("word")))))
    s = F.col("_srt")
    span = MAX_REPEATS + 1

    def frequent(x, j):
        # In a sorted array a run of >= 4 equal keys covers j iff one of the
        # four windows of length 4 around j is constant; equality of the two
        # window ends implies the rest.
        k = x["k"]
        eq = lambda off: F.coalesce(F.get(s, j + off)["k"] == k, F.lit(False))
        hit = eq(-(span - 1)) | eq(span - 1)
        for left in range(1, span - 1):
            hit = hit | (eq(-left) & eq(span - 1 - left))
        return k.isNotNull() & hit

    kept = F.filter(F.transform(s, lambda x, j: F.struct(x["pos"].alias("pos"), x["word"].alias("word"),
                                                         frequent(x, j).alias("drop"))),
                    lambda x: ~x["drop"])
    joined = F.array_join(F.transform(F.sort_array(F.transform(kept, lambda x: F.struct(x["pos"], x["word"]))),
                                      lambda x: x["word"]), " ")
    res = F.when(F.size("_w") <= MIN_WORDS, F.col("_stripped")).otherwise(joined)
    return df.select("doc_id", res.alias(out))


def remove_navigation_noise(docs: DataFrame, text_col: str = "text", out: str = "text_out") -> DataFrame:
    """Both steps (P-9 patterns, then P-10) over whole documents."""
    step1 = docs.select("doc_id", remove_nav_patterns(text_col).alias("_t1"))
    return drop_frequent_words(step1, "_t1", out)
