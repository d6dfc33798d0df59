"""Importance resampling towards a target distribution, drawn by a distributed radix sort.

Weights: the word n-grams of corpus and target are counted in hashed buckets; the
log ratio of the two smoothed shares is a bucket's gain, and a document's weight
is the mean gain of its features, read from one array of ``buckets`` numbers.
Adding Gumbel noise that follows from the document's id makes the draw of the
highest scores a draw without replacement in proportion to the weights.

Draw: scored rows are ranked by a least-significant-digit radix sort over the
composite key (score descending, id ascending). Rows lie in blocks of at most
``block_rows`` with a position each. A pass over one digit of the key is a stable
counting sort: digits are counted per block; prefix sums of the counts, over
digits and then over the blocks of a digit, are the offsets; a task reads one
block in order of position and hands out destinations from its offsets. The
destination names block and position for the next pass; after the last one it is
the rank. A key's digits follow from its least and largest value in the table.
Each pass is written to the shared folder, so a lost executor costs one pass at
most. No task holds more than a block, whatever the keys look like: rows with one
score, or with one id, spread over blocks like any others.

Defined results: null or empty text: no features, weight 0. Null ids: noise of
the empty id, last among equal scores. Repeated rows are rows like any others;
rows equal in score and id are ranked in the order of the scan. Empty corpus: no
rows; empty or null target texts: every gain compares with nothing seen. Very
long texts: whole, a batch at a time. Only id and text are read, so other
columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import batches_of, text_bytes
from sitelens.session import materialize

BUCKETS = 10_000
NGRAMS = (1, 1)
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
DIGIT_BITS = 11
BLOCK_ROWS = 1 << 15
BATCH_ROWS = 512

# ASCII: A-Z become a-z, what is no digit or letter becomes a blank. All other bytes are word bytes.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and characters beyond ASCII."""
    return raw.translate(_FOLD).split()


def features(raw: bytes, ngrams: tuple[int, int] = NGRAMS) -> tuple[int, list[int]]:
    """Number of words, and the CRC-32 of every run of ``ngrams`` consecutive words."""
    words = words_of(raw)
    out: list[int] = []
    for n in range(ngrams[0], ngrams[1] + 1):
        runs = words if n == 1 else [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
        out += map(zlib.crc32, runs)
    return len(words), out


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, ngrams: tuple[int, int] = NGRAMS,
                  text_col: str = "text") -> DataFrame:
    """(bucket, n): features per bucket over all texts. A task sends one row per bucket that it met."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches_of(BATCH_ROWS, it):
            for raw in text_bytes(b.column(0)):
                found = np.array(features(raw, ngrams)[1], np.int64) % buckets
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    part = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, ngrams: tuple[int, int] = NGRAMS,
          text_col: str = "text", target_col: str = "text") -> np.ndarray:
    """Gain of every bucket: 1000 times the log ratio of the smoothed shares, rounded down. ``buckets`` numbers."""
    def dense(df: DataFrame) -> list[int]:
        got = {r["bucket"]: r["n"] for r in df.collect()}  # at most one row per bucket
        return [got.get(i, 0) for i in range(buckets)]

    s = dense(bucket_counts(corpus, buckets, ngrams, text_col))
    t = dense(bucket_counts(target, buckets, ngrams, target_col))
    seen, wanted = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((float(b + 1) * seen) / (float(a + 1) * wanted))) for a, b in zip(s, t)],
                    np.int64)


def noise(seed: int, doc: int | None) -> int:
    """Gumbel noise in thousandths, rounded down, from the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_features long, n_words long, weight long, score long, block long, pos long"


def scored(corpus: DataFrame, gain: np.ndarray, seed: int = SEED, ngrams: tuple[int, int] = NGRAMS,
           id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every document's features, weight and score, and its place in the scan (block, position)."""
    buckets = len(gain)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, at = TaskContext.get().partitionId() << 32, 0
        for b in batches_of(BATCH_ROWS, it):
            docs, cols = b.column(0).to_pylist(), [[] for _ in range(4)]
            for doc, raw in zip(docs, text_bytes(b.column(1))):
                n_words, found = features(raw, ngrams)
                weight = int(gain[np.array(found, np.int64) % buckets].sum()) // len(found) if found else 0
                for col, v in zip(cols, (len(found), n_words, weight, weight + noise(seed, doc))):
                    col.append(v)
            place = np.arange(at, at + len(docs))
            at += len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), *[pa.array(c, pa.int64()) for c in cols],
                 pa.array(first + place // block_rows, pa.int64()), pa.array(place % block_rows, pa.int64())],
                ["doc_id", "n_features", "n_words", "weight", "score", "block", "pos"])

    return corpus.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCORED)


def key_digits(col: F.Column, low: int, high: int, digit_bits: int, descending: bool = False) -> list[F.Column]:
    """Digits of a long key between ``low`` and ``high``, least significant first."""
    if high - low < 1 << 63:
        bits, key = (high - low).bit_length(), F.lit(high) - col if descending else col - F.lit(low)
    else:  # the distance would overflow: the bits in unsigned order
        bits, key = 64, col.bitwiseXOR(F.lit(-1 << 63))
        key = F.bitwise_not(key) if descending else key
    mask = F.lit((1 << digit_bits) - 1).cast("long")
    return [F.shiftrightunsigned(key, s).bitwiseAND(mask) for s in range(0, bits, digit_bits)]


def counting_pass(rows: DataFrame, digit: F.Column, digit_bits: int, block_rows: int) -> DataFrame:
    """One stable counting sort of ``rows`` (block, pos, ...) by ``digit``: the
    same rows with the block and position that they get."""
    keyed = rows.withColumn("__digit", digit.cast("int"))
    counts = keyed.groupBy("block", "__digit").agg(F.count("*").alias("n"))
    per_digit = counts.groupBy("__digit").agg(F.sum("n").alias("n"))
    # at most 2 ** digit_bits rows: smaller digits come first
    bases = per_digit.select(F.col("__digit").alias("__of"), (F.sum("n").over(
        Window.orderBy("__digit").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("__base"))
    earlier = F.sum("n").over(Window.partitionBy("__digit").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    offsets = counts.withColumn("__earlier", earlier).join(F.broadcast(bases), F.col("__digit") == F.col("__of")).select(
        F.col("block").alias("__block"), F.col("__digit").alias("__key"), (F.col("__base") + F.col("__earlier")).alias("__offset"))
    size, out = 1 << digit_bits, rows.schema

    def deal(key, left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        pos = left.column("pos").to_numpy()
        digit_at = np.zeros(int(pos.max()) + 1, np.int64) - 1
        row_at = np.zeros(len(digit_at), np.int64)
        digit_at[pos], row_at[pos] = left.column("__digit").to_numpy(), np.arange(n)
        held = digit_at >= 0                      # positions of rows that take no part are free
        digits, row = digit_at[held], row_at[held]
        offset = np.zeros(size, np.int64)
        offset[right.column("__key").to_numpy()] = right.column("__offset").to_numpy()
        order = np.argsort(digits.astype(np.uint16), kind="stable")  # by counting, for 16 bits
        ordered = digits[order]
        starts = np.searchsorted(ordered, ordered)
        to = np.empty(n, np.int64)
        to[row[order]] = offset[ordered] + np.arange(n) - starts
        cols = {c: left.column(c) for c in out.names}
        cols["block"], cols["pos"] = pa.array(to // block_rows), pa.array(to % block_rows)
        return pa.table([cols[c] for c in out.names], names=out.names)

    return keyed.groupBy("block").cogroup(offsets.groupBy("__block")).applyInArrow(deal, out)


def radix_ranked(rows: DataFrame, score: str = "score", id_col: str = "doc_id", digit_bits: int = DIGIT_BITS,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` (block, pos, score, id, ...) with ``rank`` 1, 2, ... by score
    descending, then id ascending, nulls last, then the order of the scan."""
    if not 1 <= digit_bits <= 16:
        raise ValueError("digits have 1 to 16 bits")
    ends = rows.agg(F.min(id_col).alias("a"), F.max(id_col).alias("b"), F.min(score).alias("c"), F.max(score).alias("d"),
                    F.max(F.col(id_col).isNull()).alias("nulls")).first()
    passes = []
    if ends["a"] is not None:
        known = F.coalesce(F.col(id_col), F.lit(ends["a"]))
        passes += key_digits(known, ends["a"], ends["b"], digit_bits)
        if ends["nulls"]:
            passes.append(F.col(id_col).isNull().cast("long"))
    if ends["c"] is not None:
        passes += key_digits(F.col(score), ends["c"], ends["d"], digit_bits, descending=True)
    passes = passes or [F.lit(0).cast("long")]
    for n, key in enumerate(passes):
        rows = materialize(counting_pass(rows, key, digit_bits, block_rows), f"radix-{n}")
    return rows.withColumn("rank", F.col("block") * F.lit(block_rows) + F.col("pos") + 1).drop("block", "pos")


def resample(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, ngrams: tuple[int, int] = NGRAMS,
             seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT, id_col: str = "doc_id",
             text_col: str = "text", target_col: str = "text", digit_bits: int = DIGIT_BITS,
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every document's ``doc_id, n_features, weight, score, rank``: of the N
    documents with at least ``least_words`` words the ``percent * N // 100`` with
    the highest scores are drawn and ranked, the others have a null rank."""
    gain = gains(corpus, target, buckets, ngrams, text_col, target_col)
    rows = materialize(scored(corpus, gain, seed, ngrams, id_col, text_col, block_rows), "scored")
    may = rows.where(F.col("n_words") >= least_words)
    drawn = percent * may.count() // 100
    ranked = radix_ranked(may, digit_bits=digit_bits, block_rows=block_rows)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(names).unionByName(rest.select(names))
