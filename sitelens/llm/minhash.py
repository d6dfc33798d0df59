"""Order MinHash fingerprints.

Every k-mer of a text is numbered by its occurrences, so that repeats count. For
each of ``m`` hash functions the ``l`` k-mers with the smallest hashes are
selected, kept in text order, and the tuple is hashed: two texts agree in an
entry if the same k-mers are minimal and stand in the same order, which is
sensitive to edit distance and not only to the set of k-mers.

The neighbour report deals documents out by ranges of (descending id, hash of the
text). The bounds are approximate quantiles of the ids (one number per range on the
driver); an id that fills more than a range, or null, is cut further by the hash. The
first document of each range also goes to the range before it, and every range
is then read in order on its own: texts move once, compressed.

Defined results: null text: empty. The empty text has a fingerprint of its own;
two empty texts have likeness 1. Texts shorter than k have one k-mer. Equal
texts have equal fingerprints. Order is by id descending, nulls last, then by a
hash of the text, so repeated ids have a defined order. A table of one row is
its own neighbour. Empty tables: no rows. Only id and text are read, so other
columns cannot clash. Occurrences are told apart by the high bits of the k-mers'
hashes: of a text of n k-mers, 64 - log2(n) of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import batches_of, text_bytes

K = 6            # characters per k-mer
HASHES = 64      # entries of a fingerprint
TUPLE = 2        # k-mers per entry
BLOCK = 1 << 13  # k-mers hashed at a time
BATCH_ROWS = 256
RANGES_PER_PARTITION = 12

U64 = np.uint64
U32 = np.uint32
# An odd factor permutes the 32-bit keys: one hash function each.
_FACTORS = np.random.default_rng(20240601).integers(0, 1 << 31, 256, dtype=U32) * U32(2) + U32(1)
_BASE = U64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser, on an array."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _kmers(text: str, k: int) -> np.ndarray:
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    k = min(k, len(chars))
    n = len(chars) - k + 1
    out = np.zeros(n, U64)
    for i in range(k):
        out = out * _BASE + chars[i:i + n] + U64(1)
    return _mix(out)


def _occurrences(kmers: np.ndarray) -> np.ndarray:
    """0 for the first occurrence of a k-mer, 1 for the second, ... The low bits
    of each hash give way to the position, so one plain sort orders both."""
    n = len(kmers)
    bits = U64(max(1, n.bit_length()))
    index = np.arange(n, dtype=U64)
    ranked = np.sort((kmers >> bits << bits) | index)
    same = ranked >> bits
    first = np.ones(n, bool)
    first[1:] = same[1:] != same[:-1]
    out = np.empty(n, U64)
    out[(ranked & ((U64(1) << bits) - U64(1))).astype(np.int64)] = index - np.maximum.accumulate(
        np.where(first, index, U64(0)))
    return out


def fingerprint(text: str | None, k: int = K, hashes: int = HASHES, tuple_size: int = TUPLE) -> np.ndarray:
    """``hashes`` 32-bit entries. Blocks of the k-mers are reduced one after the
    other, so memory does not follow the text's length times ``hashes``."""
    if not text:
        return np.zeros(hashes, np.uint32)
    kmers = _kmers(text, k)
    keys = (_mix(kmers + _occurrences(kmers) * _BASE) >> U64(32)).astype(U32)
    take = min(tuple_size, len(keys))
    best = np.zeros((hashes, 0), U32)
    places = np.zeros((hashes, 0), np.int64)
    rows = np.arange(hashes)
    for at in range(0, len(keys), BLOCK):
        values = np.multiply.outer(_FACTORS[:hashes], keys[at:at + BLOCK])
        picked, where = [], []
        for _ in range(min(take, values.shape[1])):
            low = values.argmin(axis=1)
            picked.append(values[rows, low])
            where.append(low + at)
            values[rows, low] = np.iinfo(U32).max
        best = np.concatenate([best, np.stack(picked, 1)], 1)
        places = np.concatenate([places, np.stack(where, 1)], 1)
        if best.shape[1] > take:
            keep = np.argsort(best, axis=1, kind="stable")[:, :take]
            best, places = np.take_along_axis(best, keep, 1), np.take_along_axis(places, keep, 1)
    entry = np.full(hashes, take, U64)
    for column in np.sort(places, axis=1).T:
        entry = _mix(entry * _BASE + kmers[column])
    return (entry >> U64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def printed(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


class Ranges:
    """Ranges of (id descending, nulls last, then hash of the text ascending), numbered in that order."""

    def __init__(self, ids: DataFrame, ranges: int):
        rows, nulls, cuts = ids.agg(F.count("*"), F.count_if(F.col("id").isNull()), F.percentile_approx(
            "id", [i / ranges for i in range(1, ranges)] or [0.5], 10000)).first()
        cuts = sorted(int(x) for x in cuts or [])
        often = {c: cuts.count(c) for c in set(cuts) if cuts.count(c) > 1}  # ids that fill more than a range
        self.cuts = np.array(sorted(set(cuts) | {c - 1 for c in often if c > -(1 << 63)}), np.int64)
        # parts of each base range: 0 for the largest ids, rising as ids fall; null ids come last
        parts = np.ones(len(self.cuts) + 2, np.int64)
        for c, n in often.items():
            parts[len(self.cuts) - np.searchsorted(self.cuts, c, side="left")] = n + 1
        parts[-1] = max(1, -(-nulls * ranges // rows)) if rows else 1
        self.parts, self.first = parts, np.cumsum(parts) - parts

    def of(self, ids: np.ndarray, missing: np.ndarray, order: np.ndarray) -> np.ndarray:
        base = np.where(missing, len(self.cuts) + 1, len(self.cuts) - np.searchsorted(self.cuts, ids, side="left"))
        return self.first[base] + ((order >> U64(32)).astype(np.int64) * self.parts[base] >> 32)


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = b.column(0)
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)


def neighbour_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                     hashes: int = HASHES, tuple_size: int = TUPLE) -> DataFrame:
    """Fingerprints of every text, of its edited text (its second half replaced
    by the start of the next document) and their likeness."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = Ranges(source.select("id"), partitions * RANGES_PER_PARTITION)

    def hashed(raws: list[bytes]) -> list[bytes]:
        return [hashlib.blake2b(raw, digest_size=8).digest() for raw in raws]

    def numbers(b: pa.RecordBatch, orders: list[bytes]) -> np.ndarray:
        return ranges.of(*_columns(b), np.frombuffer(b"".join(orders), ">u8").astype(U64))

    def places(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(BATCH_ROWS, it):
            orders = hashed(text_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(numbers(b, orders), pa.int64()), b.column(0), pa.array(orders, pa.binary())],
                                             ["range", "id", "order"])

    # one row per range that has documents: its first document
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.bitwise_not("id").alias("turned"), "id", "order"))
    heads = sorted((r["range"], r["head"]["id"], bytes(r["head"]["order"])) for r in source.mapInArrow(
        places, "range long, id long, order binary").groupBy("range").agg(first.alias("head")).collect())
    before = {h: heads[n - 1][0] for n, h in enumerate(heads)}  # the first range goes behind the last one

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches_of(BATCH_ROWS, it):
            rows, raws = [], text_bytes(b.column(1))
            orders = hashed(raws)
            for r, key, order, raw in zip(numbers(b, orders).tolist(), b.column(0).to_pylist(), orders, raws):
                body = press.compress(raw)
                rows.append((r, 0, key, order, body))
                if (r, key, order) in before:
                    rows.append((before[r, key, order], 1, key, order, body))
            names = ["range", "tail", "id", "order", "body"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        held = None  # (range, tail, id, text, fingerprint) of the row before
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for b in batches_of(BATCH_ROWS, it):
            out = []
            for r, tail, i, body in zip(*(b.column(c).to_pylist() for c in ("range", "tail", "id", "body"))):
                if held is not None and tail and held[1]:
                    continue  # further rows like the neighbour's first
                text = unpress.decompress(body).decode("utf-8", "surrogatepass")
                mark = fingerprint(text, k, hashes, tuple_size)
                if held is not None and held[0] == r and not held[1]:
                    own, own_mark = held[3], held[4]
                    cut = len(own) // 2
                    edited = own[:len(own) - cut] + text[:cut]
                    edited_mark = fingerprint(edited, k, hashes, tuple_size)
                    out.append((held[2], len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                                printed(own_mark), printed(edited_mark), likeness(own_mark, edited_mark),
                                likeness(own_mark, mark)))
                held = (r, tail, i, text, mark)
            cols = list(zip(*out)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    dealt = source.mapInArrow(deal, "range long, tail int, id long, order binary, body binary")
    ordered = dealt.repartition(partitions, "range").sortWithinPartitions(
        "range", "tail", F.col("id").desc_nulls_last(), "order")
    return ordered.mapInArrow(compare, "id long, n_chars long, edited_sha256 string, fingerprint string, "
                              "edited_fingerprint string, near_edited double, near_next double") \
        .withColumnRenamed("id", id_col)
