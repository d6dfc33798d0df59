"""Repeated passages of the corpus, found by two-stage suffix sorting.

A byte is removed if some run of ``length`` bytes that covers it starts anywhere
else too. Equal runs must meet in one sort, and no sort may grow with the corpus:

* A run's *anchor* is the least hash among its grams of ``gram`` bytes. Equal
  runs have equal anchors at equal places. Consecutive starts with one anchor are a
  *stretch*: its text reaches from the first start to the end of the last run.
* Stretches are listed once (``stretches``): anchor, digest of the stretch's text,
  digest of the document's text, place. Equal stretches are counted with partial
  aggregation, so copies never meet as rows.
* Of a stretch that occurs more than once every start is repeated. Stretches that
  differ but share an anchor may still share runs: their texts are fetched, one per
  distinct stretch, and their suffixes sorted (``suffixsort``); starts whose suffix
  shares ``length`` bytes with a neighbour are repeated. An anchor that nothing
  shares is dropped.
* An anchor with more than ``most`` distinct stretches (the rim of a passage that
  very many documents quote, each in its own surroundings) is not sorted in one
  task: its stretches are cut into blocks of starts by their distance from the
  anchor, and the bytes that all runs of a block have in common (nearly the whole
  run) are its anchor. What lies in the passage becomes equal, what lies in the
  surroundings becomes single. Blocks that are still too many are cut to single
  starts, of which equal ones are one.
* The marked stretches go back to their documents, which are rewritten whole. A
  text digest of 64 bits only routes; each marked stretch is compared by digest with
  the text that it reaches.

Defined results: null or empty text: no bytes, nothing removed. Texts under
``length`` bytes keep all. Repeated rows and null ids: each row is a place of its
own, so the copies' common runs go from all of them. Very long texts are listed in
slices that overlap by a run. Empty table: no rows. Only id and text are read, so
other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.common import batches_of, text_bytes
from sitelens.llm.suffixsort import repeated_starts
from sitelens.session import materialize

LENGTH = 200
GRAM = 32
MOST = 2048               # distinct stretches of an anchor that are sorted in one task
BLOCKS = (13, 1)          # starts of a block, where there are more
SLICE_BYTES = 1 << 20     # bytes that are listed, or sorted, at a time
BATCH_ROWS = 256
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_PLACE_BITS = 24          # low bits of a gram's rank: its place, so that ties go to the first

_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, U64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0][:n], _POWERS[1][:n]


def anchored(raws: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Stretches of the texts: (text number, first start, starts, anchor, its distance from the first start)."""
    sizes = np.array([len(r) for r in raws], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    buf = np.frombuffer(b"".join(raws), np.uint8)
    wide, n = length - gram + 1, len(buf)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64), np.zeros(0, np.int64))
    power, inverse = _powers(n + 1)
    mixed = (buf.astype(U64) + U64(1)) * U64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> U64(32)
    sums = np.zeros(n + 1, U64)
    np.cumsum(mixed * power[:n], out=sums[1:])
    grams = (sums[gram:] - sums[:-gram]) * inverse[:n - gram + 1]
    grams ^= grams >> U64(29)
    grams *= U64(0xBF58476D1CE4E5B9)
    grams ^= grams >> U64(32)
    place = U64((1 << _PLACE_BITS) - 1)
    rank = (grams & ~place) | np.arange(len(grams), dtype=U64)
    # least rank of every window of ``wide`` grams, from running minima of blocks
    blocks = np.concatenate([rank, np.full(-len(rank) % wide, ~U64(0))]).reshape(-1, wide)
    windows = len(rank) - wide + 1
    down = np.minimum.accumulate(blocks, axis=1).ravel()[wide - 1:wide - 1 + windows]
    up = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:windows]
    at = (np.minimum(up, down) & place).astype(np.int64)
    text = np.searchsorted(ends, np.arange(windows), side="right")
    inside = np.arange(windows) + length <= ends[text]
    heads = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])))
    count = np.diff(np.append(heads, windows))
    kept = inside[heads]
    heads, count = heads[kept], count[kept]
    of = text[heads]
    return of, heads - starts[of], count, grams[at[heads]], at[heads] - heads


def _place(place: int) -> tuple[int, int, int]:
    """First start, distance of the anchor, number of starts."""
    return place >> 32, place >> 16 & 0xFFFF, place & 0xFFFF


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, U64).view(np.int64))


def _digest(raw: bytes) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(raw)


STRETCH = "anchor long, digest long, text long, place long"


def stretches(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(anchor, digest, text, place) of every stretch; ``place`` holds the first
    start, the anchor's distance from it and the number of starts."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def listed() -> pa.RecordBatch:
            of, first, count, anchor, lead = anchored([raw for _, _, raw in held], length, gram)
            digest = [_digest(held[n][2][a:a + k + length - 1]) for n, a, k in zip(of.tolist(), first.tolist(), count.tolist())]
            key, offset = (np.array([h[i] for h in held], t) for i, t in ((0, U64), (1, np.int64)))
            return pa.RecordBatch.from_arrays(
                [_signed(anchor), _signed(digest), _signed(key[of]), pa.array((first + offset[of]) << 32 | lead << 16 | count)],
                ["anchor", "digest", "text", "place"])

        for b in batches_of(BATCH_ROWS, it):
            for raw in text_bytes(b.column(0)):
                if len(raw) < length:
                    continue
                key = _digest(raw)
                for a in range(0, len(raw) - length + 1, SLICE_BYTES):
                    part = raw[a:a + SLICE_BYTES + length - 1]
                    if size + len(part) > SLICE_BYTES and held:
                        yield listed()
                        held, size = [], 0
                    held.append((key, a, part))
                    size += len(part)
        if held:
            yield listed()

    return docs.select("text").mapInArrow(run, STRETCH)


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, body): texts compressed for the shuffle, with the digest that routes them."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches_of(BATCH_ROWS, it):
            raws = text_bytes(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), _signed([_digest(r) for r in raws]), pa.array([pack.compress(r) for r in raws], pa.binary())],
                ["doc_id", "key", "body"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key long, body binary")


def _unpacked(column: pa.Array) -> list[bytes]:
    import zstandard
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(x) for x in column.to_pylist()]


PIECE = "anchor long, digest long, n long, starts long, lead long, body binary"
_TEXT = PIECE + ", kinds long"
_PIECE = [pa.int64()] * 5 + [pa.binary()]
MARKED = "anchor long, digest long, marks binary"
_MARKED = [pa.int64(), pa.int64(), pa.binary()]


def _rows(rows: list[tuple], names: str, types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [f.split()[0] for f in names.split(", ")])


def _marks(flags: np.ndarray) -> bytes | None:
    """Flags of the starts; none if it is all of them."""
    return None if flags.all() else np.packbits(flags, bitorder="little").tobytes()


def _flags(marks: bytes | None, count: int) -> np.ndarray:
    return np.ones(count, bool) if marks is None else \
        np.unpackbits(np.frombuffer(marks, np.uint8), bitorder="little")[:count].astype(bool)


def _texts_of(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Distinct stretches (anchor, digest, n, kinds, text, place) with their bytes, read
    from one of their documents."""
    one = _packed(docs.where(F.octet_length("text") >= length)).groupBy("key").agg(F.first("body").alias("body"))
    of = wanted.groupBy(F.col("text").alias("__text")).agg(F.collect_list(F.struct("anchor", "digest", "n", "kinds", "place")).alias("held"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(BATCH_ROWS, it):
            rows = []
            for raw, held in zip(_unpacked(b.column(0)), b.column(1).to_pylist()):
                for h in held:
                    first, lead, count = _place(h["place"])
                    body = raw[first:first + count + length - 1]
                    if np.int64(U64(_digest(body))) == h["digest"]:  # otherwise another text with this key
                        rows.append((h["anchor"], h["digest"], h["n"], count, lead, body, h["kinds"]))
            yield _rows(rows, _TEXT, [*_PIECE, pa.int64()])

    return one.join(of, F.col("key") == F.col("__text")).select("body", "held").mapInArrow(run, _TEXT)


def _sorted_marks(pieces: DataFrame, length: int) -> DataFrame:
    """Stretches with a repeated start, by suffix sorting all stretches of an anchor.

    ``pieces`` must be read from a table, not come out of a join by anchor: Spark leaves
    out a repartition that a join below it seems to do already, and where the join then
    runs as a broadcast the stretches of an anchor lie in many tasks."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def found() -> pa.RecordBatch:
            flags = repeated_starts([h[4] for h in held], [h[3] for h in held], length)
            return _rows([(h[0], h[1], _marks(f) if h[2] == 1 else None) for h, f in zip(held, flags) if h[2] > 1 or f.any()],
                         MARKED, _MARKED)

        for b in batches_of(BATCH_ROWS, it):
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size > SLICE_BYTES and row[0] != held[-1][0]:
                    yield found()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield found()

    return pieces.select("anchor", "digest", "n", "starts", "body").repartition("anchor") \
        .sortWithinPartitions("anchor", "digest").mapInArrow(run, MARKED)


def _cut_marks(pieces: DataFrame, length: int, most: int, blocks: tuple[int, ...]) -> DataFrame:
    """The same for anchors with more stretches than one task sorts."""
    import xxhash
    block = blocks[0]
    cut_schema = "of_anchor long, of_digest long, at long, " + PIECE

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(BATCH_ROWS, it):
            rows = []
            for anchor, digest, n, count, lead, body in zip(*(c.to_pylist() for c in b.columns)):
                i = 0
                while i < count:  # starts by their distance from the anchor
                    number = (lead - i) // block
                    end = min(count, lead - number * block + 1)
                    part = body[i:end - 1 + length]
                    core = body[lead - number * block:lead - (number + 1) * block + 1 + length]
                    rows.append((anchor, digest, i, np.int64(U64(xxhash.xxh3_64_intdigest(core, seed=number + 1))),
                                 np.int64(U64(_digest(part))), n, end - i, lead - i, part))
                    i = end
            yield _rows(rows, cut_schema, [pa.int64()] * 3 + _PIECE)

    names = [f.split()[0] for f in PIECE.split(", ")]
    parts = materialize(pieces.select(names).mapInArrow(cut, cut_schema), f"blocks-{block}")
    distinct = materialize(parts.groupBy("anchor", "digest").agg(
        F.sum("n").alias("n"), *[F.first(c).alias(c) for c in names[3:]]), f"distinct-blocks-{block}")
    kinds = distinct.groupBy(F.col("anchor").alias("__anchor")).agg(F.sum("n").alias("__n"), F.count("*").alias("__kinds")) \
        .where("__n > 1")
    shared = materialize(distinct.join(kinds, F.col("anchor") == F.col("__anchor")), f"shared-blocks-{block}")
    marks = shared.where("__kinds = 1").select("anchor", "digest", F.lit(None).cast("binary").alias("marks")) \
        .unionByName(_sorted_marks(shared.where((F.col("__kinds") > 1) & ((F.col("__kinds") <= most) | (block == 1))), length))
    if block > 1:
        marks = marks.unionByName(_cut_marks(shared.where(F.col("__kinds") > most), length, most, blocks[1:]))
    marks = marks.select(F.col("anchor").alias("__anchor"), F.col("digest").alias("__digest"), "marks")
    found = parts.select("of_anchor", "of_digest", "at", "starts", "anchor", "digest") \
        .join(marks, (F.col("anchor") == F.col("__anchor")) & (F.col("digest") == F.col("__digest")))

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(BATCH_ROWS, it):
            rows = []
            for anchor, digest, count, held in zip(*(c.to_pylist() for c in b.columns)):
                flags = np.zeros(count, bool)
                for h in held:
                    flags[h["at"]:h["at"] + h["starts"]] = _flags(h["marks"], h["starts"])
                rows.append((anchor, digest, _marks(flags)))
            yield _rows(rows, MARKED, _MARKED)

    # a stretch has at most length - gram + 1 starts
    whole = pieces.select(F.col("anchor").alias("__a"), F.col("digest").alias("__d"), F.col("starts").alias("count"))
    held = found.groupBy("of_anchor", "of_digest").agg(F.collect_list(F.struct("at", "starts", "marks")).alias("held"))
    return held.join(whole, (F.col("of_anchor") == F.col("__a")) & (F.col("of_digest") == F.col("__d"))) \
        .select("of_anchor", "of_digest", "count", "held").mapInArrow(gather, MARKED)


def marked(docs: DataFrame, listed: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """(anchor, digest, marks): every distinct stretch that has repeated starts; null marks: all of them."""
    distinct = materialize(listed.groupBy("anchor", "digest").agg(
        F.count("*").alias("n"), F.min(F.struct("text", "place")).alias("at")), "distinct-stretches")
    shared = distinct.groupBy(F.col("anchor").alias("__anchor")).agg(F.sum("n").alias("__n"), F.count("*").alias("__kinds")) \
        .where("__n > 1")
    rows = distinct.join(shared, F.col("anchor") == F.col("__anchor")).select(
        "anchor", "digest", "n", F.col("__kinds").alias("kinds"), F.col("at.text").alias("text"), F.col("at.place").alias("place"))
    rows = materialize(rows, "shared-stretches")
    alone = rows.where("kinds = 1").select("anchor", "digest", F.lit(None).cast("binary").alias("marks"))
    pieces = materialize(_texts_of(docs, rows.where("kinds > 1"), length), "stretch-texts")
    parts = alone.unionByName(_sorted_marks(pieces.where(F.col("kinds") <= most), length))
    return materialize(parts.unionByName(_cut_marks(pieces.where(F.col("kinds") > most), length, most, BLOCKS)), "marked-stretches")


def _covered(raw: bytes, held: list[dict], length: int) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, what is left)."""
    froms, tos = [], []
    for h in held:
        first, _, count = _place(h["place"])
        if np.int64(U64(_digest(raw[first:first + count + length - 1]))) != h["digest"]:
            continue  # another text with this key
        if h["marks"] is None:
            froms.append(first)
            tos.append(first + count - 1 + length)
        else:
            turns = np.flatnonzero(np.diff(np.concatenate([[0], _flags(h["marks"], count).astype(np.int8), [0]])))
            froms += (first + turns[::2]).tolist()
            tos += (first + turns[1::2] - 1 + length).tolist()
    removed, runs, at, kept = 0, 0, 0, []
    for a, e in sorted(zip(froms, tos)):
        if a > at or not runs:
            kept.append(raw[at:a])
            runs += 1
            at = a
        removed += max(0, e - at)
        at = max(at, e)
    return removed, runs, b"".join(kept) + raw[at:]


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, id_col: str = "doc_id",
                    text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256;
    ``with_bytes`` adds what is left, as bytes (a cut may split a character)."""
    if not 0 < gram <= length:
        raise ValueError("a gram is no longer than a run")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    listed = materialize(stretches(docs, length, gram), "stretches")
    marks = marked(docs, listed, length, most).select(
        F.col("anchor").alias("__anchor"), F.col("digest").alias("__digest"), "marks")
    places = listed.join(marks, (F.col("anchor") == F.col("__anchor")) & (F.col("digest") == F.col("__digest"))) \
        .groupBy(F.col("text").alias("__text")).agg(F.collect_set(F.struct("place", "digest", "marks")).alias("held"))
    rows = _packed(docs).join(places, F.col("key") == F.col("__text"), "left").select("doc_id", "body", "held")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    names = T._parse_datatype_string(schema).names

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(BATCH_ROWS, it):
            out = []
            for doc, raw, held in zip(b.column(0).to_pylist(), _unpacked(b.column(1)), b.column(2).to_pylist()):
                removed, runs, kept = _covered(raw, held, length) if held else (0, 0, raw)
                out.append((doc, len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out))
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(cols, types))[:len(names)]], names)

    return rows.mapInArrow(run, schema)
