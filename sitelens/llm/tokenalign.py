"""Alignment of two tokenizers over a corpus, with inverted pair bitmaps.

Both tokenizers cut the same bytes, a blank and the text. Where a token of each
ends at one byte, both sequences are cut into groups; all tokens of A and B in a
group are linked. Every linked id pair has postings: per container of documents
(consecutive documents of a task, at most 65,536) a compressed bitmap of the
documents that hold the pair, and planes with the bits of its further occurrences,
so that multiplicity m is 1 + sum of 2^k over the planes that hold the document.
Few documents are stored as 16-bit numbers, many as bits, whichever is shorter. A
container's bitmaps are OR-merged from its batches; their popcounts, summed over
the containers, are a pair's document count, popcounts times plane weights its link
count. Scores of pairs (count, best of the A id) go back along the postings: they
join the containers, where each bit of a plane adds its weighted score to its
document.

Texts are cut before blanks that follow another character: both tokenizers begin
a token there (checked on B's vocabulary; otherwise a text stays whole), so
each distinct piece is encoded and aligned once while it is in a worker's
bounded cache, and a group never crosses a cut.

Defined results: null and empty texts, and texts whose joined A or B bytes differ
from blank + text, have no tokens: zeros and an empty group text. Repeated rows
and null ids are rows like any others. Very long texts: whole, in one container
of their own if need be. Empty table: no rows. Only id and text are read, so other
columns cannot clash.

Hot pairs: a pair that every document holds has one row per container, however
often it occurs; the join is of two tables, so adaptive execution splits it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import batches_of
from sitelens.llm.pack import encoder
from sitelens.session import materialize

CONTAINER_DOCS = 1 << 16
CONTAINER_CHARS = 12 << 20   # a container ends with the document that reaches so many characters
BATCH_ROWS = 256
CACHED_PIECES = 200_000
CACHED_CHARS = 8 << 20
OUTER = 4096                 # groups with more links are counted by distinct ids

_CUT = re.compile(r"(?<=\S) (?=.)", re.DOTALL)
_BEFORE_BLANK = tuple(chr(c) + " " for c in range(0x3001) if chr(c).isspace())
_ALIGNERS: dict[tuple, "Aligner"] = {}


def pieces_of(text: str) -> list[str]:
    """The text cut at blanks that follow a non-blank and are not last; the blank itself goes."""
    if text[0] == " " or text[-1] == " " or any(b in text for b in _BEFORE_BLANK):
        return _CUT.split(text)
    return text.split(" ")


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(first, count)


class Aligner:
    """Two tokenizers and the aligned pieces of late. ``groups[i]`` is the text
    of piece i's groups, its pairs are ``pair[first[i]:first[i + 1]]``."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        enc = encoder(path_a).fast
        self.a = enc.encode_ordinary
        self.path_a, self.slow = path_a, None
        self.bytes_a = [enc.decode_single_token_bytes(i) if i != enc.eot_token else b"" for i in range(enc.n_vocab)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.cuts = not any("▁" in n.lstrip("▁") for n in names)
        self.bytes_b = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode()
                        for i, n in enumerate(names)]
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        ids = [str(i) for i in range(len(self.bytes_a))] + [str(i) for i in range(len(self.bytes_b))]
        self.shown = [i + sep for sep in ",|;" for i in ids]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str | None] = []  # None: the bytes differ
        self.tallies: list[np.ndarray] = []  # per piece: tokens of A, of B, groups, links, distinct pairs
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.chars = 0

    def ids_a(self, text: str) -> list[int]:
        try:
            return self.a(text)
        except (ValueError, UnicodeError):
            if self.slow is None:
                from tokenizers import Tokenizer
                self.slow = Tokenizer.from_file(self.path_a)
                self.slow.encode_special_tokens = True
            return self.slow.encode(text, add_special_tokens=False).ids

    def learn(self, pieces: list[str]) -> None:
        """Encode and align pieces that are not in the cache."""
        cut_a = [self.ids_a(" " + p) for p in pieces]
        cut_b = self.b.encode(pieces, num_threads=1)
        same = []
        for p, x, y in zip(pieces, cut_a, cut_b):
            raw = b" " + p.encode()
            same.append(b"".join(map(self.bytes_a.__getitem__, x)) == raw and b"".join(map(self.bytes_b.__getitem__, y)) == raw)
        cut_a = [x if ok else [] for x, ok in zip(cut_a, same)]
        cut_b = [y if ok else [] for y, ok in zip(cut_b, same)]
        n_a, n_b = (np.array([len(x) for x in c], np.int64) for c in (cut_a, cut_b))
        flat_a, flat_b = (np.fromiter((i for x in c for i in x), np.int64) for c in (cut_a, cut_b))
        ends_a, ends_b = np.cumsum(self.length_a[flat_a]), np.cumsum(self.length_b[flat_b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        in_a, in_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        first_a = np.searchsorted(in_a, np.arange(len(common) + 1))
        first_b = np.searchsorted(in_b, np.arange(len(common) + 1))
        of_a = np.repeat(np.arange(len(pieces)), n_a)
        owner = of_a[first_a[:-1]]
        wide_a, wide_b = np.diff(first_a), np.diff(first_b)
        links = wide_a * wide_b
        self._show(pieces, same, flat_a, flat_b, in_a, in_b, first_a, first_b, n_a + n_b)
        # pairs: small groups at once, others by their distinct ids
        small = np.flatnonzero(links <= OUTER)
        group = np.repeat(small, links[small])
        within = spread(np.zeros(len(small), np.int64), links[small])
        pair = flat_a[first_a[group] + within // wide_b[group]] * len(self.bytes_b) + flat_b[first_b[group] + within % wide_b[group]]
        unit, times = owner[group], np.ones(len(group), np.int64)
        for g in np.flatnonzero(links > OUTER):
            x, k = np.unique(flat_a[first_a[g]:first_a[g + 1]], return_counts=True)
            y, m = np.unique(flat_b[first_b[g]:first_b[g + 1]], return_counts=True)
            pair = np.append(pair, (x[:, None] * len(self.bytes_b) + y).ravel())
            times = np.append(times, (k[:, None] * m).ravel())
            unit = np.append(unit, np.full(len(x) * len(y), owner[g]))
        pair, unit, times = summed(pair, unit, times)
        order = np.argsort(unit, kind="stable")
        count = len(pieces)
        self.tallies.append(np.stack([n_a, n_b, np.bincount(owner, minlength=count),
                                      np.bincount(owner, weights=links, minlength=count).astype(np.int64),
                                      np.bincount(unit, minlength=count)]))
        self.runs.append((pair[order], times[order]))
        for p in pieces:
            self.number[p] = len(self.number)
            self.chars += len(p)

    def _show(self, pieces, same, flat_a, flat_b, in_a, in_b, first_a, first_b, sizes) -> None:
        """Texts of the groups: A ids, a bar, B ids; groups apart by semicolons."""
        both, ids = len(self.bytes_a) + len(self.bytes_b), np.empty(len(flat_a) + len(flat_b), np.int64)
        last_a, last_b = np.append(in_a[1:] != in_a[:-1], True), np.append(in_b[1:] != in_b[:-1], True)
        if len(flat_a):
            ids[np.arange(len(flat_a)) + first_b[in_a]] = flat_a + np.where(last_a, both, 0)
            ids[np.arange(len(flat_b)) + first_a[in_b + 1]] = flat_b + len(self.bytes_a) + np.where(last_b, 2 * both, 0)
        parts, at = list(map(self.shown.__getitem__, ids.tolist())), 0
        for ok, n in zip(same, sizes.tolist()):
            self.groups.append("".join(parts[at:at + n])[:-1] if ok else None)
            at += n

    def align(self, texts: list[str | None]):
        """Per text: its groups' text (none: no tokens) and tallies; and all its
        (pair, text number, multiplicity), sorted, a pair once per text."""
        cut = [(pieces_of(t) if self.cuts else [t]) if t else [] for t in texts]
        wanted = set().union(*cut)
        if len(self.number) + len(wanted) > CACHED_PIECES or self.chars > CACHED_CHARS:
            self.forget()
        fresh = sorted(wanted.difference(self.number))
        if fresh:
            self.learn(fresh)
        if len(self.tallies) > 1:
            self.tallies = [np.concatenate(self.tallies, axis=1)]
            self.runs = [tuple(map(np.concatenate, zip(*self.runs)))]
        shown, tally, kept = [], np.zeros((4, len(texts)), np.int64), [[] for _ in texts]
        for n, c in enumerate(cut):
            at = list(map(self.number.__getitem__, c))
            groups = list(map(self.groups.__getitem__, at))
            whole = bool(at) and None not in groups
            shown.append(";".join(groups) if whole else "")
            if whole:
                kept[n] = at
        sizes = np.array([len(k) for k in kept], np.int64)
        at = np.fromiter((i for k in kept for i in k), np.int64)
        if not len(at):
            return shown, tally, (at, at, at)
        of = np.repeat(np.arange(len(texts)), sizes)
        for row, values in zip(tally, self.tallies[0]):
            np.add.at(row, of, values[at])
        distinct = self.tallies[0][4]
        first = np.cumsum(distinct) - distinct
        place = spread(first[at], distinct[at])
        pair, times = self.runs[0]
        return shown, tally, summed(pair[place], np.repeat(of, distinct[at]), times[place])


def summed(pair: np.ndarray, of: np.ndarray, times: np.ndarray):
    """Distinct (pair, number) in order, with the sum of ``times``."""
    if not len(pair):
        return pair, of, times
    key = (pair << 24) | of  # numbers are below 2 ** 24, pairs below 2 ** 39
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first] >> 24, key[first] & ((1 << 24) - 1), np.add.reduceat(times[order], first)


PLANES = pa.struct([("plane", pa.int32()), ("dense", pa.bool_()), ("bits", pa.binary())])


def bitmaps(pair: np.ndarray, slot: np.ndarray, times: np.ndarray, slots: int):
    """(pairs, documents of each, their planes) of sorted distinct (pair, slot).
    Plane 0 holds every document of the pair, plane k + 1 those whose further
    occurrences have bit k; planes without documents are left out."""
    heads = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
    which = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(pair))))
    code, further, k = [(which << 22) | slot], times - 1, 1
    while len(further) and (further >> (k - 1)).any():
        has = np.flatnonzero((further >> (k - 1)) & 1)
        code.append((which[has] << 22) | (k << 16) | slot[has])
        k += 1
    code = np.sort(np.concatenate(code))
    rows = code >> 16
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(rows)))
    as_bits = (slots + 7) // 8
    dense = counts * 2 > as_bits
    sizes = np.where(dense, as_bits, counts * 2)
    offsets = np.append(0, np.cumsum(sizes))
    data = np.zeros(int(offsets[-1]), np.uint8)
    few = np.flatnonzero(~dense)
    at = spread(starts[few], counts[few])
    to = np.repeat(offsets[:-1][few], counts[few]) + 2 * (at - np.repeat(starts[few], counts[few]))
    low = (code[at] & 0xFFFF).astype(np.uint16)
    data[to], data[to + 1] = low & 0xFF, low >> 8
    for r in np.flatnonzero(dense).tolist():
        flags = np.zeros(as_bits * 8, bool)
        flags[code[starts[r]:starts[r] + counts[r]] & 0xFFFF] = True
        data[offsets[r]:offsets[r + 1]] = np.packbits(flags, bitorder="little")
    bits = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    planes = pa.StructArray.from_arrays([pa.array((rows[starts] & 63).astype(np.int32)), pa.array(dense), bits], fields=list(PLANES))
    owner = rows[starts] >> 6
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(heads) + 1)).astype(np.int32)), planes)
    presence = np.searchsorted(owner, np.arange(len(heads)))
    return pair[heads], counts[presence], lists


def add_scores(planes: pa.ListArray, scores: list[np.ndarray], slots: int) -> list[np.ndarray]:
    """Per slot, the sum over all planes' bits of plane weight times the row's score."""
    totals = [np.zeros(slots, np.int64) for _ in scores]
    first = planes.offsets.to_numpy()
    flat = planes.values.slice(first[0], first[-1] - first[0])
    sizes = np.diff(first)
    row = np.repeat(np.arange(len(sizes)), sizes)
    level = flat.field("plane").to_numpy().astype(np.int64)
    weight = np.where(level == 0, 1, np.int64(1) << np.maximum(level - 1, 0))
    dense, bits = flat.field("dense").to_numpy(zero_copy_only=False).astype(bool), flat.field("bits")
    few = np.flatnonzero(~dense)
    if len(few):
        part = pa.concat_arrays([bits.take(pa.array(few))]).cast(pa.large_binary())
        offset = np.frombuffer(part.buffers()[1], np.int64)[:len(few) + 1]
        slot = np.frombuffer(part.buffers()[2], np.uint8)[offset[0]:offset[-1]].copy().view(np.uint16)
        counts = np.diff(offset) // 2
        for total, score in zip(totals, scores):
            np.add.at(total, slot, np.repeat(score[row[few]] * weight[few], counts))
    for r in np.flatnonzero(dense).tolist():
        held = np.unpackbits(np.frombuffer(bits[r].as_py(), np.uint8), bitorder="little")[:slots].astype(np.int64)
        for total, score in zip(totals, scores):
            total[:len(held)] += held * (score[row[r]] * weight[r])
    return totals


TALLIES = ["n_a", "n_b", "n_groups", "n_links"]
ALIGNED = ("container long, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "groups string, pair long, n_docs long, planes array<struct<plane:int,dense:boolean,bits:binary>>")


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
            with_groups: bool = False) -> DataFrame:
    """Rows of documents (container, slot, id, tallies, groups) and rows of
    postings (container, pair, n_docs, planes), the latter with a null slot."""
    fields = [("container", pa.int64()), ("slot", pa.int32()), ("doc_id", pa.int64()), *[(t, pa.int64()) for t in TALLIES],
              ("groups_sha256", pa.string()), ("groups", pa.string()), ("pair", pa.int64()), ("n_docs", pa.int64()),
              ("planes", pa.list_(PLANES))]

    def batch(n: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(n, t) for c, t in fields], [c for c, _ in fields])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path_a, path_b)
        if key not in _ALIGNERS:
            _ALIGNERS[key] = Aligner(*key)
        aligner, container = _ALIGNERS[key], TaskContext.get().partitionId() << 32
        held, slots, chars = [], 0, 0

        def postings() -> pa.RecordBatch:
            pair, slot, times = (np.concatenate(c) for c in zip(*held))
            order = np.argsort((pair << 16) | slot)  # the OR of the batches: no document is in two of them
            pairs, n_docs, planes = bitmaps(pair[order], slot[order], times[order], slots)
            return batch(len(pairs), container=pa.array(np.full(len(pairs), container)), pair=pa.array(pairs),
                         n_docs=pa.array(n_docs), planes=planes)

        for b in batches_of(BATCH_ROWS, it):
            texts = b.column(1).to_pylist()
            if slots + len(texts) > CONTAINER_DOCS or chars > CONTAINER_CHARS:
                yield postings()
                container, held, slots, chars = container + 1, [], 0, 0
            shown, tally, (pair, of, times) = aligner.align(texts)
            cols = {t: pa.array(v) for t, v in zip(TALLIES, tally)}
            if with_groups:
                cols["groups"] = pa.array(shown, pa.string())
            yield batch(len(texts), container=pa.array(np.full(len(texts), container)),
                        slot=pa.array(np.arange(slots, slots + len(texts), dtype=np.int32)), doc_id=b.column(0).cast(pa.int64()),
                        groups_sha256=pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown]), **cols)
            held.append((pair, of + slots, times))
            slots += len(texts)
            chars += sum(len(t) for t in texts if t)
        if held:
            yield postings()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ALIGNED)


def pair_scores(postings: DataFrame, ids_b: int) -> DataFrame:
    """(pair, n, best): in how many documents the pair is linked, and 1 if no
    other pair of its A id is in more. At most one row per A id is broadcast: the
    vocabulary bounds it."""
    counts = materialize(postings.groupBy("pair").agg(F.sum("n_docs").alias("n")), "pair-counts")
    of = F.expr(f"pair div {ids_b}")
    top = counts.groupBy(of.alias("__a")).agg(F.max("n").alias("__top"))
    return counts.join(F.broadcast(top), of == F.col("__a")).select(
        "pair", "n", (F.col("n") == F.col("__top")).cast("long").alias("best"))


def alignment_report(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                     with_groups: bool = False) -> DataFrame:
    """Per document: tallies, ``n_best`` (links whose pair is its A id's best),
    ``count_sum`` (document counts summed over links), the groups' digest and,
    if asked for, their text."""
    import sentencepiece
    ids_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    table = materialize(aligned(docs, path_a, path_b, id_col, text_col, with_groups), "aligned")
    postings = table.where(F.col("slot").isNull()).select("container", "pair", "n_docs", "planes")
    scores = pair_scores(postings, ids_b).withColumnRenamed("pair", "__pair")
    scored = postings.join(scores, F.col("pair") == F.col("__pair")).select(
        F.col("container").alias("__container"), "planes", "n", "best")
    names = ["doc_id", *TALLIES, "n_best", "count_sum", "groups_sha256"] + (["groups"] if with_groups else [])
    rows = table.where(F.col("slot").isNotNull()).select("container", "slot", "doc_id", *TALLIES, "groups_sha256",
                                                         *(["groups"] if with_groups else []))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        slot = left.column("slot").to_numpy()
        totals = [np.zeros(len(slot), np.int64)] * 2
        if right.num_rows:
            planes = pa.concat_arrays(right.column("planes").chunks)
            found = add_scores(planes, [right.column(c).to_numpy() for c in ("best", "n")], int(slot.max()) + 1)
            totals = [f[slot] for f in found]
        cols = {c: left.column(c) for c in left.column_names} | {"n_best": pa.array(totals[0]), "count_sum": pa.array(totals[1])}
        return pa.table([cols[c] for c in names], names=names)

    schema = ", ".join(f"{n} {'string' if n.startswith('groups') else 'long'}" for n in names)
    return rows.groupBy("container").cogroup(scored.groupBy("__container")).applyInArrow(score, schema)
