"""Benchmark decontamination by q-gram filtering and banded alignment.

Every character of a benchmark item starts a passage, so an excerpt is found at
any offset: the item's characters from there on, 100 of them (an item of fewer
characters is one passage). A passage of n characters that occurs in a document
with at most k edits shares at least n + 1 - q - k*q character q-grams with it,
all on diagonals (position in the document less position in the item) that lie
within a band. Shared q-grams are posted once per position of an item and
counted per item and diagonal band; bands overlap, so every range of k + 1
diagonals lies in one whole. In a band that meets the count, the q-grams of item
and document are held against each other along the band's diagonals, and the
starts with so many shared q-grams among their positions are verified by banded
alignment, all starts of a run at once.

Memory: (place, posting) pairs are counted in slices of a bounded number. A q-gram
that an item holds very often (repetitive text) is not laid out: each of its places
counts, as often as it could, for all bands between its first and last posting.
That can only add bands, which the diagonals then decide.

The shortest verbatim run that is always found, whatever its offset and what
surrounds it: n - k characters of an item, 92 of an item of 100 or more (the
passage's other characters are the edits).

The benchmark is a stated query set: its size is read first, and beyond
``BLOCK_CHARS`` it is taken in blocks of items, each a pass over the documents.
Documents are scanned where they lie (no shuffle), so copies and hot sources do
not meet; a document goes through whole, in pieces that overlap by more than a
passage.

Defined results: texts are compared lower-cased with every run of other
characters than letters and digits as one blank. Null or empty texts and items:
no match. Items under ``LEAST_CHARS`` must occur whole and exactly, between
word ends. Repeated rows and null ids keep one decision each. Empty tables: no
matches. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import batches_of

Q = 9                # characters per gram
PASSAGE = 100        # characters per passage
EDIT_RATE = 0.08     # edits allowed per character of a passage
BAND = 16            # diagonals per band; two grids of bands, half a band apart
LEAST_CHARS = 40     # shorter items must match exactly
BLOCK_CHARS = 1 << 20
SCAN_CHARS = 1 << 18  # characters of documents that are scanned at a time
FILTER_BITS = 22
BATCH_ROWS = 512
RUN = 4096           # passages of an item that are aligned at a time
DENSE = 32           # positions of one q-gram in one item that are laid out
PAIRS = 1 << 21      # (place, posting) pairs that are counted at a time

OTHER = re.compile(r"[\W_]+")
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)


def normalised(text: str | None) -> str:
    return OTHER.sub(" ", (text or "").lower()).strip()


def _grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for i in range(q):
        out *= _BASE
        out += codes[i:i + n]
    out ^= out >> U64(32)
    out *= U64(0xBF58476D1CE4E5B9)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)


class Passages:
    """(item number, start in the item, text) of every passage, cut when read."""

    def __init__(self, items: list[str], size: np.ndarray):
        self.items, self.size = items, size
        starts = np.where(size > 0, np.array([len(t) for t in items], np.int64) - size + 1, 0)
        self.first = np.append(0, np.cumsum(starts))

    def __len__(self) -> int:
        return int(self.first[-1])

    def __getitem__(self, i: int) -> tuple[int, int, str]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        item = int(np.searchsorted(self.first, i, side="right")) - 1
        at = i - int(self.first[item])
        return item, at, self.items[item][at:at + int(self.size[item])]


@dataclass
class Index:
    """Postings of all items: gram -> (item, position)."""
    passages: Passages
    codes: list[np.ndarray]               # of each item, its characters
    size: np.ndarray                      # characters of each item's passages, 0: none
    edits: np.ndarray                     # budget of each item's passages
    least: np.ndarray                     # shared grams that the budget leaves
    grams: np.ndarray                     # sorted distinct grams
    first: np.ndarray                     # of each gram, its postings from .. to
    item: np.ndarray
    position: np.ndarray
    dense_first: np.ndarray               # of each gram, its entries below from .. to:
    dense: np.ndarray                     # rows of item, first and last position, where an item holds it often
    item_grams: list[np.ndarray]          # of each item, its grams by position
    bits: np.ndarray
    short: object                         # automaton of the short items, exact matches; None without them

    @classmethod
    def of(cls, items: list[str]) -> Index:
        short: dict[str, list[int]] = {}
        for n, text in enumerate(items):
            if text and len(text) < LEAST_CHARS:
                short.setdefault(text, []).append(n)
        size = np.array([min(len(t), PASSAGE) if len(t) >= LEAST_CHARS else 0 for t in items], np.int64)
        edits = (size * EDIT_RATE).astype(np.int64)
        codes = [_codes(t) for t in items]
        rows = [_grams(c if n else c[:0]) for c, n in zip(codes, size)]
        flat = np.concatenate(rows) if rows else np.zeros(0, U64)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows]) if rows else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(r)) for r in rows]) if rows else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        grams, gram = np.unique(flat[order], return_inverse=True)
        owner, place = owner[order], place[order]
        # postings lie by gram, item and position
        heads = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1]))) if len(gram) else gram
        count = np.diff(np.append(heads, len(gram)))
        often = count > DENSE
        dense = np.stack([owner[heads[often]], place[heads[often]], place[heads[often] + count[often] - 1]])
        every = np.arange(len(grams) + 1)
        dense_first = np.searchsorted(gram[heads[often]], every)
        laid = ~np.repeat(often, count)
        first = np.searchsorted(gram[laid], every)
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[(grams >> U64(64 - FILTER_BITS)).astype(np.int64)] = True
        automaton = None
        if short:
            import ahocorasick
            automaton = ahocorasick.Automaton()
            for text, numbers in short.items():
                automaton.add_word(f" {text} ", numbers)
            automaton.make_automaton()
        return cls(Passages(items, size), codes, size, edits, size + 1 - Q - edits * Q, grams,
                   first, owner[laid], place[laid], dense_first, dense, rows, bits, automaton)


def within(passage: str, region: str, budget: int) -> int | None:
    """Least edits with which the passage occurs in the region, if at most
    ``budget``: alignment whose start and end in the region are free. Only
    cells whose cost can still be within the budget are kept."""
    if passage in region:
        return 0
    width = len(region)
    row = np.zeros(width + 1, np.int64)
    text = np.frombuffer(region.encode("utf-32-le", "surrogatepass"), np.uint32)
    steps = np.arange(width + 1)
    for i, c in enumerate(passage, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != ord(c)), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps  # insertions along the row
        if row.min() > budget:
            return None
    return int(row.min())


def run_edits(item: np.ndarray, doc: np.ndarray, first: int, last: int, size: int, low: int, budget: int) -> np.ndarray:
    """Least edits of the passages that start at ``first`` .. ``last`` of the
    item, where they occur in the document on the diagonals of the band at
    ``low``, give or take the budget; more than the budget is any larger number.
    One table of cells per passage, all filled step by step together."""
    rows, starts = BAND + 2 * budget, last - first + 1
    wide = starts + size - 1
    at = low - budget + first
    # characters beyond the document's ends equal none, so they cost what leaving them out costs
    part = np.zeros(wide + rows - 1, doc.dtype)
    a, b = max(0, at), min(len(doc), at + len(part))
    if a < b:
        part[a - at:b - at] = doc[a:b]
    other = np.lib.stride_tricks.sliding_window_view(part, wide) != item[first:first + wide]
    steps = np.arange(rows, dtype=np.int16)[:, None]
    cells = np.zeros((rows, starts), np.int16)
    for i in range(size):
        new = cells + other[:, i:i + starts]
        np.minimum(new[:-1], cells[1:] + 1, out=new[:-1])  # the passage's character is left out
        cells = np.minimum.accumulate(new - steps, axis=0) + steps  # insertions along the rows
        if i % 16 == 15 and cells.min() > budget:
            break
    return cells.min(axis=0)


def along(item: np.ndarray, doc: np.ndarray, low: int) -> np.ndarray:
    """Positions of the item's grams that the document holds on the diagonals of
    the band at ``low``, in order, once for each."""
    wide = len(item)
    part = np.zeros(wide + BAND - 1, U64)
    held = np.zeros(len(part), bool)
    a, b = max(0, low), min(len(doc), low + len(part))
    if a < b:
        part[a - low:b - low], held[a - low:b - low] = doc[a:b], True
    equal = (np.lib.stride_tricks.sliding_window_view(part, wide) == item) & np.lib.stride_tricks.sliding_window_view(held, wide)
    return np.repeat(np.arange(wide), equal.sum(axis=0))


def matches_in(texts: list[str], index: Index) -> list[dict[int, tuple[int, int]]]:
    """Per normalised text: item -> (passages found, least edits). Texts are
    laid end to end with a gap that no gram can cross."""
    found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
    for n, text in enumerate(texts):
        if index.short is not None and text:
            for _, numbers in index.short.iter(f" {text} "):
                found[n] |= dict.fromkeys(numbers, (1, 0))
    if not len(index.grams):
        return found
    pieces, at = [], 0
    over = PASSAGE + 4 * BAND  # pieces of a long text overlap by more than a match
    for n, text in enumerate(texts):
        for start in range(0, max(1, len(text)), SCAN_CHARS):
            pieces.append((n, text[start:start + SCAN_CHARS + over]))
    batch: list[tuple[int, int, str]] = []
    half = BAND // 2
    longest = max(len(c) for c in index.codes)

    def scan() -> None:
        codes = _codes("\0".join(p for _, _, p in batch))
        grams = _grams(codes)
        spots = np.flatnonzero(index.bits[(grams >> U64(64 - FILTER_BITS)).astype(np.int64)])
        which = np.searchsorted(index.grams, grams[spots])
        hit = index.grams[np.minimum(which, len(index.grams) - 1)] == grams[spots]
        spots, which = spots[hit], which[hit]
        if not len(spots):
            return
        starts = np.array([s for s, _, _ in batch])
        piece = np.searchsorted(starts, spots, side="right") - 1
        halves = (len(codes) + longest) // half + 2
        kinds, n = counted(spots, which, piece, halves)
        follows = np.append(kinds[1:] == kinds[:-1] + 1, False)  # the band's second half has grams too
        both = n + np.where(follows, np.append(n[1:], 0), 0)
        bands = np.flatnonzero(both >= np.maximum(1, index.least[kinds // halves % len(index.codes)]))
        for k in kinds[bands].tolist():
            j, item = divmod(k // halves, len(index.codes))
            start, n, body = batch[j]
            best = seen.get((n, item))
            if best is None or best.any():
                low = k % halves * half - longest - start
                shared = along(index.item_grams[item], grams[start:start + max(0, len(body) - Q + 1)], low)
                verify(n, item, body, codes[start:start + len(body)], low, shared)

    def counted(spots: np.ndarray, which: np.ndarray, piece: np.ndarray, halves: int) -> tuple[np.ndarray, np.ndarray]:
        """(piece, item, half band) numbers in order, and at least as many as the grams shared in each."""
        items = len(index.codes)
        counts = index.first[which + 1] - index.first[which]
        ends = np.cumsum(counts)
        kinds, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]) + PAIRS, PAIRS), side="right")
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            c = counts[a:b]
            posting = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(index.first[which[a:b]], c)
            key = np.repeat(piece[a:b] * items, c) + index.item[posting]
            key = key * halves + (np.repeat(spots[a:b], c) - index.position[posting] + longest) // half
            k, m = np.unique(key, return_counts=True)
            kinds.append(k)
            sums.append(m)
        # grams that an item holds often: all half bands between the first and the last position
        often = index.dense_first[which + 1] - index.dense_first[which]
        hot = np.flatnonzero(often)
        if len(hot):
            c = often[hot]
            entry = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(index.dense_first[which[hot]], c)
            item, first, last = index.dense[:, entry]
            spot = np.repeat(spots[hot], c)
            group = np.repeat(piece[hot] * items, c) + item
            low, high = (spot - last + longest) // half, (spot - first + longest) // half
            by = np.argsort(group, kind="stable")
            names, froms = np.unique(group[by], return_index=True)
            for g, rows in zip(names.tolist(), np.split(by, froms[1:])):
                steps = np.bincount(low[rows], minlength=halves + 1) - np.bincount(high[rows] + 1, minlength=halves + 1)
                level = np.cumsum(steps) * half
                at = np.flatnonzero(level)
                kinds.append(g * halves + at)
                sums.append(level[at])
        kinds, sums = np.concatenate(kinds), np.concatenate(sums)
        names, to = np.unique(kinds, return_inverse=True)
        total = np.zeros(len(names), np.int64)
        np.add.at(total, to, sums)
        return names, total

    def verify(n: int, item: int, body: str, doc: np.ndarray, low: int, position: np.ndarray) -> None:
        """Runs of starts with enough of the shared grams, at ``position``, among their own."""
        size, budget, least = int(index.size[item]), int(index.edits[item]), max(1, int(index.least[item]))
        text, last = index.passages.items[item], len(index.codes[item]) - size
        if len(position) < least:
            return
        lowest, highest = position[:len(position) - least + 1], position[least - 1:]
        enough = highest - lowest <= size - Q
        froms, tos = np.maximum(0, highest[enough] - (size - Q)), np.minimum(last, lowest[enough])
        if not len(froms):
            return
        apart = np.flatnonzero(froms[1:] > tos[:-1] + 1)
        for first, end in zip(froms[np.append(0, apart + 1)].tolist(), tos[np.append(apart, len(tos) - 1)].tolist()):
            for s in range(first, end + 1, RUN):
                e = min(end, s + RUN - 1)
                best = seen.get((n, item))
                if best is not None:  # passages that have been found whole cannot be found better
                    left = np.flatnonzero(best[s:e + 1])
                    if not len(left):
                        continue
                    s, e = s + int(left[0]), s + int(left[-1])
                region = body[max(0, low - budget + s):max(0, low + BAND + e + size + budget)]
                if text[s:e + size] in region:
                    edits = np.zeros(e - s + 1, np.int16)
                elif s == e:
                    got = within(text[s:s + size], region, budget)
                    edits = np.array([budget + 1 if got is None else got], np.int16)
                else:
                    edits = run_edits(index.codes[item], doc, s, e, size, low, budget)
                if edits.min() <= budget:
                    if best is None:
                        best = seen[n, item] = np.full(last + 1, size, np.int16)
                    np.minimum(best[s:e + 1], edits, out=best[s:e + 1])

    seen: dict[tuple[int, int], np.ndarray] = {}  # least edits of each passage of the item
    for n, piece in pieces:
        if batch and at + len(piece) > SCAN_CHARS:
            scan()
            batch, at = [], 0
        batch.append((at, n, piece))
        at += len(piece) + 1
    if batch:
        scan()
    for (n, item), edits in seen.items():
        found[n][item] = (int((edits <= index.edits[item]).sum()), int(edits.min()))
    return found


def _indexes(benchmark: DataFrame, item_col: str, text_col: str):
    """Blocks of the query set: (item ids, index) of a bounded number of characters each."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS)
    for b in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        yield [r["item"] for r in got], Index.of([normalised(r["text"]) for r in got])


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row and benchmark item found in it: id, item_id,
    n_passages (how many passages of the item) and edits (least of them)."""
    def scan(items: list[int], index: Index):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches_of(BATCH_ROWS, it):
                rows = []
                found = matches_in([normalised(t) for t in b.column(1).to_pylist()], index)
                for doc, hits in zip(b.column(0).to_pylist(), found):
                    rows += [(doc, items[i], n, e) for i, (n, e) in sorted(hits.items())]
                cols = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 ["id", "item_id", "n_passages", "edits"])
        return run

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, item_id long, n_passages long, edits long"
    out = source.sparkSession.createDataFrame([], schema)
    for n, (items, index) in enumerate(_indexes(benchmark, item_col, item_text_col)):
        part = source.mapInArrow(scan(items, index), schema)
        out = part if n == 0 else out.unionByName(part)
    return out.withColumnRenamed("id", id_col)


def without_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                          item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark passage is found."""
    def keep(index: Index):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches_of(BATCH_ROWS, it):
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                found = matches_in([normalised(t) for t in texts], index)
                yield b.filter(pa.array([not f for f in found], pa.bool_()))
        return run

    for _, index in _indexes(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(keep(index), docs.schema)
    return docs
