"""Packing documents into windows by Karmarkar-Karp multiway differencing.

Each task takes its scan split: documents become token ids plus an end id, full
windows are cut off, the rest is cut into grains and collected until a group of
windows can be filled. Tiny pieces that follow each other are joined into runs
of at most a grain and placed as one, so a group has a bounded number of sizes
however short its documents are. Differencing then merges partial partitions with
opposing imbalances until one partition with near-equal windows is left; while
its largest window exceeds the capacity, the window count rises and the group
is differenced anew. Groups are of fixed size and nothing is shuffled, so
memory is one group and one batch, a hot source stays spread, and a lost task
is simply read again (sequence ids follow from split and position).

Defined results: null or empty text: the end id alone. Repeated rows and null
ids are packed like any others. Very long texts: whole, in full windows.
Empty tables: no pieces. Only id and text are read, so other columns cannot
clash.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sitelens.llm.common import batches_of

WINDOW = 2048
END_ID = 1
GRAIN = 256          # a rest is cut into pieces of at most so many ids
GROUP_WINDOWS = 256  # windows that are differenced together
SLACK = 2            # ids per window that a group leaves free at first
BATCH_ROWS = 64

_ENCODERS: dict[str, object] = {}


class Encoder:
    """Ids of the byte-level BPE vocabulary in ``path``. The ``.tiktoken`` file
    beside it holds the same vocabulary as ranks; that reader is several times
    faster and its ids are the same (tested). Texts that it refuses go to the
    reference reader."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.path, self.slow = path, None
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={"<|endoftext|>": len(ranks)})

    def __call__(self, text: str) -> np.ndarray:
        try:
            return np.array(self.fast.encode(text, allowed_special="all"), np.uint32)
        except (ValueError, UnicodeError):
            if self.slow is None:
                from tokenizers import Tokenizer
                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def differenced(sizes: list[int], k: int) -> np.ndarray:
    """Window (0..k-1) of each size by multiway differencing. A partial
    partition is a descending vector of k window loads less the smallest; the
    two with the widest spread are merged largest load on smallest, until one is
    left. The merges are kept as slot mappings and read back from the root."""
    n = len(sizes)
    if k == 1 or n <= 1:
        return np.zeros(n, np.int64)
    loads: dict[int, np.ndarray] = {}
    merges: list[tuple[int, int, np.ndarray]] = []
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    single = np.zeros(k, np.int64)

    def vector(i: int) -> np.ndarray:
        if i < n:
            v = single.copy()
            v[0] = sizes[i]
            return v
        return loads.pop(i)

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = vector(a) + vector(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        slot = np.empty(k, np.int64)
        slot[order] = np.arange(k)
        node = n + len(merges)
        merges.append((a, b, slot))
        loads[node] = both
        heapq.heappush(heap, (-int(both[0]), node))
    place: dict[int, np.ndarray] = {n + len(merges) - 1: np.arange(k)}
    out = np.zeros(n, np.int64)
    for i in range(len(merges) - 1, -1, -1):
        a, b, slot = merges[i]
        to = place.pop(n + i)[slot]
        for child, slots in ((a, to), (b, to[::-1])):
            if child < n:
                out[child] = slots[0]
            else:
                place[child] = slots
    return out


def fill(sizes: list[int], capacity: int) -> np.ndarray:
    """Windows for the sizes: as few as differencing can keep within capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        window = differenced(sizes, k)
        if np.bincount(window, weights=sizes, minlength=k).max(initial=0) <= capacity:
            return window
        k += 1


class _Packer:
    """Pieces of one task: (id, start, ids, doc_tokens), grouped and differenced."""

    def __init__(self, first_sequence: int, window: int, grain: int, group_windows: int):
        self.next, self.window, self.grain = first_sequence, window, min(grain, window)
        self.room = self.budget = group_windows * (window - min(SLACK, window - 1))
        self.pieces: list[tuple] = []
        self.rows: list[list] = [[] for _ in range(8)]

    def row(self, piece: tuple, sequence: int, offset: int) -> None:
        doc, start, ids, total = piece
        for col, v in zip(self.rows, (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence,
                                      offset, ids)):
            col.append(v)

    def add(self, doc, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.window:
            self.row((doc, at, ids[at:at + self.window], total), self.next, 0)
            self.next += 1
            at += self.window
        while at < total:
            size = min(self.grain, total - at, self.room)
            self.pieces.append((doc, at, ids[at:at + size], total))
            at += size
            self.room -= size
            if not self.room:
                self.flush()

    def flush(self) -> None:
        if self.pieces:
            runs, run = [0], []  # ids of each run, and the run of each piece
            for piece in self.pieces:
                if runs[-1] + len(piece[2]) > self.grain:
                    runs.append(0)
                runs[-1] += len(piece[2])
                run.append(len(runs) - 1)
            window = fill(runs, self.window)[run]
            offset = dict.fromkeys(window.tolist(), 0)
            name = {w: self.next + i for i, w in enumerate(offset)}
            for piece, w in zip(self.pieces, window.tolist()):
                self.row(piece, name[w], offset[w])
                offset[w] += len(piece[2])
            self.next += len(name)
        self.pieces, self.room = [], self.budget

    def take(self, with_ids: bool) -> pa.RecordBatch:
        types = [pa.int64()] * 7
        cols = [pa.array(c, t) for c, t in zip(self.rows, types)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            flat = self.rows[7]
            offsets = np.zeros(len(flat) + 1, np.int32)
            np.cumsum([len(x) for x in flat], out=offsets[1:])
            values = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
            names.append("ids")
        self.rows = [[] for _ in range(8)]
        return pa.RecordBatch.from_arrays(cols, names)


PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, end_id: int = END_ID, grain: int = GRAIN,
                   group_windows: int = GROUP_WINDOWS, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's token ids themselves.
    ``tokenizer`` is the vocabulary file's path on every executor."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = _Packer(TaskContext.get().partitionId() << 33, window, grain, group_windows)
        for b in batches_of(BATCH_ROWS, it):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                packer.add(doc, np.append(encode(text or ""), np.uint32(end_id)))
            yield packer.take(with_ids)
        packer.flush()
        yield packer.take(with_ids)

    from pyspark.sql import functions as F
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))
