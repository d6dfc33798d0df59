"""N-gram Jaccard join with count-vector R-trees.

The n-grams of a document are hashed into groups. Two uses of the groups:

* Partition. Linked documents differ in at most t n-grams, so at most t groups
  differ and, in any order that follows from their content, one of the first
  t + 1 groups of either document is the same in both. Those groups, hashed with their content, are
  equi-join keys; documents connected by keys form a forest's plots, and no link
  crosses plots.
* Index. In each plot the group counts (16 coordinates) are points. They are
  packed into leaves with bounding boxes; a pair of leaves is joined only if the
  summed minima of the boxes' upper corners, an upper bound of any overlap, can
  reach the overlap needed. The same bound on the points' own counts prunes pairs
  in a leaf join, and the surviving pairs are verified on their whole sets.

One R-tree over all documents would be right too, but its boxes prune next to
nothing for hashed counts of unrelated texts; hence a forest.

Documents of equal sets are one class from the start, so copies never meet. A
leaf join returns a spanning forest of the links that it has found: at most one
row per document, however similar a group is. Every link between different sets
that lies inside a component already connected may be skipped; none that would
connect two components is.

Defined results: null text, empty text and texts without words: empty set, no
links, own component. Fewer words than the n-gram length: the whole sequence as
one n-gram. Repeated ids and rows: each row has its class's component. Null ids:
never a component's id unless it has no other, then null. Empty tables: no rows.
Very long texts: whole sets; a leaf is bounded in documents and in n-grams. Only
id and text are read, so other columns cannot clash. N-grams are compared as
64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import batches_of, unused
from sitelens.llm.graph import components
from sitelens.session import discard, materialize

WORDS, PERCENT = 4, 85
COORDINATES = 16
LEAF_DOCS = 1024
LEAF_NGRAMS = 1 << 19
BATCH_ROWS = 256
BLOCK_NGRAMS = 1 << 22   # n-grams that are counted together
CELL_BITS = 24           # one byte each: 16 MB in a task
COMMON_IN_BLOCK = 4      # times that a common n-gram comes up in a block, at least
MOST_COMMON = 1 << 17    # common n-grams that reach the driver and the tasks (1 MB)
BROADCAST_ROWS = 1 << 19  # ids: beyond this many the join is by shuffle

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WEIGHTS = np.random.default_rng(20240602).integers(1, 1 << 63, 64, dtype=U64) * U64(2) + U64(1)
_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS


def ngram_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams. Words are split at
    ASCII white space after lower-casing A-Z, on the UTF-8 bytes; their hashes
    are differences of one running polynomial sum."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, U64)
    lower = raw + np.where((raw >= 65) & (raw <= 90), 32, 0).astype(np.uint8)
    power, inverse = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((lower.astype(U64) + U64(1)) * power[:len(raw)], out=total[1:])
    word = _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U64))
    n = min(words, len(word))
    grams = np.full(len(word) - n + 1, n, U64)
    for i in range(n):
        grams += word[i:len(word) - n + 1 + i] * _WEIGHTS[i]
    return np.unique(_mix(grams))


def digest_of(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.astype("<u8").tobytes(), digest_size=16).digest()


def largest_partner(n: int, percent: int) -> int:
    return 100 * n // percent


def most_different(n: int, partner: int, percent: int) -> int:
    """N-grams that a set of n and a linked one of at most ``partner`` can differ in."""
    return (100 - percent) * (n + partner) // (100 + percent)


def schemes(n: int, percent: int) -> list[tuple[int, int]]:
    """(scheme, largest set) of every size scheme that a set of n takes part in.
    Scheme i is for pairs whose smaller set has 2**i to 2**(i+1) - 1 n-grams."""
    i = n.bit_length() - 1
    low = [(i - 1, largest_partner((1 << i) - 1, percent))] if i and n <= largest_partner((1 << i) - 1, percent) else []
    return [*low, (i, largest_partner((2 << i) - 1, percent))]


def partition_keys(grams: np.ndarray, percent: int = PERCENT, common: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the groups, with scheme and content, that a linked document
    must share one of: the first t + 1 in the order of how many n-grams outside
    ``common`` they hold, then of their size, then of their number. Any order
    that follows from a group's content is right; this one puts groups that
    unrelated documents share, from passages that many of them hold, last."""
    n, out = len(grams), []
    mixed = _mix(grams ^ U64(_BASE))
    rare = np.ones(n, bool)
    if common is not None and len(common):
        rare = common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] != grams
    for scheme, largest in schemes(n, percent) if n else []:
        t = most_different(n, min(largest, largest_partner(n, percent)), percent)
        groups = (most_different(largest, largest, percent) + 1) * 3 // 2 + 2
        group = ((mixed >> U64(32)) * U64(groups) >> U64(32)).astype(np.int64)
        size = np.bincount(group, minlength=groups)
        own = np.bincount(group[rare], minlength=groups)
        order = np.argsort(group, kind="stable")
        filled = np.flatnonzero(size)
        content = np.zeros(groups, U64)
        content[filled] = np.add.reduceat(mixed[order], np.concatenate([[0], np.cumsum(size[filled])[:-1]]))
        first = np.lexsort((-size, -own))[:t + 1]
        out.append(_mix(content[first] + _mix((first + groups * 1_000_003 + scheme).astype(U64) * U64(_BASE))))
    return np.concatenate(out) if out else np.zeros(0, U64)


def _counted(words: int):
    """N-grams that come up often within a block of documents, with the times
    seen from then on. One byte per cell counts hashes; only n-grams of cells
    that are full enough are kept by themselves."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, often, size = np.zeros(1 << CELL_BITS, np.uint8), Counter(), 0
        for b in batches_of(BATCH_ROWS, it):
            for text in b.column(0).to_pylist():
                grams = ngram_set(text, words)
                at = (grams >> U64(64 - CELL_BITS)).astype(np.int64)
                cells[at] = np.minimum(cells[at], 254) + 1
                often.update(grams[cells[at] >= COMMON_IN_BLOCK].view(np.int64).tolist())
                size += len(grams)
                if size >= BLOCK_NGRAMS:
                    cells.fill(0)
                    size = 0
            if len(often) >= MOST_COMMON:
                yield _tally(often)
                often.clear()
        yield _tally(often)
    return run


def _tally(often: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(often), pa.int64()), pa.array(list(often.values()), pa.int64())],
                                      ["gram", "n"])


def common_ngrams(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> np.ndarray:
    """Hashes of the corpus's most frequent n-grams, at most ``MOST_COMMON``,
    sorted. Every document is counted. They only order the partition keys: the
    links found do not depend on them."""
    top = docs.select(F.col(text_col).alias("text")).mapInArrow(_counted(words), "gram long, n long") \
        .groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(MOST_COMMON).select("gram").toArrow()
    return np.sort(top["gram"].to_numpy().view(U64))


def count_vector(grams: np.ndarray) -> np.ndarray:
    return np.bincount((grams & U64(COORDINATES - 1)).astype(np.int64), minlength=COORDINATES)


def _lists(rows: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows), kind))


def _described(words: int, percent: int, common: np.ndarray):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(BATCH_ROWS, it):
            sets = [ngram_set(t, words) for t in b.column(2).to_pylist()]
            digests = [digest_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()),
                _lists([count_vector(s) for s in sets], pa.int64()),
                _lists([partition_keys(s, percent, common).view(np.int64) for s in sets], pa.int64())],
                ["row", "id", "n", "digest", "class", "counts", "keys"])
    return run


def _sets(words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(BATCH_ROWS, it):
            sets = [ngram_set(t, words) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([digest_of(s) for s in sets], pa.binary()),
                                              pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())],
                                             ["digest", "grams"])
    return run


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def leaf_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two leaves, or within one
    (``right`` None), as positions in left + right. Each set is held against the
    sets that the bound on the count vectors leaves and that are not connected yet."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], np.int64)
    points = np.array([count_vector(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(ids.max()) + 1, bool)
    forest, out = _Forest(len(sets)), []
    root = np.arange(len(sets))
    for a in range(len(left)):
        others = np.arange(a + 1, len(sets)) if right is None else np.arange(len(left), len(sets))
        need = percent * (sizes[a] + sizes[others])  # 100 + percent times the least overlap
        bound = np.minimum(points[a], points[others]).sum(axis=1)
        near = others[((100 + percent) * bound >= need) & (root[others] != root[a])]
        if not len(near):
            continue
        own = ids[begin[a]:begin[a + 1]]
        mark[own] = True
        hits = mark[np.concatenate([ids[begin[x]:begin[x + 1]] for x in near])]
        common = np.add.reduceat(hits, np.concatenate([[0], np.cumsum(sizes[near])[:-1]]), dtype=np.int64)
        mark[own] = False
        found = [(a, x) for x in near[(100 + percent) * common >= percent * (sizes[a] + sizes[near])].tolist()
                 if forest.join(a, x)]
        if found:
            out += found
            root = np.array([forest.find(x) for x in range(len(sets))])
    return out


def _joined_leaves(percent: int):
    """Rows of one unit (a pair of leaves) come together, sorted by unit; units
    are handled one after the other."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sides = None, [{}, {}]

        def links() -> pa.RecordBatch:
            names = list(sides[0]) + list(sides[1])
            sets = [[np.frombuffer(g, "<u8") for g in side.values()] for side in sides]
            pairs = leaf_links(sets[0], sets[1] or None, percent) if sets[0] else []
            return pa.RecordBatch.from_arrays([pa.array([names[a] for a, _ in pairs], pa.binary()),
                                               pa.array([names[b] for _, b in pairs], pa.binary())], ["a", "b"])

        for b in batches_of(BATCH_ROWS, it):
            for u, side, digest, grams in zip(*(b.column(c).to_pylist() for c in ("unit", "side", "digest", "grams"))):
                if u != unit:
                    if unit is not None:
                        yield links()
                    unit, sides = u, [{}, {}]
                sides[side][digest] = grams
        if unit is not None:
            yield links()
    return run


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast up to a stated number of narrow rows, else left to a shuffle join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _leaves(members: DataFrame) -> DataFrame:
    """Adds ``leaf``: a plot's sets in the order of their size, cut into runs of
    a leaf's capacity. Positions come from a small table of sizes per plot, so a
    large plot is not sorted in one task; a size with more sets than a leaf holds
    is split evenly."""
    sizes = members.groupBy("plot", "n").agg(F.count("*").alias("docs"))
    before = Window.partitionBy("plot").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        "plot", "n", F.coalesce(F.floor(F.sum("docs").over(before) / LEAF_DOCS), F.lit(0)).alias("by_docs"),
        F.coalesce(F.floor(F.sum(F.col("docs") * F.col("n")).over(before) / LEAF_NGRAMS), F.lit(0)).alias("by_ngrams"),
        F.greatest(F.ceil(F.col("docs") / LEAF_DOCS), F.ceil(F.col("docs") * F.col("n") / LEAF_NGRAMS)).alias("parts"))
    run = F.xxhash64(F.lit("run"), "by_docs", "by_ngrams")
    part = F.xxhash64(F.lit("part"), "n", F.pmod(F.xxhash64("digest"), F.col("parts")))
    return members.join(sizes, ["plot", "n"]).withColumn("leaf", F.when(F.col("parts") > 1, part).otherwise(run)) \
        .drop("by_docs", "by_ngrams", "parts")


def _units(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of leaves whose boxes can hold a link, with a unit number each."""
    boxes = members.groupBy("plot", "leaf").agg(
        F.count("*").alias("docs"), F.min("n").alias("low"), F.max("n").alias("high"),
        *[F.max(F.col("counts")[i]).alias(f"c{i}") for i in range(COORDINATES)])
    a, b = boxes.alias("a"), boxes.alias("b")
    overlap: Column = sum((F.least(F.col(f"a.c{i}"), F.col(f"b.c{i}")) for i in range(COORDINATES)), F.lit(0))
    reach = ((100 + percent) * overlap >= percent * (F.col("a.low") + F.col("b.low"))) \
        & (100 * F.col("a.high") >= percent * F.col("b.low")) & (100 * F.col("b.high") >= percent * F.col("a.low"))
    alone = (F.col("a.leaf") == F.col("b.leaf")) & (F.col("a.docs") < 2)
    return a.join(b, (F.col("a.plot") == F.col("b.plot")) & (F.col("a.leaf") <= F.col("b.leaf"))) \
        .where(reach & ~alone).select(F.col("a.plot").alias("plot"), F.col("a.leaf").alias("left"),
                                      F.col("b.leaf").alias("right"),
                                      F.xxhash64("a.plot", "a.leaf", "b.leaf").alias("unit"))


def numbered(docs: DataFrame, row_col: str) -> DataFrame:
    """``docs`` written once with a number for each row. Later passes read the numbers
    from the table: a scan that is split in another way changes none of them."""
    return materialize(docs.withColumn(row_col, F.monotonically_increasing_id()), "ngram-rows", compression="zstd")


def describe(docs: DataFrame, row_col: str, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """One row per document: size, digest, count vector and keys of its set."""
    common = common_ngrams(docs, text_col, words)
    return materialize(
        docs.select(F.col(row_col).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(_described(words, percent, common), "row long, id long, n long, digest binary, class long, "
                    "counts array<bigint>, keys array<bigint>"), "ngram-sets")


def placed(rows: DataFrame) -> DataFrame:
    """One row per distinct set that shares a key with another one: digest, row (of
    a document that holds it), size, counts, plot and leaf. ``rows``: see ``describe``."""
    keyed = rows.where("n > 0").select("class", F.explode("keys").alias("key"))
    # a table of its own, so that the join may split a key that very many documents share
    shared = materialize(keyed.groupBy("key").agg(F.min("class").alias("first"), F.max("class").alias("last"))
                         .where("first < last").select("key", "first"), "ngram-shared")
    meets = keyed.join(shared, "key").where("class <> first").select(F.col("class").alias("a"), F.col("first").alias("b"))
    plots = materialize(components(meets, "ngram-plots").select(F.col("node").alias("class"), F.col("label").alias("plot")),
                        "ngram-plots")
    # one row per distinct set; which document it is read from does not matter
    members = materialize(_leaves(
        rows.join(plots, "class").groupBy("digest", "plot")
        .agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("counts").alias("counts"))), "ngram-leaves")
    discard(shared, plots)
    return members


def links(docs: DataFrame, members: DataFrame, row_col: str, text_col: str = "text", words: int = WORDS,
          percent: int = PERCENT) -> DataFrame:
    """(a, b): digests of linked sets, enough of them to connect every component.
    ``docs`` and ``members`` (see ``placed``) name a row by the same number."""
    wanted = members.select("row")
    texts = docs.select(F.col(row_col).alias("row"), F.col(text_col).alias("text"))
    sets = texts.join(_bounded(wanted, wanted.count()), "row", "left_semi").select("text") \
        .mapInArrow(_sets(words), "digest binary, grams binary")
    units = materialize(_units(members, percent), "ngram-units")
    places = units.select("plot", F.col("left").alias("leaf"), "unit", F.lit(0).alias("side")).unionAll(
        units.where("left <> right").select("plot", F.col("right").alias("leaf"), "unit", F.lit(1).alias("side")))
    seats = members.select("digest", "plot", "leaf").join(places, ["plot", "leaf"]).select("digest", "unit", "side")
    found = materialize(
        sets.join(seats, "digest").repartition("unit").sortWithinPartitions("unit", "side", "digest")
        .select("unit", "side", "digest", "grams").mapInArrow(_joined_leaves(percent), "a binary, b binary"),
        "ngram-links")
    discard(units)
    return found


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                  percent: int = PERCENT) -> DataFrame:
    """One row per document row: row (its number), id, n_shingles, component_id
    (least id of its component) and first_row (least (id, row) of it)."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = numbered(narrow, "row")
    found = _components_of(rows, "row", "id", "text", words, percent).withColumnRenamed("id", id_col)
    discard(rows)
    return found


def _components_of(docs: DataFrame, row_col: str, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    described = describe(docs, row_col, id_col, text_col, words, percent)
    members = placed(described)
    rows = materialize(described.select("row", "id", "n", "digest"), "ngram-sizes")
    discard(described)  # the keys are most of what the step holds on disk
    linked = links(docs, members, row_col, text_col, words, percent)
    found = components(linked, "ngram-components")
    discard(members, linked)
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    classes = rows.where("n > 0").groupBy("digest").agg(least.alias("least"))
    labelled = classes.join(found.withColumnRenamed("node", "digest"), "digest", "left") \
        .select("digest", F.coalesce("label", "digest").alias("label"), "least")
    tops = labelled.groupBy("label").agg(F.min("least").alias("least"))
    named = materialize(labelled.select("digest", "label").join(tops, "label").select(
        "digest", F.col("least.id").alias("top_id"), F.col("least.row").alias("top_row")), "ngram-named")
    return rows.select("row", "id", "n", "digest").join(named, "digest", "left").select(
        "row", "id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("top_id")).alias("component_id"),
        F.coalesce("top_row", "row").alias("first_row"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                     percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, less every row of a component but the
    one with the least id. Documents without words are no copies of each other."""
    row = unused(docs, "row_number")
    rows = numbered(docs, row)
    gone = materialize(_components_of(rows, row, id_col, text_col, words, percent).where("row <> first_row")
                       .select(F.col("row").alias(row)), "ngram-gone")
    return rows.join(_bounded(gone, gone.count()), row, "left_anti").select(*docs.columns)
