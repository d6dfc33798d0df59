"""Balanced label propagation of linked documents over shards, in DataFrame
operations only.

Documents with equal texts are linked. Every document starts in the shard of its
hash. Documents of one text that start in one shard move as a cell; rounds of
joins move cells towards the open shard where most of their neighbours are,
under quotas: what may enter a shard is its free room plus what leaves it in the
same round. A last step evens the counts: surplus documents, those without links
first, fill the shards that lack some. The law is ``rows``: counts differ by at
most one.

Defined results: null text: 8 bytes, linked like the empty text. Repeated rows
and null ids are rows like any others. Fewer documents than shards: some shards
are empty. Empty table: no rows. Only id and text are read, so other columns
cannot clash.

A text with a third of all rows has one cell per starting shard; ranks and slots
are counted per bucket and shifted by the bucket's offset. Buckets hold a bounded
number of rows: a cell that is larger is dealt over as many as it needs, by a hash
of the row's number, so rows that are equal in id and text spread as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import text_or_empty
from sitelens.session import materialize

SHARDS = 24
ROUNDS = 8
ROWS_PER_BUCKET = 20_000


def document_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """id, row (its number, for a table that is written), size, text_crc32, link (a
    hash of the text) and the starting shard; texts themselves are not shuffled."""
    raw = F.encode(text_or_empty(text_col), "UTF-8")
    return (docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), (F.octet_length(text_or_empty(text_col)) + 8).cast("long").alias("size"),
                        F.crc32(raw).alias("text_crc32"), F.xxhash64(text_or_empty(text_col)).alias("link"))
            .withColumn("start", F.pmod(F.xxhash64("id", "link"), F.lit(shards)).cast("int")))


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _quotas(wished: DataFrame, loads: dict[int, int], capacity: int) -> dict[int, float]:
    """For each shard, the share of the documents on their way to it that may
    enter: at most shards x shards sums reach the driver."""
    entering: dict[int, int] = {}
    leaving: dict[int, int] = {}
    for m in wished.where("want <> shard").groupBy("shard", "want").agg(F.sum("n").alias("n")).collect():
        entering[m["want"]] = entering.get(m["want"], 0) + m["n"]
        leaving[m["shard"]] = leaving.get(m["shard"], 0) + m["n"]
    return {s: min(1.0, (max(0, capacity - loads[s]) + min(n, leaving.get(s, 0))) / n) for s, n in entering.items()}


def propagate(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(link, start, n, shard): the label of every cell of n rows that propagation has moved
    or kept, for links of two documents or more. Only linked documents count
    against a shard's capacity: those without links make way at no cost."""
    groups = rows.groupBy("link", "start").agg(F.count("*").alias("n"))
    linked = groups.groupBy("link").agg(F.sum("n").alias("copies")).where("copies > 1")
    cells = materialize(groups.join(linked, "link", "left_semi").withColumn("shard", F.col("start")), "shard-cells")
    capacity = rows.count() // shards
    loads = dict.fromkeys(range(shards), 0)
    loads |= {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    for turn in range(rounds):
        # neighbours per shard; equal numbers are told apart by a hash, so that they do not all choose one shard
        votes = cells.groupBy("link", "shard").agg(F.sum("n").alias("votes")) \
            .withColumn("tie", F.xxhash64("link", "shard"))
        room = _literal_map({s: loads[s] < capacity for s in range(shards)})
        best = votes.where(room[F.col("shard")]).groupBy("link") \
            .agg(F.max(F.struct("votes", "tie", "shard")).alias("best"))
        gains = F.struct(F.col("best.votes"), F.col("best.tie")) > F.struct("votes", "tie")
        wished = materialize(
            cells.join(votes, ["link", "shard"]).join(best, "link", "left")
            .select("link", "start", "n", "shard", F.when(gains, F.col("best.shard")).otherwise(F.col("shard")).alias("want")),
            "shard-wishes")
        quota = _quotas(wished, loads, capacity)
        if not quota:
            break
        draw = F.pmod(F.xxhash64("link", "start", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        enters = (F.col("want") != F.col("shard")) & (draw < F.coalesce(_literal_map(quota)[F.col("want")], F.lit(0.0)))
        moved = wished.withColumn("next", F.when(enters, F.col("want")).otherwise(F.col("shard")))
        for r in moved.where("next <> shard").groupBy("shard", "next").agg(F.sum("n").alias("n")).collect():
            loads[r["shard"]] -= r["n"]
            loads[r["next"]] += r["n"]
        cells = moved.select("link", "start", "n", F.col("next").alias("shard"))
    return materialize(cells.select("link", "start", "n", "shard"), "shard-labels")


def _ranked(df: DataFrame, key: str, bucket: Column, order: list, name: str) -> DataFrame:
    """Gapless rank from 0 within ``key``: rows are numbered within buckets of
    bounded size, and a small table of bucket counts gives each its offset."""
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(key).alias("_key"), F.col("_bucket").alias("_of"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)) - 1
    return (df.withColumn("_local", local)
            .join(offsets, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_of")))
            .withColumn(name, (F.col("_local") + F.col("_before")).cast("long"))
            .drop("_bucket", "_local", "_key", "_of", "_before"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
                    rounds: int = ROUNDS) -> DataFrame:
    """id, size, text_crc32, law, shard, slot (gapless in the shard) and
    grown_shard (null under this law), with the link for further use."""
    rows = materialize(document_rows(docs, id_col, text_col, shards), "shard-rows")
    labels = propagate(rows, shards, rounds)
    labelled = materialize(
        rows.join(labels, ["link", "start"], "left")
        .select("id", "row", "size", "text_crc32", "link", F.col("shard").isNotNull().alias("is_linked"),
                F.ceil(F.coalesce("n", F.lit(1)) / ROWS_PER_BUCKET).alias("parts"),
                F.coalesce("shard", "start").alias("label")), "shard-labelled")

    loads = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(loads.values())
    by_load = sorted(range(shards), key=lambda s: (-loads.get(s, 0), s))
    even = {s: total // shards + (place < total % shards) for place, s in enumerate(by_load)}
    buckets = total // (shards * ROWS_PER_BUCKET) + 16
    # linked documents first, texts side by side: the rows beyond a shard's even count leave it
    bucket = F.struct(~F.col("is_linked"), F.pmod(F.col("link"), F.lit(buckets)), F.pmod(F.xxhash64("row"), F.col("parts")))
    placed = _ranked(labelled, "label", bucket, ["link", F.col("id").asc_nulls_last(), "row"], "place")
    placed = placed.withColumn("beyond", F.col("place") - _literal_map(even)[F.col("label")])

    # surplus rows are numbered through and dealt to the shards that lack rows
    extra, lacking, at, end = {}, [], 0, 0
    for s in range(shards):
        surplus = loads.get(s, 0) - even[s]
        extra[s], at = at, at + max(0, surplus)
        if surplus < 0:
            end -= surplus
            lacking.append((end, s))
    number = F.col("beyond") + _literal_map(extra)[F.col("label")]
    target = F.col("label")
    for upto, s in reversed(lacking):
        target = F.when((F.col("beyond") >= 0) & (number < upto), F.lit(s)).otherwise(target)
    final = placed.withColumn("shard", target.cast("int"))
    slots = max(1, total // (shards * ROWS_PER_BUCKET) + 1)
    out = _ranked(final.select("id", "row", "size", "text_crc32", "link", "shard"), "shard",
                  F.pmod(F.xxhash64("id", "row"), F.lit(slots)), [F.col("id").asc_nulls_last(), "row"], "slot")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "link")
