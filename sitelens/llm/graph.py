"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.session import discard, materialize


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label) for every node of the undirected edges (a, b); the label is
    the component's least node. Each round is two aggregations with partial
    combining and two joins, all written to the shared folder. The joins are of
    two tables, so a node with very many neighbours is a skewed key that adaptive
    execution splits. Nothing but two numbers per round reaches the driver. The
    rounds go on until a round leaves the pairs as they were. A round's tables go
    when the next one is written; only the last pairs stay."""
    pairs = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct(), name)
    seen = None
    while True:
        # large star: every neighbour above a node goes to the node's least neighbour
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = materialize(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                            .distinct(), name)
        discard(pairs, least)
        # small star: a node and its neighbours below go to the least of them
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = materialize(small.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), name)
        discard(large, least)
        now = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen or not now["n"]:
            break
        seen = now
    labels = pairs.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionAll(labels.select(F.col("label").alias("node"), "label").distinct())
