"""Tables that are laid out for point lookups (S-2, S-3).

Rows lie in folders by a bucket of their key and, within a file, sorted by key: a
lookup names one folder, so the scan lists and opens no other, and within it the
statistics of sorted files leave out the row groups of other keys. A bucket that a
hot key fills is written by several tasks as several files.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 64
BUCKET = "key_bucket"


def clustered(df: DataFrame, key: str, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``key_bucket``, dealt and sorted so that it can be written by it.
    Partitions that grow too large are split when they are read (rebalance)."""
    named = df.withColumn(BUCKET, F.pmod(F.crc32(F.col(key).cast("string")), F.lit(buckets)).cast("int"))
    return named.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, key, *order)


def rows_of(table: DataFrame, key: str, value, buckets: int = BUCKETS) -> DataFrame:
    """The rows of one key, from the folder of its bucket alone."""
    bucket = zlib.crc32(str(value).encode()) % buckets
    return table.where((F.col(BUCKET) == bucket) & (F.col(key) == F.lit(value))).drop(BUCKET)
