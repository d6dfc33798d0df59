"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Batches go back to the system as soon as they are done with: workers are kept.
pa.set_memory_pool(pa.system_memory_pool())

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read with Spark's reader only (any file system)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def inline_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A parameter list (rules, cues) as a DataFrame of literals. Catalyst sees
    its true size, so it broadcasts a short list and shuffles a long one."""
    structs = [F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def batches_of(rows_at_most: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, so that memory does not follow the batch size."""
    for b in it:
        for i in range(0, b.num_rows, rows_at_most):
            yield b.slice(i, rows_at_most)


def text_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as none."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
