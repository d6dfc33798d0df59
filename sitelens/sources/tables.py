"""Readers for the input tables.

Every reader selects only the columns its caller needs, so Parquet column
pruning applies at the scan; filters written after the read are pushed into
the scan by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def pages(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return table(spark, sf_dir, "pages", *(cols or ("page_id", "url", "html")))


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *(cols or ("doc_id", "text")))


def events(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return table(spark, sf_dir, "events", *(cols or ("event_id", "ts", "user_id", "event_type", "value", "props")))


def lay_out(spark: SparkSession, sf_dir: str, target: str, files: int) -> str:
    """Copy the input with its wide tables in ``files`` files each, as an
    ingest would lay them out. A table that arrives as one row group can only
    be read by one task; how many files it has is the layout's business, not
    the queries'."""
    for name in TABLES:
        df = table(spark, sf_dir, name)
        if name in ("pages", "documents", "events"):
            df = df.repartition(files, df.columns[0])
        df.write.mode("overwrite").parquet(f"{target.rstrip('/')}/{name}.parquet")
    return target


def ensure_state_tables(spark: SparkSession, root: str) -> dict[str, str]:
    """S-9: create the settings, limits and outbox tables (Parquet, empty,
    explicit schemas) under ``root`` when they do not exist yet; returns
    their paths. Existing tables are left untouched (``mode=ignore``)."""
    from sitelens.schemas import LIMITS, OUTBOX, SETTINGS
    paths = {}
    for name, schema in (("users_settings", SETTINGS), ("users_limits", LIMITS), ("pending_results", OUTBOX)):
        paths[name] = f"{root.rstrip('/')}/{name}"
        spark.createDataFrame([], schema).write.mode("ignore").parquet(paths[name])
    return paths
