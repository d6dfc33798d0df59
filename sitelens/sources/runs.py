"""Tables that grow by runs: a repeated run adds nothing, readers see whole runs only.

A run's rows are written to a folder of their own; a small record, moved whole to the
run's name and never replaced, then names the folder and holds what later runs need
to know (largest id). Of two attempts at one run the first to finish counts, and the
other's folder is never read. A run that fails before its record exists has added nothing. All goes
through Hadoop's file system interface, like Spark's own reads and writes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Runs:
    """The table under ``path``; ``schema`` is what an empty table has."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = self.schema.names
        self._records: dict[str, dict] = {}  # read so far: a record never changes

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def committed(self, before: str | None = None) -> dict[str, dict]:
        """Records of the committed runs by name, in order; only names below ``before``, if given."""
        fs, folder = self._fs(f"{self.path}/runs")
        if not fs.exists(folder):
            return {}
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if not s.getPath().getName().startswith("."))
        out = {}
        for name in names:
            if before is not None and name >= before:
                continue
            if name not in self._records:
                fs, record = self._fs(f"{self.path}/runs/{name}")
                size = fs.getFileStatus(record).getLen()
                stream = fs.open(record)
                try:
                    text = bytes(stream.readNBytes(size)).decode()
                finally:
                    stream.close()
                self._records[name] = json.loads(text)
            out[name] = self._records[name]
        return out

    def holds(self, run: str) -> bool:
        fs, record = self._fs(f"{self.path}/runs/{run}")
        return fs.exists(record)

    def append(self, df: DataFrame, run: str, by: list[str] | None = None, **notes) -> bool:
        """Adds ``df`` as ``run``; False, and nothing added, if that run is there already.
        ``by``: columns that the folder is partitioned by. ``notes`` go into the record."""
        if self.holds(run):
            return False
        folder = f"data/{run}-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*by) if by else df.write
        writer.parquet(f"{self.path}/{folder}")
        fs, record = self._fs(f"{self.path}/runs/{run}")
        _, draft = self._fs(f"{self.path}/runs/.{run}-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write((json.dumps({"folder": folder, **notes}) + "\n").encode())
        stream.close()
        # whole records only: a name that is there stays (the other attempt was faster)
        return not fs.exists(record) and bool(fs.rename(draft, record))

    def read(self, before: str | None = None, runs: list[str] | None = None) -> DataFrame:
        """All rows of committed runs: those below ``before``, or those of ``runs``."""
        found = self.committed(before)
        folders = [f"{self.path}/{r['folder']}" for n, r in found.items() if runs is None or n in runs]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*folders)
