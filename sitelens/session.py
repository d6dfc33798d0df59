"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import SparkSession

# Settings that every job here relies on. AQE re-plans joins and coalesces
# shuffle partitions at runtime; skew-join splitting handles hot users/hosts.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Spark 4's default, pinned: size(null) is null, bad casts fail loudly.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # A model answer with a repeated key keeps the last value, like a
    # Python dict built from JSON does.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Rows of a batch that goes to a Python worker: texts can be long.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Streaming state on disk, not on the executors' heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "sitelens", extra: dict | None = None) -> SparkSession:
    """Local/test session builder. On a cluster, pass no master and let
    spark-submit decide; only unset options are filled in."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_conf(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sitelens`` importable in Python workers (``mapInPandas``,
    ``applyInPandasWithState``): zip the package once per SparkContext and
    add it with ``addPyFile``, as ``--py-files`` does on a cluster."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="sitelens-pyfiles-"), "sitelens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def apply_conf(spark: SparkSession) -> None:
    """Runtime SQL settings the jobs rely on (safe on an existing session),
    and the package shipped to Python workers."""
    ship_package(spark)
    for k, v in BASE_CONF.items():
        if spark.conf.isModifiable(k):
            spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set to a path that the driver and all executors
    share; a temp folder is only chosen for a local master, as in tests.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="sitelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


_TABLES: dict[str, list[str]] = {}              # application -> paths written
_SHARED: dict[tuple[str, str, str], str] = {}   # (application, name, input) -> path
_PATHS: WeakKeyDictionary = WeakKeyDictionary()  # frame returned by materialize -> path

RELEASE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_released(spark: SparkSession):
    """Shuffle files of the executions inside go as soon as each is over, not
    when the driver's JVM happens to collect its garbage."""
    before = spark.conf.get(RELEASE_SHUFFLES, None)
    spark.conf.set(RELEASE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(RELEASE_SHUFFLES)
        else:
            spark.conf.set(RELEASE_SHUFFLES, before)


def materialize(df, name: str = "table", by: list[str] | None = None, compression: str | None = None):
    """Cut lineage at an intermediate read by several consumers.

    The rows are written once as a Parquet table under the shared
    ``spark.checkpoint.dir`` (survives executor loss, unlike a local
    checkpoint) and read back: consumers get a columnar scan with column
    pruning and filter pushdown, and the producing plan runs exactly once
    (``Dataset.checkpoint`` would run it for its eager count and again to
    write the files). The shuffle files behind the table go once it is written:
    nothing reads them again. ``by``: columns that the files are laid out by.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    if compression:
        writer = writer.option("compression", compression)
    with _shuffles_released(spark):
        writer.mode("overwrite").parquet(path)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    table = spark.read.parquet(path)
    _PATHS[table] = path
    return table


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for what a query writes itself; ``drop_tables`` knows it."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables) -> None:
    """Delete tables, as ``materialize`` returned them, that nothing reads any
    more: a step of many passes holds no more on disk than what comes after needs."""
    for table in tables:
        _delete(table.sparkSession, _PATHS.pop(table))


@contextmanager
def temporary_tables(spark: SparkSession):
    """Deletes the tables that are materialised inside, shared ones excepted: a
    stream's epochs leave nothing behind but what they commit."""
    paths = _TABLES.setdefault(spark.sparkContext.applicationId, [])
    before = len(paths)
    try:
        yield
    finally:
        shared = set(_SHARED.values())
        gone = [p for p in paths[before:] if p not in shared]
        paths[before:] = [p for p in paths[before:] if p in shared]
        for path in gone:
            _delete(spark, path)


def shared_table(spark: SparkSession, name: str, source: str, build, by: list[str] | None = None):
    """The table ``name`` of the input ``source``: built and written on first
    use in this application, read by every query after that. ``build`` must
    depend on nothing but ``source``."""
    key = (spark.sparkContext.applicationId, name, source.rstrip("/"))
    if key not in _SHARED:
        materialize(build(), name, by)
        _SHARED[key] = _TABLES[key[0]][-1]
    return spark.read.parquet(_SHARED[key])


def has_shared(spark: SparkSession, name: str, source: str) -> bool:
    """Whether a shared table has been built."""
    return (spark.sparkContext.applicationId, name, source.rstrip("/")) in _SHARED


def shared_path(spark: SparkSession, name: str, source: str) -> str:
    """The folder of a shared table that has been built."""
    return _SHARED[spark.sparkContext.applicationId, name, source.rstrip("/")]


def drop_tables(spark: SparkSession) -> None:
    """Delete every table that this application has materialised."""
    app = spark.sparkContext.applicationId
    for path in _TABLES.pop(app, []):
        _delete(spark, path)
    for key in [k for k in _SHARED if k[0] == app]:
        del _SHARED[key]
