"""Structured Streaming versions of the stateful parts (ST-1..ST-5).

* ST-1 ``event_stream``: ``readStream`` over the event files (a Kafka source
  with ``startingOffsets=latest`` is the drop-the-backlog equivalent), a bounded
  number of files per micro-batch; ``unseen`` takes out rows whose id has come
  before, however long ago.
* ST-2 ``bundle_stream``: stream-static left joins of requests to the page
  snapshot, then the content bundle projection.
* ST-3 ``deliver_reports``: ``foreachBatch`` sink; every epoch is one run of the
  sink (``sources.runs``), so a replayed micro-batch writes nothing twice and no
  epoch reads the history.
* ST-4 ``QuotaEpochs``: per epoch the check-then-increment rule of the batch replay
  over the micro-batch, started from a table of one row per user.
* ST-5 ``DialogEpochs``: the same for the dialog, whose state is a mergeable summary
  (session, the button that opened it, texts and valid texts since).

A micro-batch is worked through by the operators of the batch jobs, in ranges
(``operators.windows``): a user with a third of its rows lies in many tasks, and no
user's rows are held in one frame. A user's state enters as rows that come before
the batch's and leave the operator in that state.

Order: micro-batches count in the order in which they arrive, rows within one by
(time, id). A row that is older than what its user's state has seen is handled
when it comes and marked ``late``; no row is dropped.

Every epoch commits three runs under its number: decisions, ids, changed state.
An epoch that is repeated computes the same from the runs before it, and adds only
what is not yet there. Changed state is written for the users of the epoch; every
``COMPACT_EVERY`` epochs the state of all users is written as one run, and readers
start from the last of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.operators import dialog as Dg
from sitelens.operators.outbox import SINK_BUCKETS
from sitelens.operators.replay import replayed
from sitelens.schemas import DEFAULT_USER_LIMIT
from sitelens.session import materialize, scratch_path, temporary_tables
from sitelens.sources.runs import Runs

COMPACT_EVERY = 16
FILES_PER_BATCH = 64
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def event_stream(spark: SparkSession, path: str, max_files: int = FILES_PER_BATCH) -> DataFrame:
    """ST-1: events as a stream. ``path`` names a folder or files."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def epoch_name(epoch: int) -> str:
    return f"{epoch:012d}"


def unseen(batch: DataFrame, id_col: str, ids: Runs, epoch: int) -> DataFrame:
    """ST-1: the rows of a micro-batch whose id no earlier epoch has had, one per
    id. The log of ids is a table; files whose range of ids lies outside the batch's
    are skipped by their statistics."""
    ends = batch.agg(F.min(id_col), F.max(id_col)).first()
    if ends[0] is None:
        return batch.where("false")
    known = ids.read(before=epoch_name(epoch)).where(F.col("id").between(*ends)).select(F.col("id").alias(id_col))
    return batch.dropDuplicates([id_col]).join(known, id_col, "left_anti")


class Epochs:
    """A stateful ``foreachBatch`` job. Subclasses say what the state of a user is
    and how a micro-batch is decided, starting from it."""

    id_col: str
    out: str
    state: str     # columns after user_id

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.ids = Runs(spark, f"{path}/ids", "id long")
        self.decisions = Runs(spark, f"{path}/decisions", self.out)
        self.states = Runs(spark, f"{path}/state", f"user_id string, {self.state}, epoch long")
        self.whole = Runs(spark, f"{path}/whole-state", f"user_id string, {self.state}, epoch long")

    def state_before(self, epoch: int) -> DataFrame:
        """One row per user: the state that the epochs before this one left."""
        last = [*self.whole.committed(before=epoch_name(epoch))][-1:]
        since = [r for r in self.states.committed(before=epoch_name(epoch)) if not last or r > last[0]]
        rows = self.whole.read(runs=last).unionByName(self.states.read(runs=since))
        names = [n for n in rows.columns if n != "user_id"]
        return rows.groupBy("user_id").agg(F.max_by(F.struct(*names), "epoch").alias("s")).select("user_id", "s.*")

    def decide(self, batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(decisions without ``late``, new state of the batch's users without ``seen_ts``)."""
        raise NotImplementedError

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        name = epoch_name(epoch)
        if not self.states.holds(name):  # the last of an epoch's commits: otherwise it has been through
            with temporary_tables(self.spark):
                self._run(batch, epoch, name)

    def _run(self, batch: DataFrame, epoch: int, name: str) -> None:
        rows = materialize(unseen(batch, self.id_col, self.ids, epoch), "epoch-rows")
        state = self.state_before(epoch)
        users = rows.select("user_id").distinct()
        state = materialize(state.join(users, state.user_id.eqNullSafe(users.user_id), "left_semi"), "epoch-state")
        decided, new = self.decide(rows, state)
        seen = state.select(F.col("user_id").alias("__user"), F.col("seen_ts").alias("__seen"))
        times = rows.select(F.col(self.id_col).alias("__id"), "ts")
        late = decided.join(times, F.col(self.id_col) == F.col("__id")) \
            .join(seen, F.col("user_id").eqNullSafe(F.col("__user")), "left") \
            .withColumn("late", F.coalesce(F.col("ts") < F.col("__seen"), F.lit(False)))
        self.decisions.append(late.select(*self.decisions.columns), name)
        self.ids.append(rows.select(F.col(self.id_col).alias("id")).orderBy("id"), name)
        newest = rows.groupBy(F.col("user_id").alias("__of")).agg(F.max("ts").alias("__ts"))
        after = new.join(newest, F.col("user_id").eqNullSafe(F.col("__of"))) \
            .join(seen, F.col("user_id").eqNullSafe(F.col("__user")), "left") \
            .withColumn("seen_ts", F.greatest("__ts", "__seen")).withColumn("epoch", F.lit(epoch).cast("long"))
        if (epoch + 1) % COMPACT_EVERY == 0:
            after = materialize(after.select(*self.states.columns), "epoch-after")
            rest = self.state_before(epoch).join(after.select("user_id"), "user_id", "left_anti")
            self.whole.append(rest.unionByName(after), name)
        self.states.append(after.select(*self.states.columns), name)


# --------------------------------------------------------------------------- ST-4

class QuotaEpochs(Epochs):
    """ST-4: micro-batches of (user_id, ts, request_id, ws, new_limit). The state
    is a user's limits row."""

    id_col = "request_id"
    out = "request_id long, user_id string, admitted boolean, max_limit long, late boolean"
    state = "current long, max_limit long, seen_ts timestamp_ntz"

    def __init__(self, spark: SparkSession, path: str, default: int = DEFAULT_USER_LIMIT):
        super().__init__(spark, path)
        self.default = default

    def decide(self, batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        # a limit of ``current``, as many successes, then the limit in force: after these rows the user is in its state
        steps = F.array(F.struct(F.lit(0).alias("step"), F.lit(0).cast("long").alias("ws"), F.col("current").alias("new_limit")),
                        F.struct(F.lit(1).alias("step"), F.col("current").alias("ws"), F.lit(None).cast("long").alias("new_limit")),
                        F.struct(F.lit(2).alias("step"), F.lit(0).cast("long").alias("ws"), F.col("max_limit").alias("new_limit")))
        before = state.select("user_id", F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("long").alias("request_id"),
                              F.inline(steps))
        rows = before.unionByName(batch.select("user_id", "ts", "request_id", F.lit(3).alias("step"), "ws", "new_limit"))
        done = replayed(rows, ["step", "ts", "request_id"], self.default)
        # whole rows of the state are counted, so the step's successes are those the state holds
        used = F.sum(F.when(F.col("step") == 1, F.col("ws")).when(F.col("admitted"), F.coalesce("ws", F.lit(0))).otherwise(F.lit(0)))
        after = done.groupBy("user_id").agg(used.cast("long").alias("current"),
                                            F.max_by("max_limit", F.struct("step", "ts", "request_id")).alias("max_limit"))
        return done.where((F.col("step") == 3) & F.col("new_limit").isNull()).select(
            "request_id", "user_id", "admitted", "max_limit"), after


# --------------------------------------------------------------------------- ST-5

class DialogEpochs(Epochs):
    """ST-5: micro-batches of (event_id, ts, user_id, kind), kinds as in
    ``operators.dialog``."""

    id_col = "event_id"
    out = "event_id long, user_id string, session long, action string, late boolean"
    state = "session long, button string, texts long, valid long, seen_ts timestamp_ntz"

    def decide(self, batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        states = Dg.states_of(batch, state)
        return Dg.actions(states), Dg.final_states(states)


def quota_stream(timeline: DataFrame, path: str, default: int = DEFAULT_USER_LIMIT) -> DataFrame:
    """ST-4: ``timeline`` (user_id, ts, request_id, ws, new_limit) as a stream, run
    over everything available; decisions and state are under ``path``."""
    job = QuotaEpochs(timeline.sparkSession, path, default)
    run_available(timeline, f"{path}/checkpoint", each=job)
    return job.decisions.read()


def dialog_stream(events: DataFrame, path: str) -> DataFrame:
    """ST-5 over an event stream."""
    log = events.select("event_id", "ts", F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("kind"))
    job = DialogEpochs(events.sparkSession, path)
    run_available(log, f"{path}/checkpoint", each=job)
    return job.decisions.read()


# --------------------------------------------------------------------------- ST-2, ST-3

def bundle_stream(requests: DataFrame, snapshot: DataFrame) -> DataFrame:
    """ST-2: stream-static joins; the snapshot side is a static table."""
    from sitelens.operators.bundle import content_bundle
    return content_bundle(requests, snapshot)


def deliver_reports(sink_path: str, schema: T.StructType):
    """ST-3: a ``foreachBatch`` function. Each epoch is one run of the sink, laid
    out by day and a bucket of the destination; a folder's rows come from one task, so
    the files do not grow with the tasks."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        rows = batch.withColumn("day", F.to_date("created_at")) \
            .withColumn("bucket", F.pmod(F.crc32("sheet_id"), F.lit(SINK_BUCKETS)).cast("int")) \
            .repartition("day", "bucket")
        Runs(batch.sparkSession, sink_path, schema).append(rows, epoch_name(epoch_id), by=["day", "bucket"])
    return write


def run_available(df: DataFrame, at: str, sink: str | None = None, each=None):
    """Drive a streaming query over everything available, then stop
    (``trigger(availableNow=True)``): into a Parquet file sink, or into ``each``
    (a ``foreachBatch`` function). ``at``: the query's checkpoint."""
    w = df.writeStream.outputMode("append").option("checkpointLocation", at) \
        .trigger(availableNow=True)
    q = w.foreachBatch(each).start() if each else w.format("parquet").option("path", sink).start()
    q.awaitTermination()
    return q


def collect_stream(df: DataFrame, prefix: str) -> DataFrame:
    """Run a streaming query over everything available into a Parquet file
    sink under the shared checkpoint folder (exactly-once file sink; nothing
    is held on the driver) and return the sink as a batch DataFrame."""
    at = scratch_path(df.sparkSession, prefix)
    out = f"{at}/out"
    run_available(df, at, sink=out)
    return df.sparkSession.read.schema(df.schema).parquet(out)
