"""Job lifecycle as a stream on Spark's keyed state.

`JobLifecycle` keeps one typed value a job in the state store and folds a
micro-batch's events of a job in seq order on top of it, batches in the order of
arrival. It puts out the events that took effect, from which K5's analysis status
and S7's hub events follow. Only the jobs of a batch are read and written.

With `retain_hours` (K4) and `retry_due` (K3) the stream runs in event time: a timer
clears a finished job's state once the watermark shows that it is older, and
another reports when a retry is due. Both hang on the events alone, so a rerun
over the same files repeats them. The watermark trails the latest event by
`late_hours`; later events than that are dropped in this mode only. Without the two
there is no watermark, and no event is ever late.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from revlens import schemas as S
from revlens.operators import queue as Q
from revlens.sources import tables as TB

JOB_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)
#: The stored value of a job; times are microseconds since the epoch.
JOB_VALUE = "status int, retry_count int, created long, failed long, error_message string"
EFFECTS = "job_id string, seq long, at long, kind string, first boolean"
KINDS = ("enqueue", "dequeue", "complete", "fail")
ENQUEUE, DEQUEUE, COMPLETE, FAIL = range(4)
QUEUED, TAKEN, ENDED = 1, 2, 3
RETRY_DUE = "retry_due"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3600 * 1_000_000
DELAY = Q.RETRY_DELAY_SECONDS * 1_000_000
#: What a stored status stands for, as the events since the latest enqueue.
SO_FAR = {
    S.JOB_PENDING: (ENQUEUE,),
    S.JOB_PROCESSING: (ENQUEUE, DEQUEUE),
    S.JOB_COMPLETED: (ENQUEUE, DEQUEUE, COMPLETE),
    S.JOB_RETRYING: (ENQUEUE, DEQUEUE, FAIL),
    S.JOB_FAILED: (ENQUEUE, DEQUEUE, FAIL),
}


class JobLifecycle(StatefulProcessor):
    def __init__(self, retain_hours: int | None = None, retry_due: bool = False, late_hours: int = 0) -> None:
        self.retain, self.retry_due, self.late = retain_hours, retry_due, late_hours * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", JOB_VALUE)

    def expiry(self, created: int) -> int:
        return (created + self.retain * HOUR - self.late) // 1000

    def due(self, failed: int) -> int:
        return (failed + DELAY - self.late) // 1000

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events = sorted(((r.seq, r.at, r.code, r.message) for r in rows), key=lambda e: (e[0] is None, e[0] or 0))
        old = self.job.get()
        so_far = SO_FAR[old[0]] if old is not None else ()
        phase = len(so_far)  # 0: no job yet, else the events that its latest enqueue had
        end = so_far[-1] if phase == ENDED else None
        _, retries, created, failed, message = old if old is not None else (None, 0, None, None, None)
        took = []
        for seq, at, code, text in events:
            if code == ENQUEUE:
                phase, created, failed = QUEUED, at, None
            elif code == DEQUEUE and phase == QUEUED:
                phase = TAKEN
            elif code >= COMPLETE and phase == TAKEN:
                phase, end = ENDED, code
                if code == FAIL:
                    retries, failed, message = retries + 1, at, text
            else:
                continue
            took.append(Row(job_id=key[0], seq=seq, at=at, kind=KINDS[code], first=old is None and not took))
        if not phase:
            return
        status = S.JOB_PENDING if phase == QUEUED else S.JOB_PROCESSING
        if phase == ENDED:
            status = S.JOB_COMPLETED if end == COMPLETE else S.JOB_RETRYING if retries < Q.MAX_ATTEMPTS else S.JOB_FAILED
        value = (status, retries, created, failed, message)
        if old is None or tuple(old) != value:
            self.job.update(value)
        if self.retain is not None and status in (S.JOB_COMPLETED, S.JOB_FAILED):
            self.handle.registerTimer(self.expiry(created))
        if self.retry_due and status == S.JOB_RETRYING:
            self.handle.registerTimer(self.due(failed))
        yield from took

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, job = expiredTimerInfo.getExpiryTimeInMs(), self.job.get()
        if job is None:
            return
        if self.retain is not None and job[0] in (S.JOB_COMPLETED, S.JOB_FAILED) and at == self.expiry(job[2]):
            self.job.clear()
        elif self.retry_due and job[0] == S.JOB_RETRYING and at == self.due(job[3]):
            yield Row(job_id=key[0], seq=None, at=job[3] + DELAY, kind=RETRY_DUE, first=False)

    def close(self) -> None:
        pass


def effects(events: DataFrame, retain_hours: int | None = None, retry_due: bool = False, late_hours: int | None = None) -> DataFrame:
    """The stream of job events (`JOB_EVENT_SCHEMA`) -> the events that took
    effect. Rows without a job, a known kind or a time concern no job."""
    late = late_hours if late_hours is not None else retain_hours or 0
    timed = retain_hours is not None or retry_due
    code = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    ev = events.select("job_id", "seq", "ts", F.unix_micros("ts").alias("at"), code.alias("code"), "message")
    ev = ev.where(F.col("job_id").isNotNull() & (F.col("code") >= 0) & F.col("at").isNotNull())
    ev = ev.withWatermark("ts", f"{late} hours") if timed else ev.drop("ts")
    return ev.groupBy("job_id").transformWithState(
        JobLifecycle(retain_hours, retry_due, late if timed else 0), EFFECTS, "Update", "EventTime" if timed else "None"
    )


def status_events(effective_events: DataFrame) -> DataFrame:
    """K5 and S7 of effective events: the analysis status and the hub event."""
    k = F.col("kind")
    return effective_events.where(k != RETRY_DUE).select(
        "job_id",
        "seq",
        F.timestamp_micros("at").alias("ts"),
        "kind",
        F.when(k == "enqueue", F.when(F.col("first"), F.lit(S.ST_PENDING)))
        .when(k == "dequeue", F.lit(S.ST_IN_PROGRESS))
        .when(k == "complete", F.lit(S.ST_COMPLETED))
        .otherwise(F.lit(S.ST_FAILED))
        .alias("analysis_status"),
        F.when(k == "dequeue", F.lit("AnalysisUpdated")).when(k == "complete", F.lit("AnalysisCompleted")).alias("hub_event"),
    )


def job_table(spark: SparkSession, root: str) -> DataFrame:
    """The state of every job, read from the stream's state store."""
    value = spark.read.format("statestore").option("stateVarName", "job").load(f"{root}/_checkpoint").select("key.job_id", "value.*")
    failed = F.timestamp_micros("failed")
    return value.select(
        "job_id",
        "status",
        "retry_count",
        F.timestamp_micros("created").alias("created_at"),
        failed.alias("failed_at"),
        F.when(F.col("status") == S.JOB_RETRYING, failed + F.make_interval(secs=F.lit(Q.RETRY_DELAY_SECONDS))).alias("next_attempt_at"),
        "error_message",
    )


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of batches; empty before the first."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


STATUS_EVENTS = "job_id string, seq long, ts timestamp, kind string, analysis_status int, hub_event string, analysis_id string"
HUB_EVENTS = "event string, seq long, repo_name string, pr_number int, title string, author string, analysis_id string"


class StatusSinks:
    """K5 and S7 of one micro-batch: its status events are stored under the
    batch's number first; from that table the analyses take their latest status
    (S5) and the hub events are written, under the batch's number again. After a
    crash at any point the batch repeats itself and writes the same rows to the
    same places."""

    def __init__(self, spark: SparkSession, root: str, analyses: str, schema: T.StructType, analysis_id: Column, buckets: int = TB.BUCKETS) -> None:
        self.spark, self.root, self.analyses, self.schema, self.analysis_id, self.buckets = spark, root, analyses, schema, analysis_id, buckets

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        path = f"{self.root}/status/batch={batch_id}"
        status_events(batch).withColumn("analysis_id", self.analysis_id.cast("string")).write.mode("overwrite").parquet(path)
        events = self.spark.read.schema(STATUS_EVENTS).parquet(path)
        self.write_status(events)
        self.write_hub(events, batch_id)

    def write_status(self, events: DataFrame) -> None:
        key = self.schema["id"].dataType
        latest = events.where("analysis_status is not null").groupBy(F.col("analysis_id").cast(key).alias("id")).agg(
            F.max(F.struct("seq", "analysis_status", "ts")).alias("last")
        )
        changes = latest.select("id", F.col("last.analysis_status").alias("status"), F.col("last.ts").alias("updated_at"))
        TB.update_touched(self.spark, self.analyses, self.schema, changes, buckets=self.buckets)

    def write_hub(self, events: DataFrame, batch_id: int) -> None:
        """Hub events of the analyses that exist."""
        key = self.schema["id"].dataType
        touched = TB.touched_buckets(events.select(F.col("analysis_id").cast(key).alias("id")), buckets=self.buckets)
        known = TB.read_keyed(self.spark, self.analyses, self.schema, touched).select(F.col("id").cast("string").alias("analysis_id"))
        hub = events.where("hub_event is not null").join(known, "analysis_id", "left_semi")
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("repo_name", "string"), ("pr_number", "int"), ("title", "string"), ("author", "string"))]
        hub = hub.select(F.col("hub_event").alias("event"), "seq", *nothing, "analysis_id")
        hub.write.mode("overwrite").parquet(f"{self.root}/notifications/batch={batch_id}")


def status_log(spark: SparkSession, root: str) -> DataFrame:
    return stored(spark, f"{root}/status", STATUS_EVENTS)


def hub_log(spark: SparkSession, root: str) -> DataFrame:
    return stored(spark, f"{root}/notifications", HUB_EVENTS)


def run_job_stream(
    spark: SparkSession,
    source: str,
    root: str,
    retain_hours: int | None = None,
    files_per_batch: int | None = None,
    retry_due: bool = False,
    late_hours: int | None = None,
    sink: StatusSinks | None = None,
) -> DataFrame:
    """K2: take in all job-event files that have arrived and return the state of
    every job. The events that took effect are logged under `effects`, one
    folder a batch; `sink` receives every batch of them as well."""
    reader = spark.readStream.schema(JOB_EVENT_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def apply(batch: DataFrame, batch_id: int) -> None:
        path = f"{root}/effects/batch={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        if sink is not None:
            sink(spark.read.schema(EFFECTS).parquet(path), batch_id)

    out = effects(reader.parquet(source), retain_hours, retry_due, late_hours)
    writer = out.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", f"{root}/_checkpoint")
    with state_provider(spark):
        writer.trigger(availableNow=True).start().awaitTermination()
    return job_table(spark, root)


@contextmanager
def state_provider(spark: SparkSession) -> Iterator[None]:
    """Keyed state of this kind needs Spark's RocksDB provider; a query keeps the
    provider it was started with, so the session's setting is put back."""
    before = spark.conf.get(STATE_PROVIDER, None)
    spark.conf.set(STATE_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_PROVIDER)
        else:
            spark.conf.set(STATE_PROVIDER, before)


def effect_log(spark: SparkSession, root: str) -> DataFrame:
    return stored(spark, f"{root}/effects", EFFECTS)
