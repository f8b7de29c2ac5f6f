"""Structured Streaming: feeding and running file streams, and K1.

* K1 `run_state_stream`: webhook event files -> analysis state table.
* K2-K5, S7 are in `lifecycle`, K6 is in `enrich`, A7-A10 as a total in `metrics`.

All folders live under the session's `spark.checkpoint.dir` (shared storage on a
cluster), never in a machine-local temp folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens import schemas as S
from revlens.operators import state as ST
from revlens.operators.notifications import webhook_notifications
from revlens.session import scratch_path
from revlens.sources import tables as TB
from revlens.streaming.enrich import METRIC_COLUMNS, exists, run_enrich_stream, store_diffs
from revlens.streaming.lifecycle import run_job_stream
from revlens.streaming.metrics import RunningMetrics

__all__ = ["batch_log", "feed", "run_available", "run_enrich_stream", "run_job_stream", "run_state_stream", "scratch", "store_diffs"]


def scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


def feed(events: DataFrame, path: str, seq: str, parts: int, run: Callable[[], DataFrame], fmt: str = "parquet") -> DataFrame:
    """Deliver a table to a file stream in `parts` ranges of seq: each range is
    appended by as many tasks as it has partitions, then `run` takes it in.
    Returns what the last run returned."""
    lo, hi = events.agg(F.min(seq), F.max(seq)).first()
    lo, hi = (0, 0) if lo is None else (int(lo), int(hi))
    step = max(1, (hi - lo + parts) // parts)
    out = None
    for i in range(parts):
        part = events.filter((F.col(seq) >= lo + i * step) & (F.col(seq) < lo + (i + 1) * step))
        part.write.mode("append").format(fmt).save(path)
        out = run()
    return out


def run_available(spark: SparkSession, source: str, schema: T.StructType | str, root: str, apply, files_per_batch: int | None = None) -> None:
    """Run a file stream over all files that have arrived; by default one
    micro-batch, or batches of `files_per_batch` files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    writer = reader.parquet(source).writeStream.foreachBatch(apply)
    writer.option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start().awaitTermination()


def batch_log(spark: SparkSession, root: str) -> DataFrame:
    """One row of counts per micro-batch so far; empty before the first."""
    try:
        return spark.read.parquet(f"{root}/batches").drop("batch")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "batch_id long")


# --- K1 ------------------------------------------------------------------------------
RAW_EVENT = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("raw", T.StringType()),
    ]
)
EVENTS = "seq long, ts timestamp, action string, repo_name string, pr_number int, pr_title string, pr_author string"


class StateStep:
    """K1 for one micro-batch, step by step, each stored before the next one:

    1. the parsed events (S1), and one row of counts: all, malformed, rejected and
       those without a repository or PR number, which are left out (T21);
    2. the old and the new rows of the events' keys (J3, J4), under the batch's
       number, with a mark that is written after them;
    3. the table takes the new rows, in the folders of the keys only;
    4. the dashboard's numbers take the old rows out and the new ones in;
    5. the batch's notifications (S7) are written under its number.

    A batch that is repeated after a crash finds the mark of step 2 and goes on
    with the same rows, so no step is applied twice."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = TB.BUCKETS) -> None:
        self.spark, self.root, self.table, self.buckets = spark, root, f"{root}/analyses", buckets
        self.metrics = RunningMetrics(spark, root)

    def events(self, batch: DataFrame, batch_id: int) -> DataFrame:
        from revlens.sources.webhooks import MALFORMED, OK, REJECTED, parse_pr_events

        path = f"{self.root}/events/slot={batch_id % 2}"
        parse_pr_events(batch, "raw").write.mode("overwrite").parquet(path)
        parsed = self.spark.read.schema(f"parse_status string, {EVENTS}").parquet(path)
        status, targeted = F.col("parse_status"), (F.col("repo_name") != "") & (F.col("pr_number") != 0)
        counts = parsed.agg(
            F.lit(batch_id).cast("long").alias("batch_id"),
            F.count("*").alias("events"),
            F.count_if(status == MALFORMED).alias("malformed"),
            F.count_if(status == REJECTED).alias("rejected"),
            F.count_if((status == OK) & ~targeted).alias("without_target"),
        )
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/batches/batch={batch_id}")
        return parsed.where((status == OK) & targeted).drop("parse_status")

    def changes(self, events: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Keys, old rows and new rows of the batch, worked out once."""
        path, mark = f"{self.root}/changes/batch={batch_id}", f"{self.root}/changed/batch={batch_id}"
        if not exists(self.spark, mark):
            events.select(*ST.KEY).distinct().write.mode("overwrite").parquet(f"{path}/keys")
            keys = self.spark.read.parquet(f"{path}/keys")
            touched = TB.touched_buckets(keys, ST.KEY, self.buckets)
            old = self.stored(touched).join(keys, ST.KEY, "left_semi")
            old.write.mode("overwrite").parquet(f"{path}/old")
            old = self.spark.read.schema(S.ANALYSES).parquet(f"{path}/old")
            ST.apply_batch(old, events).write.mode("overwrite").parquet(f"{path}/new")
            self.spark.range(1).select(F.lit(True).alias("done")).write.mode("overwrite").parquet(mark)
        keys = self.spark.read.parquet(f"{path}/keys")
        return keys, *(self.spark.read.schema(S.ANALYSES).parquet(f"{path}/{p}") for p in ("old", "new"))

    def stored(self, touched: list[int] | None = None) -> DataFrame:
        """The table, or some of its folders; empty before the first batch."""
        try:
            return TB.read_keyed(self.spark, self.table, S.ANALYSES, touched).drop("bucket")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            TB.store_keyed(self.spark.createDataFrame([], S.ANALYSES), self.table, ST.KEY, self.buckets)
            return self.spark.createDataFrame([], S.ANALYSES)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        events = self.events(batch, batch_id)
        keys, old, new = self.changes(events, batch_id)
        TB.replace_keys(self.spark, self.table, S.ANALYSES, keys, new, ST.KEY, self.buckets)
        self.metrics.change(old.select(*METRIC_COLUMNS), new.select(*METRIC_COLUMNS), batch_id)
        sent = webhook_notifications(events, old.select("id", *ST.KEY))
        sent.write.mode("overwrite").parquet(f"{self.root}/notifications/batch={batch_id}")


def run_state_stream(spark: SparkSession, source: str, root: str, files_per_batch: int | None = None, buckets: int = TB.BUCKETS) -> DataFrame:
    """K1: take in all webhook files that have arrived and return the analysis
    table. Source rows are (seq, ts, raw webhook JSON); the events of a batch are
    applied in seq order, batches in the order of arrival. `StateStep` says what
    a batch does; the table lies under `analyses`, A7's numbers under `metrics`."""
    step = StateStep(spark, root, buckets)
    run_available(spark, source, RAW_EVENT, root, step, files_per_batch)
    return step.stored()
