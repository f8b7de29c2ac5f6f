"""Job lifecycle over a job-event log.

This records outcomes; it schedules nothing. Events are
(job_id, seq, ts, kind[, message]) with kind in enqueue / dequeue / complete / fail.

Fold semantics (per job, in seq order):
* enqueue   -> Pending, created_at = ts (a re-enqueue resets both); retry count kept
* dequeue   -> Processing, only when Pending (otherwise ignored)
* complete  -> Completed, only when Processing
* fail      -> retry_count + 1, Retrying while the count is below 3, else Failed;
               only when Processing
Events of a job before its first enqueue are ignored.

Between two enqueues the state can only move Pending -> Processing -> terminal,
so each "segment" (events since the latest enqueue) is summarised by: did a
dequeue happen, and which terminal event came first after it. The segment of
every event is a keyed running max (skew-safe, see `scan.running_max`); the
rest is two aggregations with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens import schemas as S
from revlens.operators.scan import DEFAULT_SPAN, running_max

# --- fixed values ---------------------------------------------------------------
MAX_ATTEMPTS = 3
RETRY_DELAY_SECONDS = 5
RETENTION_HOURS = 24
DEFAULT_PENDING_TAKE = 10
ORPHAN_MESSAGE = "Analysis record not found"
# ----------------------------------------------------------------------------------

TERMINAL = ("complete", "fail")


PRIOR_SEQ = -3  # events that stand for a stored state come before all real ones (seq >= 0)


def prior_events(states: DataFrame) -> DataFrame:
    """Stored job states as the events that lead to them, with the retry count
    and error message so far on the enqueue event."""
    done = F.when(F.col("status") == S.JOB_COMPLETED, F.lit("complete")).otherwise(F.lit("fail"))
    step = lambda seq, ts, kind: F.struct(
        F.lit(seq).cast("long").alias("seq"), F.col(ts).alias("ts"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind")
    )
    steps = F.array_compact(
        F.array(
            step(PRIOR_SEQ, "created_at", "enqueue"),
            F.when(F.col("status") != S.JOB_PENDING, step(PRIOR_SEQ + 1, "created_at", "dequeue")),
            F.when(~F.col("status").isin(S.JOB_PENDING, S.JOB_PROCESSING), step(PRIOR_SEQ + 2, "failed_at", done)),
        )
    )
    so_far = F.struct("retry_count", F.col("error_message").alias("message"))
    return states.select("job_id", so_far.alias("so_far"), F.inline(steps))


def job_states(events: DataFrame, prior: DataFrame | None = None, span: int = DEFAULT_SPAN) -> DataFrame:
    """K2 fold: one row per job that was ever enqueued.

    `events` are applied in seq order on top of the `prior` states, if given
    (events of a later batch are applied after those of earlier ones, whatever
    their seq). An optional `message` column holds a failure's text.

    Columns: job_id, status, retry_count, created_at, failed_at, next_attempt_at,
    error_message.
    """
    kind = F.col("kind")
    message = F.col("message") if "message" in events.columns else F.lit(None).cast("string")
    nothing = F.lit(None).cast("struct<retry_count:int,message:string>")
    ev = events.select("job_id", "seq", "ts", "kind", message.alias("message"), nothing.alias("so_far"))
    if prior is not None:
        ev = ev.unionByName(prior_events(prior), allowMissingColumns=True)
    scanned = running_max(
        ev,
        ["job_id"],
        "seq",
        {
            "segment": F.when(kind == "enqueue", F.col("seq")),
            "last_dequeue": F.when(kind == "dequeue", F.col("seq")),
        },
        span=span,
    ).filter(F.col("segment").isNotNull())

    candidate = kind.isin(*TERMINAL) & (F.col("last_dequeue") > F.col("segment"))
    seg = scanned.groupBy("job_id", "segment").agg(
        (F.count_if(kind == "dequeue") > 0).alias("dequeued"),
        F.min(F.when(candidate, F.struct("seq", "kind", "ts", "message"))).alias("term"),
        F.max(F.when(F.col("seq") == F.col("segment"), F.col("ts"))).alias("enqueued_at"),
        F.max("so_far").alias("so_far"),
    )
    new_fail = (F.col("term.kind") == "fail") & (F.col("term.seq") >= 0)
    per_job = seg.groupBy("job_id").agg(
        (F.count_if(new_fail) + F.coalesce(F.max("so_far.retry_count"), F.lit(0))).cast("int").alias("retry_count"),
        F.max(F.struct("segment", "dequeued", "term", "enqueued_at")).alias("last"),
        F.max(F.when(new_fail, F.struct("segment", F.col("term.message").alias("message")))).alias("error"),
        F.max("so_far.message").alias("old_message"),
    )
    rc = F.col("retry_count")
    term_kind = F.col("last.term.kind")
    status = (
        F.when(~F.col("last.dequeued"), F.lit(S.JOB_PENDING))
        .when(term_kind.isNull(), F.lit(S.JOB_PROCESSING))
        .when(term_kind == "complete", F.lit(S.JOB_COMPLETED))
        .when(rc < MAX_ATTEMPTS, F.lit(S.JOB_RETRYING))
        .otherwise(F.lit(S.JOB_FAILED))
    )
    failed_at = F.when(term_kind == "fail", F.col("last.term.ts"))
    return per_job.select(
        "job_id",
        status.alias("status"),
        rc.alias("retry_count"),
        F.col("last.enqueued_at").alias("created_at"),
        failed_at.alias("failed_at"),
        F.when(status == S.JOB_RETRYING, failed_at + F.make_interval(secs=F.lit(RETRY_DELAY_SECONDS))).alias(
            "next_attempt_at"
        ),
        F.when(F.col("error").isNotNull(), F.col("error.message")).otherwise(F.col("old_message")).alias("error_message"),
    )


def effective_events(events: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """The events that change a job's state (every enqueue, the first dequeue
    after it, the first complete/fail after that dequeue), with K5's analysis
    status and hub event: first enqueue -> Pending, dequeue -> InProgress +
    AnalysisUpdated, complete -> Completed + AnalysisCompleted, fail -> Failed.
    A retry's enqueue concerns the job only (status null): the analysis stays
    Failed until the next dequeue."""
    kind = F.col("kind")
    scanned = running_max(
        events.select("job_id", "seq", "ts", "kind"),
        ["job_id"],
        "seq",
        {
            "segment": F.when(kind == "enqueue", F.col("seq")),
            "last_dequeue": F.when(kind == "dequeue", F.col("seq")),
            "enqueues": F.when(kind == "enqueue", F.lit(1)).otherwise(F.lit(0)).cast("long"),
        },
        span=span,
        how={"enqueues": "sum"},
    ).filter(F.col("segment").isNotNull())
    candidate = kind.isin(*TERMINAL) & (F.col("last_dequeue") > F.col("segment"))
    seg = scanned.groupBy("job_id", "segment").agg(
        F.min(F.when(kind == "enqueue", F.struct("seq", "ts", "kind", (F.col("enqueues") == 1).alias("first")))).alias("enq"),
        F.min(F.when(kind == "dequeue", F.struct("seq", "ts", "kind", F.lit(False).alias("first")))).alias("deq"),
        F.min(F.when(candidate, F.struct("seq", "ts", "kind", F.lit(False).alias("first")))).alias("term"),
    )
    out = seg.select("job_id", F.inline(F.array_compact(F.array("enq", "deq", "term"))))
    k = F.col("kind")
    return out.select(
        "job_id",
        "seq",
        "ts",
        "kind",
        F.when(k == "enqueue", F.when(F.col("first"), F.lit(S.ST_PENDING)))
        .when(k == "dequeue", F.lit(S.ST_IN_PROGRESS))
        .when(k == "complete", F.lit(S.ST_COMPLETED))
        .otherwise(F.lit(S.ST_FAILED))
        .alias("analysis_status"),
        F.when(k == "dequeue", F.lit("AnalysisUpdated")).when(k == "complete", F.lit("AnalysisCompleted")).alias(
            "hub_event"
        ),
    )


def apply_status_events(analyses: DataFrame, events: DataFrame, key: str = "analysis_id") -> DataFrame:
    """K5 state update: each analysis takes the analysis status of its latest
    effective job event with a status (a failed attempt marks it Failed, and a
    retry's enqueue does not change that); analyses without job events keep
    their status. `events` carries `key`, seq, ts and analysis_status (see
    `effective_events`); it is reduced to one row per analysis (partial
    aggregation) before the join. A change stamps `updated_at` (F26)."""
    latest = events.filter(F.col("analysis_status").isNotNull()).groupBy(key).agg(F.max(F.struct("seq", "analysis_status", "ts")).alias("_last"))
    j = analyses.join(latest.withColumnRenamed(key, "id"), "id", "left")
    new = {"status": "_last.analysis_status", "updated_at": "_last.ts"}
    return j.select(*[F.coalesce(F.col(new[c]), F.col(c)).alias(c) if c in new else F.col(c) for c in analyses.columns])


def queue_length(states: DataFrame) -> DataFrame:
    """Jobs waiting in the queue (Pending only; Retrying jobs sit in their delay)."""
    return states.agg(F.count_if(F.col("status") == S.JOB_PENDING).cast("int").alias("queue_length"))


def pending_jobs(states: DataFrame, n: int = DEFAULT_PENDING_TAKE) -> DataFrame:
    """The oldest n waiting jobs, FIFO by enqueue time (job id breaks ties)."""
    return states.filter(F.col("status") == S.JOB_PENDING).orderBy("created_at", "job_id").limit(n)


def retention(states: DataFrame, as_of: Column | str, hours: int = RETENTION_HOURS) -> DataFrame:
    """K4: drop finished jobs (Completed / Failed) created more than `hours` before as_of."""
    cutoff = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    cutoff = cutoff - F.make_interval(hours=F.lit(hours))
    finished = F.col("status").isin(S.JOB_COMPLETED, S.JOB_FAILED)
    return states.filter(~(finished & (F.col("created_at") < cutoff)))


def next_attempts(states: DataFrame) -> DataFrame:
    """K3: retrying jobs and when they are due again."""
    return states.filter(F.col("status") == S.JOB_RETRYING).select(
        "job_id", "retry_count", "failed_at", "next_attempt_at"
    )


def attach_analysis(jobs: DataFrame, analyses: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Look up each job's analysis. A job that is being processed without
    one fails that attempt (`fail` above): one retry more, Retrying below the
    limit, the orphan message. Jobs that are not being processed are not looked
    up, so a waiting orphan stays Pending."""
    found = analyses.select(F.col("id").alias(key)).withColumn("_found", F.lit(True))
    j = jobs.join(found, key, "left").withColumn("_found", F.coalesce(F.col("_found"), F.lit(False)))
    fails = ~F.col("_found") & (F.col("status") == S.JOB_PROCESSING)
    retries = F.when(fails, F.col("retry_count") + 1).otherwise(F.col("retry_count"))
    status = F.when(fails, F.when(retries < MAX_ATTEMPTS, F.lit(S.JOB_RETRYING)).otherwise(F.lit(S.JOB_FAILED))).otherwise(F.col("status"))
    return j.select(
        *[c for c in jobs.columns if c not in ("status", "retry_count", "error_message")],
        F.col("_found").alias("analysis_found"),
        status.alias("status"),
        retries.cast("int").alias("retry_count"),
        F.when(fails, F.lit(ORPHAN_MESSAGE)).otherwise(F.col("error_message")).alias("error_message"),
    )
