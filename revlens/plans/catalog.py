"""Registered queries over the driver tables, each with its DuckDB oracle.

`QUERIES[name](spark, sf_dir) -> DataFrame`; `ORACLE[name]` is ANSI SQL over the
same parquet views. Column names are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens import schemas as S
from revlens.functions import labels as L
from revlens.operators import queue as Q
from revlens.operators import scoring as SC
from revlens.operators import serving as SV
from revlens.plans import proxies as P
from revlens.plans.proxies import sql_with
from revlens.plans.reviewers import fragile_responder, stub_responder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Fixed parameters of the registered queries.
AS_OF = "2024-01-20 00:00:00"
PAGE_SKIP, PAGE_TAKE = 20, 10
REPO = "org/repo-7"


def register(name: str, sql: str | None = None):
    """Register a query; the stored times are UTC, so every query runs with a UTC
    session time zone whatever session the caller passes in."""

    def deco(fn):
        def run(spark: SparkSession, d: str) -> DataFrame:
            if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, d)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# ---------------------------------------------------------------------------
# Shared building blocks
def scored(spark: SparkSession, d: str) -> DataFrame:
    return SC.score_analyses(P.analyses(spark, d), P.findings(spark, d), P.suggestions(spark, d))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    return Q.job_states(P.job_events(spark, d))


def job_analysis_id() -> Column:
    """The proxy's analysis of a job."""
    parts = F.split(F.col("job_id"), "-")
    return parts[0].cast("long") * 100 + parts[1].cast("long")


def with_analysis_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("analysis_id", job_analysis_id())


SQL_SCORED = {
    "f_stats": """
        SELECT analysis_id,
               SUM(CASE severity WHEN 2 THEN 10 WHEN 1 THEN 5 WHEN 0 THEN 1 ELSE 0 END) AS pen,
               COUNT(*) FILTER (WHERE severity = 2) AS errors,
               COUNT(*) FILTER (WHERE severity = 1) AS warnings,
               COUNT(*) AS n
        FROM v_findings GROUP BY analysis_id""",
    "s_stats": """
        SELECT analysis_id,
               SUM(CASE priority WHEN 3 THEN 15 WHEN 2 THEN 10 WHEN 1 THEN 5 WHEN 0 THEN 2 ELSE 0 END) AS pen,
               COUNT(*) AS n
        FROM v_suggestions GROUP BY analysis_id""",
    "scored0": """
        SELECT a.*,
               CAST(greatest(0, 100 - coalesce(f.pen, 0)) AS INTEGER) AS finding_score,
               CAST(greatest(0, 100 - coalesce(s.pen, 0)) AS INTEGER) AS suggestion_score,
               CAST(coalesce(f.errors, 0) AS INTEGER) AS errors,
               CAST(coalesce(f.warnings, 0) AS INTEGER) AS warnings,
               CAST(coalesce(f.n, 0) AS INTEGER) AS finding_count,
               CAST(coalesce(s.n, 0) AS INTEGER) AS suggestion_count
        FROM v_analyses a LEFT JOIN f_stats f ON a.id = f.analysis_id
                          LEFT JOIN s_stats s ON a.id = s.analysis_id""",
    "v_scored": """
        SELECT *,
               CASE WHEN errors >= 5 THEN 2 WHEN errors >= 1 AND warnings >= 10 THEN 2
                    WHEN errors >= 1 THEN 1 WHEN warnings >= 15 THEN 1 ELSE 0 END AS risk_level,
               CAST(trunc(finding_score * 0.6::DOUBLE + suggestion_score * 0.4::DOUBLE) AS INTEGER) AS quality_score
        FROM scored0""",
}


def with_scored(*more: str, extra: dict[str, str] | None = None) -> str:
    ex = dict(SQL_SCORED)
    ex.update(extra or {})
    return sql_with("v_analyses", "v_findings", "v_suggestions", *more, extra=ex)


# The job life cycle as a fold over each job's events, one event a step:
# enqueue sets Pending, dequeue takes a Pending job, complete and fail end a
# Processing one; a third failure is final.
SQL_JOBS = {
    "je": """
        SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n FROM v_job_events""",
    "jfold": """
        SELECT job_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS kind,
               CAST(NULL AS INTEGER) AS was, CAST(NULL AS INTEGER) AS status, 0 AS retry_count,
               CAST(NULL AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS failed_at,
               CAST(NULL AS VARCHAR) AS error_message, false AS effective
        FROM (SELECT DISTINCT job_id FROM v_job_events)
        UNION ALL
        SELECT f.job_id, e.n, e.seq, e.kind, f.status,
               CASE WHEN e.kind = 'enqueue' THEN 0
                    WHEN e.kind = 'dequeue' AND f.status = 0 THEN 1
                    WHEN e.kind = 'complete' AND f.status = 1 THEN 2
                    WHEN e.kind = 'fail' AND f.status = 1 THEN CASE WHEN f.retry_count + 1 < 3 THEN 4 ELSE 3 END
                    ELSE f.status END,
               CASE WHEN e.kind = 'fail' AND f.status = 1 THEN f.retry_count + 1 ELSE f.retry_count END,
               CASE WHEN e.kind = 'enqueue' THEN e.ts ELSE f.created_at END,
               CASE WHEN e.kind = 'enqueue' THEN NULL WHEN e.kind = 'fail' AND f.status = 1 THEN e.ts ELSE f.failed_at END,
               CASE WHEN e.kind = 'fail' AND f.status = 1 THEN e.message ELSE f.error_message END,
               e.kind = 'enqueue' OR (e.kind = 'dequeue' AND f.status = 0)
                 OR (e.kind IN ('complete', 'fail') AND f.status = 1)
        FROM jfold f JOIN je e ON e.job_id = f.job_id AND e.n = f.n + 1""",
    "v_jobs": """
        SELECT job_id, status, retry_count, created_at, failed_at,
               CASE WHEN status = 4 THEN failed_at + INTERVAL 5 SECOND END AS next_attempt_at, error_message
        FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC) AS back FROM jfold)
        WHERE back = 1 AND status IS NOT NULL""",
}


def with_jobs(*more: str, extra: dict[str, str] | None = None) -> str:
    ex = dict(SQL_JOBS)
    ex.update(extra or {})
    return sql_with("v_job_events", *more, extra=ex)


def with_scored_jobs(extra: dict[str, str] | None = None) -> str:
    ex = dict(SQL_SCORED)
    ex.update(SQL_JOBS)
    ex.update(extra or {})
    return sql_with("v_analyses", "v_findings", "v_suggestions", "v_job_events", extra=ex)


# ---------------------------------------------------------------------------
# Scores per analysis
@register(
    "analysis_scores",
    with_scored()
    + """SELECT id, finding_score, suggestion_score, errors, warnings, finding_count, suggestion_count,
               risk_level, quality_score FROM v_scored""",
)
def analysis_scores(spark, d):
    return scored(spark, d).select(
        "id",
        "finding_score",
        "suggestion_score",
        "errors",
        "warnings",
        "finding_count",
        "suggestion_count",
        "risk_level",
        "quality_score",
    )


SQL_METRICS = """
    SELECT CAST(count(*) AS INTEGER) AS total,
           CAST(count(*) FILTER (WHERE quality_score >= 90) AS INTEGER) AS high_quality,
           CAST(count(*) FILTER (WHERE quality_score >= 70 AND quality_score < 90) AS INTEGER) AS medium_quality,
           CAST(count(*) FILTER (WHERE quality_score < 70) AS INTEGER) AS low_quality,
           CAST(coalesce(round_even(avg(quality_score), 0), 0) AS INTEGER) AS average_score,
           CAST(count(*) FILTER (WHERE risk_level = 2) AS INTEGER) AS high_risk,
           CAST(count(*) FILTER (WHERE risk_level = 1) AS INTEGER) AS medium_risk,
           CAST(count(*) FILTER (WHERE risk_level = 0) AS INTEGER) AS low_risk
    FROM v_scored"""


@register("quality_metrics", with_scored() + SQL_METRICS)
def quality_metrics(spark, d):
    return SV.quality_metrics(scored(spark, d))


@register(
    "risk_distribution",
    with_scored(extra={"m": SQL_METRICS}) + "SELECT high_risk AS high, medium_risk AS medium, low_risk AS low FROM m",
)
def risk_distribution(spark, d):
    return SV.risk_distribution(SV.quality_metrics(scored(spark, d)))


@register(
    "quality_distribution",
    with_scored(extra={"m": SQL_METRICS})
    + "SELECT high_quality AS excellent, medium_quality AS good, low_quality AS needs_improvement FROM m",
)
def quality_distribution(spark, d):
    return SV.quality_distribution(SV.quality_metrics(scored(spark, d)))


SQL_LIST = """
    SELECT id, repo_name, pr_number, pr_title, pr_author,
           CASE status WHEN 0 THEN 'Pending' WHEN 1 THEN 'InProgress' WHEN 2 THEN 'Completed'
                       WHEN 3 THEN 'Failed' END AS status,
           quality_score,
           CASE risk_level WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' END AS risk_level,
           processed_at, created_at
    FROM v_scored"""


@register(
    "dashboard",
    with_scored_jobs(
        extra={
            "m": SQL_METRICS,
            "top": SQL_LIST + " ORDER BY processed_at DESC, id LIMIT 5",
            "r": """SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY processed_at DESC, id) AS recent_ids,
                           string_agg(CAST(quality_score AS VARCHAR), ',' ORDER BY processed_at DESC, id)
                             AS recent_scores,
                           CAST(count(*) AS INTEGER) AS recent_count FROM top""",
            "qn": "SELECT CAST(count(*) FILTER (WHERE status = 0) AS INTEGER) AS queue_length FROM v_jobs",
        }
    )
    + """SELECT m.total AS total_analyses, m.average_score AS average_quality_score,
               m.high_quality AS high_quality_count, m.medium_quality AS medium_quality_count,
               m.low_quality AS low_quality_count, m.high_risk AS risk_high, m.medium_risk AS risk_medium,
               m.low_risk AS risk_low,
               CASE WHEN m.average_score >= 80 THEN 'excellent' WHEN m.average_score >= 60 THEN 'good'
                    WHEN m.average_score >= 40 THEN 'fair' ELSE 'poor' END AS quality_band,
               r.recent_ids, r.recent_scores, r.recent_count,
               qn.queue_length AS pending_analyses, qn.queue_length, qn.queue_length < 50 AS is_healthy,
               CASE WHEN qn.queue_length = 0 THEN 'Queue is empty' WHEN qn.queue_length = 1 THEN '1 analysis waiting'
                    ELSE CAST(qn.queue_length AS VARCHAR) || ' analyses waiting' END AS queue_caption,
               0 AS recent_notification_count
        FROM m, r, qn""",
)
def dashboard(spark, d):
    from revlens.session import materialize

    # The dashboard reads the analysis table twice (metrics and the recent
    # list, each pruned to different columns). Score once and store the
    # table in the shared checkpoint folder, as the service reads its stored
    # table, so the findings / suggestions scans are not repeated per branch.
    cols = ["id", "repo_name", "pr_number", "pr_title", "pr_author", "status", "quality_score", "risk_level",
            "processed_at", "created_at"]
    table = materialize(scored(spark, d).select(*cols), "analyses-scored")
    ql = Q.queue_length(jobs(spark, d))
    row = SV.dashboard(table, ql)
    return row.select(
        "total_analyses",
        "average_quality_score",
        "high_quality_count",
        "medium_quality_count",
        "low_quality_count",
        "risk_high",
        "risk_medium",
        "risk_low",
        "quality_band",
        F.array_join(F.transform("recent_analyses", lambda x: x["id"].cast("string")), ",").alias("recent_ids"),
        F.array_join(F.transform("recent_analyses", lambda x: x["quality_score"].cast("string")), ",").alias(
            "recent_scores"
        ),
        F.size("recent_analyses").alias("recent_count"),
        "pending_analyses",
        "queue_length",
        "is_healthy",
        "queue_caption",
        F.size("recent_notifications").alias("recent_notification_count"),
    )


@register(
    "dashboard_recent",
    with_scored(extra={"l": SQL_LIST})
    + """SELECT row_number() OVER (ORDER BY processed_at DESC, id) - 1 AS position, id, repo_name, pr_number, pr_title, pr_author,
               status, quality_score, risk_level, processed_at
         FROM l ORDER BY processed_at DESC, id LIMIT 5""",
)
def dashboard_recent(spark, d):
    """A10: the rows of the dashboard's recent list."""
    row = SV.dashboard(scored(spark, d), Q.queue_length(jobs(spark, d)))
    return row.select(F.posexplode("recent_analyses").alias("position", "a")).select(F.col("position").cast("long").alias("position"), "a.*")


# ---------------------------------------------------------------------------
# Lists and pages
@register(
    "analysis_page",
    with_scored(extra={"l": SQL_LIST})
    + f"SELECT * FROM l ORDER BY processed_at DESC, id LIMIT {PAGE_TAKE} OFFSET {PAGE_SKIP}",
)
def analysis_page(spark, d):
    return SV.analysis_list(SV.page(scored(spark, d), PAGE_SKIP, PAGE_TAKE))


@register(
    "recent_analyses",
    with_scored(extra={"l": SQL_LIST}) + "SELECT * FROM l ORDER BY processed_at DESC, id LIMIT 5",
)
def recent_analyses(spark, d):
    return SV.analysis_list(SV.recent(scored(spark, d)))


@register(
    "repo_page",
    with_scored(extra={"l": SQL_LIST})
    + f"SELECT * FROM l WHERE repo_name = '{REPO}' ORDER BY processed_at DESC, id LIMIT {SV.SERVICE_PAGE_SIZE}",
)
def repo_page(spark, d):
    return SV.analysis_list(SV.page(SV.by_repo(scored(spark, d), REPO), 0, SV.SERVICE_PAGE_SIZE))


DEEP_SKIP, DEEP_TAKE = 1234, 25


@register(
    "deep_page",
    sql_with("v_analyses") + f"SELECT id, repo_name, processed_at FROM v_analyses ORDER BY processed_at DESC, id LIMIT {DEEP_TAKE} OFFSET {DEEP_SKIP}",
)
def deep_page(spark, d):
    """W2 at depth through the index of places: equal to OFFSET on tied times."""
    rows = P.analyses(spark, d).select("id", "repo_name", "processed_at")
    return SV.page_at(rows, SV.page_index(rows, step=100), DEEP_SKIP, DEEP_TAKE)


@register(
    "next_page",
    sql_with("v_analyses")
    + f"""SELECT id, repo_name, processed_at FROM v_analyses ORDER BY processed_at DESC, id
          LIMIT {SV.SERVICE_PAGE_SIZE} OFFSET {2 * SV.SERVICE_PAGE_SIZE}""",
)
def next_page(spark, d):
    """The third page, sought behind the last row of the second."""
    rows, last = P.analyses(spark, d).select("id", "repo_name", "processed_at"), None
    for _ in range(2):
        end = SV.page_after(rows, last).orderBy(*SV.page_order()).tail(1)
        last = (end[0]["processed_at"], end[0]["id"]) if end else last
    return SV.page_after(rows, last)


@register(
    "clustered_lookup",
    sql_with("v_analyses")
    + f"SELECT id, repo_name, pr_title, processed_at FROM v_analyses WHERE repo_name = '{REPO}' AND processed_at >= DATE '1996-01-01' OR id IN (42, 7)",
)
def clustered_lookup(spark, d):
    """P2, P5 on a table that is range-sorted by (repo_name, processed_at) with
    Bloom filters on the id."""
    from revlens.sources import tables as TB
    from revlens.streaming.jobs import scratch

    path = scratch(spark, "analyses-clustered")
    TB.store_clustered(P.analyses(spark, d), path)
    rows = spark.read.parquet(path).select("id", "repo_name", "pr_title", "processed_at")
    recent = SV.by_repo(rows, REPO).where(F.col("processed_at") >= F.lit("1996-01-01").cast("timestamp"))
    some = [SV.get_by_id(rows, i).where((F.col("repo_name") != REPO) | (F.col("processed_at") < F.lit("1996-01-01").cast("timestamp"))) for i in (42, 7)]
    return recent.unionByName(some[0]).unionByName(some[1])


# P1-P3, X1
@register(
    "find",
    with_scored()
    + "SELECT id, repo_name, quality_score, risk_level FROM v_scored WHERE quality_score < 60 AND status = 2",
)
def find(spark, d):
    pred = (F.col("quality_score") < 60) & (F.col("status") == 2)
    return SV.find(scored(spark, d), pred).select("id", "repo_name", "quality_score", "risk_level")


@register(
    "get_by_id",
    with_scored() + "SELECT id, pr_title, pr_author, quality_score FROM v_scored WHERE id = 42",
)
def get_by_id(spark, d):
    return SV.get_by_id(scored(spark, d), 42).select("id", "pr_title", "pr_author", "quality_score")


@register(
    "first_match",
    with_scored()
    + """SELECT id, repo_name, pr_number FROM v_scored
         WHERE repo_name = 'org/repo-3' AND pr_number > 100 ORDER BY id LIMIT 1""",
)
def first_match(spark, d):
    pred = (F.col("repo_name") == "org/repo-3") & (F.col("pr_number") > 100)
    return SV.first_or_default(scored(spark, d), pred).select("id", "repo_name", "pr_number")


# P10, A4
@register(
    "high_risk_errors",
    with_scored()
    + """SELECT f.analysis_id, f.id, f.rule_id, f.file_path, f.line_number FROM v_findings f
         WHERE f.severity = 2 AND f.analysis_id IN (SELECT id FROM v_scored WHERE risk_level = 2)""",
)
def high_risk_errors(spark, d):
    return SV.high_risk_errors(scored(spark, d), P.findings(spark, d)).select(
        "analysis_id", "id", "rule_id", "file_path", "line_number"
    )


# Labels of the list view
@register(
    "display_labels",
    with_scored(extra={"l": SQL_LIST})
    + """SELECT id,
           CASE WHEN pr_title IS NULL OR pr_title = '' THEN 'Untitled Pull Request'
                WHEN length(pr_title) > 60 THEN substr(pr_title, 1, 60) || '...' ELSE pr_title END AS title,
           CASE WHEN repo_name IS NULL OR repo_name = '' THEN 'Unknown Repository'
                ELSE string_split(repo_name, '/')[-1] END AS repo_short,
           CASE WHEN quality_score >= 80 THEN 'excellent' WHEN quality_score >= 60 THEN 'good'
                WHEN quality_score >= 40 THEN 'fair' ELSE 'poor' END AS quality_band,
           CASE lower(risk_level) WHEN 'high' THEN 'high-risk' WHEN 'medium' THEN 'medium-risk'
                WHEN 'low' THEN 'low-risk' ELSE 'unknown-risk' END AS risk_class,
           CASE WHEN lower(status) = 'completed' THEN 'completed' WHEN lower(status) = 'pending' THEN 'pending'
                WHEN lower(status) IN ('processing', 'inprogress') THEN 'processing'
                WHEN lower(status) = 'failed' THEN 'failed' ELSE 'unknown' END AS status_class
         FROM l""",
)
def display_labels(spark, d):
    lst = SV.analysis_list(scored(spark, d))
    return lst.select(
        "id",
        L.display_title("pr_title").alias("title"),
        L.repo_short_name("repo_name").alias("repo_short"),
        L.quality_band("quality_score").alias("quality_band"),
        L.risk_class("risk_level").alias("risk_class"),
        L.status_class("status").alias("status_class"),
    )


@register(
    "relative_age",
    sql_with("v_webhooks")
    + f"""SELECT seq,
           CASE WHEN us >= 604800000000 THEN CAST(us // 604800000000 AS VARCHAR) || ' week(s) ago'
                WHEN us >= 86400000000 THEN CAST(us // 86400000000 AS VARCHAR) || ' day(s) ago'
                WHEN us >= 3600000000 THEN CAST(us // 3600000000 AS VARCHAR) || ' hour(s) ago'
                WHEN us >= 60000000 THEN CAST(us // 60000000 AS VARCHAR) || ' minute(s) ago'
                ELSE 'Just now' END AS age
         FROM (SELECT seq, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts) AS us FROM v_webhooks)""",
)
def relative_age(spark, d):
    w = P.webhook_rows(spark, d)
    return w.select("seq", L.relative_age(F.col("ts"), F.lit(AS_OF)).alias("age"))


@register(
    "details_gate",
    with_scored(extra={"l": SQL_LIST})
    + """SELECT id, lower(status) = 'completed' AS details_available,
           CASE WHEN lower(status) = 'completed' THEN 'View details'
                ELSE 'Details available after completion' END AS details_caption FROM l""",
)
def details_gate(spark, d):
    lst = SV.analysis_list(scored(spark, d))
    return lst.select(
        "id", L.details_available("status").alias("details_available"), L.details_caption("status").alias("details_caption")
    )


# ---------------------------------------------------------------------------
# Job lifecycle
@register("job_states", with_jobs() + "SELECT * FROM v_jobs")
def job_states(spark, d):
    return jobs(spark, d)


@register(
    "pending_jobs",
    with_jobs() + "SELECT job_id, created_at FROM v_jobs WHERE status = 0 ORDER BY created_at, job_id LIMIT 10",
)
def pending_jobs(spark, d):
    return Q.pending_jobs(jobs(spark, d)).select("job_id", "created_at")


@register(
    "job_retention",
    with_jobs()
    + f"""SELECT job_id, status FROM v_jobs
         WHERE NOT (status IN (2, 3) AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR)""",
)
def job_retention(spark, d):
    return Q.retention(jobs(spark, d), AS_OF).select("job_id", "status")


@register(
    "next_attempt",
    with_jobs() + "SELECT job_id, retry_count, failed_at, next_attempt_at FROM v_jobs WHERE status = 4",
)
def next_attempt(spark, d):
    return Q.next_attempts(jobs(spark, d))


# An attempt at a job without an analysis record fails like any other.
@register(
    "orphan_jobs",
    with_jobs(
        "v_analyses",
        extra={
            "looked_up": """SELECT j.*, a.id IS NOT NULL AS analysis_found, a.id IS NULL AND j.status = 1 AS fails
                            FROM (SELECT *, CAST(split_part(job_id, '-', 1) AS BIGINT) * 100
                                              + CAST(split_part(job_id, '-', 2) AS BIGINT) AS analysis_id
                                  FROM v_jobs) j
                            LEFT JOIN v_analyses a ON a.id = j.analysis_id""",
        },
    )
    + """SELECT job_id, analysis_id, analysis_found,
               CASE WHEN NOT fails THEN status WHEN retry_count >= 2 THEN 3 ELSE 4 END AS status,
               CASE WHEN fails THEN retry_count + 1 ELSE retry_count END AS retry_count,
               CASE WHEN fails THEN 'Analysis record not found' ELSE error_message END AS error_message
         FROM looked_up""",
)
def orphan_jobs(spark, d):
    js = with_analysis_id(jobs(spark, d).select("job_id", "status", "retry_count", "error_message"))
    return Q.attach_analysis(js, P.analyses(spark, d)).select(
        "job_id", "analysis_id", "analysis_found", "status", "retry_count", "error_message"
    )


@register(
    "queue_status",
    with_jobs()
    + """SELECT queue_length, queue_length < 50 AS is_healthy,
           CASE WHEN queue_length = 0 THEN 'Queue is empty' WHEN queue_length = 1 THEN '1 analysis waiting'
                ELSE CAST(queue_length AS VARCHAR) || ' analyses waiting' END AS queue_caption
         FROM (SELECT CAST(count(*) FILTER (WHERE status = 0) AS INTEGER) AS queue_length FROM v_jobs)""",
)
def queue_status(spark, d):
    return SV.queue_status(Q.queue_length(jobs(spark, d)))


# ---------------------------------------------------------------------------
# Webhook payloads built from events, parsed back
def webhook_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Events as raw webhook JSON; every 50th seq (offsets 7/8/9) carries a
    missing pull_request, an explicit null pull_request, or cut-off text."""
    from revlens.sources.webhooks import encode_pr_event

    w = P.webhook_rows(spark, d)
    full = encode_pr_event(
        F.col("action"), F.col("repo_name"), F.col("pr_number"), F.col("pr_title"), F.col("pr_author"), F.col("ts")
    )
    repo = F.struct(
        F.element_at(F.split("repo_name", "/"), -1).alias("name"),
        F.col("repo_name").alias("full_name"),
        F.struct(F.split("repo_name", "/")[0].alias("login")).alias("owner"),
    )
    no_pr = F.to_json(F.struct(F.col("action"), repo.alias("repository")))
    null_pr = F.to_json(
        F.struct(F.col("action"), F.lit(None).cast("string").alias("pull_request"), repo.alias("repository")),
        {"ignoreNullFields": "false"},
    )
    m = F.col("seq") % 50
    raw = (
        F.when(m == 7, no_pr)
        .when(m == 8, null_pr)
        .when(m == 9, F.substring(full, 1, 25))
        .otherwise(full)
    )
    return w.select("seq", "ts", raw.alias("raw"))


SQL_WEBHOOK_FLAT = """
    SELECT seq,
           CASE WHEN seq % 50 = 9 THEN 'malformed' WHEN seq % 50 = 8 THEN 'rejected' ELSE 'ok' END AS parse_status,
           CASE WHEN seq % 50 = 9 THEN '' ELSE action END AS action,
           CASE WHEN seq % 50 = 9 THEN '' ELSE repo_name END AS repo_name,
           CAST(CASE WHEN seq % 50 IN (7, 8, 9) THEN 0 ELSE pr_number END AS INTEGER) AS pr_number,
           CASE WHEN seq % 50 IN (7, 8, 9) THEN '' ELSE pr_title END AS pr_title,
           CASE WHEN seq % 50 IN (7, 8, 9) THEN '' ELSE pr_author END AS pr_author
    FROM v_webhooks"""


@register("webhook_flat", sql_with("v_webhooks") + SQL_WEBHOOK_FLAT)
def webhook_flat(spark, d):
    from revlens.sources.webhooks import parse_pr_events

    ev = parse_pr_events(webhook_payloads(spark, d), "raw")
    return ev.select("seq", "parse_status", "action", "repo_name", "pr_number", "pr_title", "pr_author")


@register(
    "webhook_route",
    sql_with("v_webhooks", extra={"f": SQL_WEBHOOK_FLAT})
    + """SELECT seq, parse_status,
           CASE WHEN parse_status <> 'ok' THEN 'reject'
                WHEN action IN ('opened', 'synchronize', 'reopened') THEN 'upsert'
                WHEN action = 'closed' THEN 'delete' ELSE 'ignore' END AS route
         FROM f""",
)
def webhook_route(spark, d):
    from revlens.operators.state import route_action
    from revlens.sources.webhooks import parse_pr_events

    ev = parse_pr_events(webhook_payloads(spark, d), "raw")
    route = F.when(F.col("parse_status") != "ok", F.lit("reject")).otherwise(
        F.coalesce(route_action("action"), F.lit("ignore"))
    )
    return ev.select("seq", "parse_status", route.alias("route"))


# ---------------------------------------------------------------------------
# Analysis state from the event log
SPLIT_SEQ = 5000

SQL_EV = {
    "ev": """SELECT *, CASE WHEN action IN ('opened', 'synchronize', 'reopened') THEN 'upsert'
                            WHEN action = 'closed' THEN 'delete' END AS route
             FROM v_webhooks""",
}
SQL_REPLAY = dict(SQL_EV)
SQL_REPLAY.update(
    {
        "lc": "SELECT repo_name, pr_number, max(seq) AS last_close FROM ev WHERE route = 'delete' GROUP BY ALL",
        "live": """SELECT e.* FROM ev e LEFT JOIN lc ON e.repo_name = lc.repo_name AND e.pr_number = lc.pr_number
                   WHERE e.route = 'upsert' AND (lc.last_close IS NULL OR e.seq > lc.last_close)""",
        "alive": """SELECT repo_name, pr_number, min(seq) AS first_seq, arg_min(ts, seq) AS created,
                           arg_max(pr_title, seq) AS pr_title, arg_max(pr_author, seq) AS pr_author,
                           arg_max(ts, seq) AS updated
                    FROM live GROUP BY ALL""",
        "v_state": """SELECT sha256(repo_name || '#' || CAST(pr_number AS VARCHAR) || '#' || CAST(first_seq AS VARCHAR))
                               AS id,
                             repo_name, pr_number, pr_title, pr_author, '' AS summary, 0 AS quality_score,
                             '[]' AS findings_json, '[]' AS suggestions_json, 0 AS risk_level,
                             created AS processed_at, '' AS raw_diff, 0 AS status, created AS created_at,
                             updated AS updated_at
                      FROM alive""",
    }
)
STATE_COLS = "id, repo_name, pr_number, pr_title, pr_author, status, quality_score, risk_level, created_at, updated_at"


@register("replay_state", sql_with("v_webhooks", extra=SQL_REPLAY) + f"SELECT {STATE_COLS} FROM v_state")
def replay_state(spark, d):
    from revlens.operators import state as ST

    return ST.replay(P.webhook_rows(spark, d)).select(*[c.strip() for c in STATE_COLS.split(",")])


@register("upsert_state", sql_with("v_webhooks", extra=SQL_REPLAY) + f"SELECT {STATE_COLS} FROM v_state")
def upsert_state(spark, d):
    """Incremental: replay the first part of the log, then apply the rest as one batch."""
    from revlens.operators import state as ST

    ev = P.webhook_rows(spark, d)
    s0 = ST.replay(ev.filter(F.col("seq") < SPLIT_SEQ))
    s1 = ST.apply_batch(s0, ev.filter(F.col("seq") >= SPLIT_SEQ))
    return s1.select(*[c.strip() for c in STATE_COLS.split(",")])


SQL_SEGMENTS = dict(SQL_EV)
SQL_SEGMENTS.update(
    {
        "ev2": """SELECT repo_name, pr_number, seq, ts, pr_title, pr_author, route,
                     max(CASE WHEN route = 'delete' THEN seq END) OVER wp AS prev_close,
                     max(CASE WHEN route = 'upsert' THEN seq END) OVER wp AS prev_upsert,
                     max(CASE WHEN route = 'delete' THEN seq END) OVER wc AS seg
                  FROM ev WHERE route IS NOT NULL
                  WINDOW wp AS (PARTITION BY repo_name, pr_number ORDER BY seq
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                         wc AS (PARTITION BY repo_name, pr_number ORDER BY seq
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "creators": """SELECT repo_name, pr_number, coalesce(seg, -1) AS seg, min(seq) AS creator_seq,
                              arg_min(ts, seq) AS ts, arg_min(pr_title, seq) AS pr_title,
                              arg_min(pr_author, seq) AS pr_author
                       FROM ev2 WHERE route = 'upsert' GROUP BY ALL""",
    }
)


@register(
    "closed_report",
    sql_with("v_webhooks", extra=SQL_SEGMENTS)
    + """SELECT c.seq, c.repo_name, c.pr_number,
           CASE WHEN coalesce(c.prev_upsert > coalesce(c.prev_close, -1), false) THEN 'deleted'
                ELSE 'no analysis found' END AS outcome,
           CASE WHEN coalesce(c.prev_upsert > coalesce(c.prev_close, -1), false)
                THEN sha256(c.repo_name || '#' || CAST(c.pr_number AS VARCHAR) || '#' || CAST(k.creator_seq AS VARCHAR))
                END AS analysis_id
         FROM ev2 c LEFT JOIN creators k
           ON k.repo_name = c.repo_name AND k.pr_number = c.pr_number AND k.seg = coalesce(c.prev_close, -1)
         WHERE c.route = 'delete'""",
)
def closed_report(spark, d):
    from revlens.operators import state as ST

    return ST.closed_report(P.webhook_rows(spark, d)).drop("pr_title")


@register(
    "insert_rows",
    sql_with("v_webhooks", extra=SQL_SEGMENTS)
    + """SELECT sha256(repo_name || '#' || CAST(pr_number AS VARCHAR) || '#' || CAST(creator_seq AS VARCHAR)) AS id,
               repo_name, pr_number, pr_title, pr_author, '' AS summary, 0 AS quality_score, '[]' AS findings_json,
               '[]' AS suggestions_json, 0 AS risk_level, ts AS processed_at, '' AS raw_diff, 0 AS status,
               ts AS created_at, ts AS updated_at
         FROM creators""",
)
def insert_rows(spark, d):
    from revlens.operators import state as ST

    return ST.inserted_rows(P.webhook_rows(spark, d))


@register(
    "replace_rows",
    with_scored()
    + """SELECT a.id, CASE WHEN a.status = 2 THEN s.quality_score ELSE 0 END AS quality_score,
               CASE WHEN a.status = 2 THEN s.risk_level ELSE 0 END AS risk_level, a.status
         FROM v_analyses a JOIN v_scored s ON a.id = s.id""",
)
def replace_rows(spark, d):
    from revlens.sources.tables import replace_rows as S5

    state = P.analyses(spark, d)
    changes = scored(spark, d).filter(F.col("status") == 2).select(*state.columns)
    return S5(state, changes, "id").select("id", "quality_score", "risk_level", "status")


@register(
    "delete_cascade",
    sql_with("v_analyses", "v_notifications")
    + """SELECT id, analysis_id, type FROM v_notifications
         WHERE analysis_id NOT IN (SELECT id FROM v_analyses WHERE repo_name = 'org/repo-3')""",
)
def delete_cascade(spark, d):
    from revlens.operators import state as ST

    a = P.analyses(spark, d)
    gone = a.filter(F.col("repo_name") == "org/repo-3").select("id")
    _, kept_n = ST.delete_cascade(a, P.notifications(spark, d), gone)
    return kept_n.select("id", "analysis_id", "type")


@register(
    "notifications_joined",
    sql_with("v_analyses", "v_notifications")
    + """SELECT a.id, a.pr_title, n.id AS notification_id, n.message AS notification_message, n.type AS notification_type,
               n.is_read AS notification_is_read, n.created_at AS notification_created_at
         FROM v_analyses a LEFT JOIN v_notifications n ON n.analysis_id = a.id""",
)
def notifications_joined(spark, d):
    """Every analysis with each of its notifications."""
    from revlens.operators import state as ST

    j = ST.with_notifications(P.analyses(spark, d), P.notifications(spark, d))
    return j.select("id", "pr_title", *[c for c in j.columns if c.startswith("notification_")])


@register(
    "notification_summary",
    sql_with("v_analyses", "v_notifications")
    + """SELECT a.id, CAST(coalesce(n.c, 0) AS INTEGER) AS notification_count,
               CAST(coalesce(n.u, 0) AS INTEGER) AS unread_count,
               n.latest_id AS latest_notification_id, n.latest_type AS latest_notification_type
         FROM v_analyses a LEFT JOIN (
            SELECT analysis_id, count(*) AS c, count(*) FILTER (WHERE NOT is_read) AS u,
                   arg_max(id, created_at) AS latest_id, arg_max(type, created_at) AS latest_type
            FROM v_notifications GROUP BY analysis_id) n ON a.id = n.analysis_id""",
)
def notification_summary(spark, d):
    from revlens.operators import state as ST

    j = ST.notification_summary(P.analyses(spark, d), P.notifications(spark, d))
    return j.select(
        "id", "notification_count", "unread_count", "latest_notification_id", "latest_notification_type"
    )


# ---------------------------------------------------------------------------
# Diffs -> files -> added lines
def files(spark: SparkSession, d: str) -> DataFrame:
    from revlens.operators import diffs as DF

    return DF.changed_files(P.diffs(spark, d))


def cs_lines(spark: SparkSession, d: str) -> DataFrame:
    from revlens.operators import diffs as DF

    return DF.file_lines(DF.csharp_files(files(spark, d)))


@register(
    "diff_files",
    sql_with("v_docs", "v_text_lines", "v_code_only", "v_lines")
    + """SELECT analysis_id, file_idx, file_path, true AS is_csharp, CAST(count(*) AS INTEGER) AS added_count
         FROM v_lines GROUP BY ALL
         UNION ALL
         SELECT CAST(doc_id AS VARCHAR), 1, 'docs/Doc' || CAST(doc_id AS VARCHAR) || '.md', false, 2
         FROM v_docs WHERE doc_id % 3 = 0""",
)
def diff_files(spark, d):
    from revlens.functions import diff as DD

    return files(spark, d).select(
        "analysis_id", "file_idx", "file_path", DD.is_extension("file_path").alias("is_csharp"), "added_count"
    )


@register(
    "diff_attach",
    sql_with("v_docs", "v_text_lines", "v_code_only", "v_lines")
    + """SELECT CAST(o.o_orderkey AS VARCHAR) AS analysis_id, d.doc_id IS NULL AS diff_missing,
               CAST(CASE WHEN d.doc_id IS NULL THEN 0
                    ELSE 1 + 5 + len(d.ls) + k.c + CASE WHEN d.doc_id % 3 = 0 THEN 4 ELSE 0 END END AS INTEGER)
                 AS diff_lines
         FROM orders o
         LEFT JOIN v_docs d ON d.doc_id = o.o_orderkey
         LEFT JOIN (SELECT doc_id, count(*) AS c FROM v_code_only GROUP BY doc_id) k ON k.doc_id = d.doc_id""",
)
def diff_attach(spark, d):
    """Every analysis gets its diff by (repo, pr); absent diffs become ''."""
    from revlens.operators import diffs as DF

    a = P.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("analysis_id"),
        F.lit("org/docs").alias("repo_name"),
        F.col("o_orderkey").cast("int").alias("pr_number"),
    )
    j = DF.attach_diffs(a, P.diffs(spark, d).drop("analysis_id"))
    n = F.when(F.col("diff") == "", F.lit(0)).otherwise(F.size(F.split("diff", "\n")))
    return j.select("analysis_id", "diff_missing", n.cast("int").alias("diff_lines"))


@register(
    "added_lines",
    sql_with("v_docs", "v_text_lines", "v_code_only", "v_lines")
    + "SELECT analysis_id, file_path, line_number, text FROM v_lines",
)
def added_lines(spark, d):
    return cs_lines(spark, d).select("analysis_id", "file_path", "line_number", "text")


SQL_DIAG = {
    "diag": """SELECT CAST(doc_id AS VARCHAR) AS analysis_id, 0 AS file_idx,
                      'CS' || CAST(doc_id % 50 + 1000 AS VARCHAR) AS rule_id, 'Syntax' AS title,
                      'diagnostic ' || CAST(doc_id AS VARCHAR) AS message,
                      ['Error', 'Warning', 'Info', 'Hidden'][doc_id % 4 + 1] AS severity,
                      CAST(doc_id % 7 AS INTEGER) AS line0, CAST(doc_id % 3 AS INTEGER) AS col0
               FROM v_docs""",
    "diag_out": """
        SELECT g.analysis_id, g.rule_id,
               CASE lower(g.severity) WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END AS severity,
               CAST(g.line0 + 1 AS INTEGER) AS line_number, CAST(g.col0 + 1 AS INTEGER) AS column_number,
               coalesce(regexp_replace(l.text, '^\\s+|\\s+$', '', 'g'), '') AS code_snippet
        FROM diag g LEFT JOIN v_lines l ON l.analysis_id = g.analysis_id AND l.line_number = g.line0 + 1""",
}


def diagnostics_findings(spark, d):
    from revlens.operators import diffs as DF
    from revlens.operators import rules as R

    f = DF.csharp_files(files(spark, d))
    return R.diagnostics(P.diagnostics_input(spark, d), f)


@register(
    "diagnostics",
    sql_with("v_docs", "v_text_lines", "v_code_only", "v_lines", extra=SQL_DIAG)
    + "SELECT analysis_id, rule_id, severity, line_number, column_number, code_snippet FROM diag_out",
)
def diagnostics(spark, d):
    return diagnostics_findings(spark, d).select(
        "analysis_id", "rule_id", "severity", "line_number", "column_number", "code_snippet"
    )


@register(
    "code_snippets",
    sql_with("v_docs", "v_text_lines", "v_code_only", "v_lines", extra=SQL_DIAG)
    + "SELECT analysis_id, line_number, code_snippet FROM diag_out",
)
def code_snippets(spark, d):
    return diagnostics_findings(spark, d).select("analysis_id", "line_number", "code_snippet")


# ---------------------------------------------------------------------------
# R1-R3, W1, U1, R5
def _sql_rule_views() -> dict[str, str]:
    """The hand-written findings of the injected code lines, placed behind each
    document's text lines."""
    rows = ", ".join(f"({k}, {line}, {col}, '{rule}', '{value}')" for k, line, col, rule, value in P.EXPECTED)
    return {
        "expected": f"""
            SELECT CAST(d.doc_id AS VARCHAR) AS analysis_id, 'src/Doc' || CAST(d.doc_id AS VARCHAR) || '.cs' AS file_path,
                   CAST(coalesce(t.cnt, 0) + e.line AS INTEGER) AS line_number, e.col AS column_number, e.rule,
                   replace(e.value, '{{id}}', CAST(d.doc_id AS VARCHAR)) AS value
            FROM v_docs d JOIN (VALUES {rows}) e(k, line, col, rule, value) ON d.doc_id % 6 = e.k
            LEFT JOIN (SELECT doc_id, count(*) AS cnt FROM v_text_lines GROUP BY doc_id) t ON t.doc_id = d.doc_id""",
        "magic": "SELECT * FROM expected WHERE rule = 'magic' AND value NOT IN ('0', '1', '-1', '2', '10', '100')",
        "asyncv": "SELECT * FROM expected WHERE rule = 'async'",
        "longm": """SELECT analysis_id, file_path, line_number, column_number,
                           'Metot çok uzun (' || value || ' satır). Daha küçük parçalara bölün.' AS message
                    FROM expected WHERE rule = 'long'""",
    }


def cs_files(spark: SparkSession, d: str) -> DataFrame:
    from revlens.operators import diffs as DF

    return DF.csharp_files(files(spark, d))


SQL_MAGIC = """SELECT analysis_id, file_path, line_number, column_number,
               'Use a named constant instead of magic number ''' || value || '''' AS message,
               'const int MEANINGFUL_NAME = ' || value || ';' AS suggested_fix
         FROM magic"""
MAGIC_COLS = ["analysis_id", "file_path", "line_number", "column_number", "message", "suggested_fix"]


@register(
    "magic_numbers", sql_with("v_docs", "v_text_lines", "v_code_only", "v_lines", extra=_sql_rule_views()) + SQL_MAGIC
)
def magic_numbers(spark, d):
    from revlens.operators import rules as R

    return R.magic_numbers(cs_files(spark, d)).select(*MAGIC_COLS)


@register(
    "first_magic_numbers",
    sql_with("v_docs", "v_text_lines", "v_code_only", "v_lines", extra=_sql_rule_views())
    + SQL_MAGIC
    + " QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY line_number, column_number) <= 3",
)
def first_magic_numbers(spark, d):
    """The first three literals of each file, a top-k report."""
    from revlens.operators import rules as R

    return R.magic_numbers(cs_files(spark, d), limit=3).select(*MAGIC_COLS)


@register(
    "async_void",
    sql_with("v_docs", "v_text_lines", "v_code_only", "v_lines", extra=_sql_rule_views())
    + """SELECT analysis_id, file_path, line_number, column_number,
               'async Task ' || value || '(...)' AS suggested_fix FROM asyncv""",
)
def async_void(spark, d):
    from revlens.operators import rules as R

    return R.async_void(cs_files(spark, d)).select(
        "analysis_id", "file_path", "line_number", "column_number", "suggested_fix"
    )


@register(
    "long_methods",
    sql_with("v_docs", "v_text_lines", "v_code_only", "v_lines", extra=_sql_rule_views())
    + "SELECT analysis_id, file_path, line_number, column_number, message FROM longm",
)
def long_methods(spark, d):
    """Methods with more than 50 top-level statements."""
    from revlens.operators import rules as R

    return R.long_methods(cs_files(spark, d)).select("analysis_id", "file_path", "line_number", "column_number", "message")


SQL_DIFF_FINDINGS = (
    sql_with("v_docs", "v_text_lines", "v_code_only", "v_lines", extra={**_sql_rule_views(), **SQL_DIAG})
    + """SELECT analysis_id, CAST(count(*) AS INTEGER) AS finding_count,
               CAST(count(*) FILTER (WHERE severity = 2) AS INTEGER) AS errors,
               CAST(count(*) FILTER (WHERE severity = 1) AS INTEGER) AS warnings,
               CAST(greatest(0, 100 - sum(CASE severity WHEN 2 THEN 10 WHEN 1 THEN 5 WHEN 0 THEN 1 ELSE 0 END))
                    AS INTEGER) AS finding_score,
               CASE WHEN count(*) FILTER (WHERE severity = 2) >= 5 THEN 2
                    WHEN count(*) FILTER (WHERE severity = 2) >= 1 AND count(*) FILTER (WHERE severity = 1) >= 10 THEN 2
                    WHEN count(*) FILTER (WHERE severity = 2) >= 1 THEN 1
                    WHEN count(*) FILTER (WHERE severity = 1) >= 15 THEN 1 ELSE 0 END AS risk_level
         FROM (SELECT analysis_id, 1 AS severity FROM asyncv
               UNION ALL SELECT analysis_id, 0 FROM magic
               UNION ALL SELECT analysis_id, 1 FROM longm
               UNION ALL SELECT analysis_id, severity FROM diag_out)
         GROUP BY analysis_id"""
)


@register(
    "hunk_lines",
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
       n AS (SELECT doc_id, len(ls) AS n, (len(ls) + 1) // 4 AS gone FROM l),
       x AS (SELECT doc_id, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS i FROM l),
       a AS (SELECT doc_id, 1 AS hunk, 20 + i - (i + 1) // 4 AS file_line, text FROM x WHERE i % 4 IN (0, 1)
             UNION ALL SELECT doc_id, 1, 20 + n - gone, '++i;' FROM n UNION ALL SELECT doc_id, 1, 21 + n - gone, '--j;' FROM n
             UNION ALL SELECT doc_id, 2, 600, '++k;' FROM n UNION ALL SELECT doc_id, 2, 601, 'last' FROM n)
       SELECT CAST(doc_id AS VARCHAR) AS analysis_id, 0 AS file_idx, 'src/H' || CAST(doc_id AS VARCHAR) || '.cs' AS file_path,
              CAST(row_number() OVER (PARTITION BY doc_id ORDER BY hunk, file_line) AS INTEGER) AS line_number, CAST(file_line AS INTEGER) AS file_line, text
       FROM a""",
)
def hunk_lines(spark, d):
    """F3, W5 with hunk tracking: '++' lines are kept, real line numbers follow
    from the hunk headers."""
    from revlens.operators import diffs as DF

    return DF.tracked_lines(P.hunk_diffs(spark, d))


@register("diff_findings", SQL_DIFF_FINDINGS)
def diff_findings(spark, d):
    """All rules + ingested diagnostics over every PR diff, scored per analysis."""
    from revlens.operators import rules as R
    from revlens.operators import scoring as SCR

    found = R.analyze_diffs(P.diffs(spark, d), P.diagnostics_input(spark, d))
    st = SCR.finding_stats(found)
    return st.select(
        "analysis_id",
        "finding_count",
        "errors",
        "warnings",
        SCR.score_from_penalty(F.col("finding_penalty")).alias("finding_score"),
        SCR.risk_level(F.col("errors"), F.col("warnings")).alias("risk_level"),
    )


# ---------------------------------------------------------------------------
# Prompts, replies, suggestions
TYPE_CHOICES = ["refactor", "Performance", "SECURITY", "best_practice", "other", ""]
PRIORITY_CHOICES = ["Low", "MEDIUM", "high", "Critical", "urgent", None]


def reply_rows(spark: SparkSession, d: str) -> DataFrame:
    """part -> review replies of six shapes by p_partkey % 6: JSON (upper-case
    top key), JSON inside prose, null list, plain text, broken JSON, empty."""
    part = P.table(spark, d, "part")
    tname = F.element_at(F.array(*[F.lit(t) for t in TYPE_CHOICES]), (F.col("p_size") % 6 + 1).cast("int"))
    prio = F.element_at(
        F.array(*[F.lit(p) if p is not None else F.lit(None).cast("string") for p in PRIORITY_CHOICES]),
        ((F.col("p_size") + 1) % 6 + 1).cast("int"),
    )
    item = F.struct(
        tname.alias("type"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("description"),
        prio.alias("priority"),
        F.lower("p_type").alias("category"),
        (F.col("p_size") % 13 - 1).cast("string").alias("impactScore"),
        F.array("p_brand", "p_type").alias("tags"),
    )
    js_upper = F.to_json(F.struct(F.array(item).alias("Suggestions")))
    js = F.to_json(F.struct(F.array(item).alias("suggestions")))
    k = F.col("p_partkey") % 6
    reply = (
        F.when(k == 0, js_upper)
        .when(k == 1, F.concat(F.lit("Here is my review: "), js, F.lit(" Thanks!")))
        .when(k == 2, F.lit('{"suggestions":null}'))
        .when(k == 3, F.concat(F.lit("Looks fine overall for "), F.col("p_name")))
        .when(k == 4, F.concat(F.lit('{"suggestions":[{"title":"'), F.col("p_name"), F.lit('"}')))
        .otherwise(F.lit(""))
    )
    return part.select(F.col("p_partkey").alias("reply_id"), reply.alias("reply"))


def _sql_list(items) -> str:
    return "[" + ", ".join("NULL" if x is None else P._sql_str(x) for x in items) + "]"


SQL_PARSED = f"""
    SELECT p_partkey AS reply_id, 0 AS idx,
           CASE lower({_sql_list(TYPE_CHOICES)}[p_size % 6 + 1])
                WHEN 'potential_issue' THEN 0 WHEN 'refactor' THEN 1 WHEN 'performance' THEN 2
                WHEN 'security' THEN 3 WHEN 'code_quality' THEN 4 WHEN 'best_practice' THEN 5 ELSE 0 END AS type,
           p_name AS title, p_brand AS description,
           CASE lower({_sql_list(PRIORITY_CHOICES)}[(p_size + 1) % 6 + 1])
                WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE 1 END
             AS priority,
           lower(p_type) AS category,
           CAST(greatest(1, least(10, p_size % 13 - 1)) AS INTEGER) AS impact_score,
           p_brand || ',' || p_type AS tags
    FROM part WHERE p_partkey % 6 IN (0, 1)
    UNION ALL
    SELECT p_partkey, 0, 0, 'GPT Analysis', 'Looks fine overall for ' || p_name, 1, 'code_quality', 5,
           'gpt-analysis'
    FROM part WHERE p_partkey % 6 = 3
    UNION ALL
    SELECT p_partkey, 0, 0, 'GPT Analysis (Parse Error)', '{{"suggestions":[{{"title":"' || p_name || '"}}',
           0, 'code_quality', 3, 'gpt-analysis,parse-error'
    FROM part WHERE p_partkey % 6 = 4"""


@register("parse_replies", "WITH x AS (SELECT 1) " + SQL_PARSED)
def parse_replies(spark, d):
    from revlens.operators import replies as RP

    s = RP.parse_replies(reply_rows(spark, d), "reply_id", "reply", default_type=0, file_label="mixed")
    return s.select(
        "reply_id",
        "idx",
        "type",
        "title",
        "description",
        "priority",
        "category",
        "impact_score",
        F.array_join("tags", ",").alias("tags"),
    )


def _sql_parts(text: str, limit: int) -> str:
    return f"""unnest(list_transform(range(0, greatest(1, CAST(ceil(length({text}) / {limit}.0) AS BIGINT))),
                   lambda i: {{'part': i + 1, 'p': substr({text}, i * {limit} + 1, {limit})}}))"""


def _sql_prompts() -> str:
    from revlens.functions import replies as RF

    q = P._sql_str
    doc = "CAST(doc_id AS VARCHAR)"
    heads = {
        "summary": (12000, f"{q(RF.SUMMARY_HEAD)} || 'Doc ' || {doc} || {q(RF.SUMMARY_MID)}"),
        "issues": (10000, q(RF.ISSUES_HEAD)),
        "refactor": (8000, f"{q(RF.REFACTOR_HEAD)} || 'src/Doc' || {doc} || '.cs' || {q(RF.REFACTOR_MID)}"),
        "security": (8000, q(RF.SECURITY_HEAD)),
    }
    return " UNION ALL ".join(
        f"SELECT doc_id, '{task}' AS task, CAST(x.part AS INTEGER) AS part, {head} || x.p AS prompt"
        f" FROM (SELECT doc_id, {_sql_parts('text', limit)} AS x FROM documents)"
        for task, (limit, head) in heads.items()
    )


def prompt_rows(spark: SparkSession, d: str) -> DataFrame:
    from revlens.operators import replies as RP

    sid = F.col("doc_id").cast("string")
    doc = P.table(spark, d, "documents").select(
        "doc_id", "text", F.concat(F.lit("Doc "), sid).alias("name"), F.concat(F.lit("src/Doc"), sid, F.lit(".cs")).alias("file")
    )
    return RP.review_prompts(doc, "doc_id", "text", "name", "file")


@register(
    "prompts",
    "WITH pr AS (" + _sql_prompts() + ") SELECT doc_id, task, part, CAST(length(prompt) AS INTEGER) AS prompt_chars, "
    "sha256(prompt) AS prompt_sha FROM pr",
)
def prompts(spark, d):
    """the prompts of all four tasks, in parts that cover the whole text."""
    return prompt_rows(spark, d).select(
        "doc_id", "task", "part", F.length("prompt").alias("prompt_chars"), F.sha2("prompt", 256).alias("prompt_sha")
    )


@register(
    "responder",
    "WITH pr AS (" + _sql_prompts() + "), k AS (SELECT doc_id, task, part, length(prompt) AS n FROM pr) "
    "SELECT doc_id || '/' || task || '/' || part AS asked, CAST(n % 4 AS INTEGER) AS priority, "
    "CAST(greatest(1, least(10, n % 12)) AS INTEGER) AS impact_score, 'len ' || CAST(n AS VARCHAR) AS title "
    "FROM k WHERE n % 10 <> 3",
)
def responder(spark, d):
    """Every prompt of every task is answered on its own; prompts that the
    reviewer fails on (here by their length) leave the others alone."""
    from revlens.operators import replies as RP

    asked = prompt_rows(spark, d).withColumn("asked", F.concat_ws("/", "doc_id", "task", "part"))
    rep = RP.respond(asked, fragile_responder).where(~F.col("failed"))
    s = RP.parse_replies(rep, "asked", "reply")
    return s.select("asked", "priority", "impact_score", "title")


@register(
    "review_replies",
    sql_with(
        "v_analyses",
        extra={
            "rep": """SELECT conv_id AS id, turn, CASE WHEN turn % 7 <> 5 THEN text END AS reply,
                             turn % 5 = 3 AS failed
                      FROM conversations WHERE role = 'assistant'""",
            "s": """SELECT a.id, r.turn, CASE
                        WHEN r.id IS NULL
                          THEN 'PR Title: ' || a.pr_title || chr(10) || 'Summary: OpenAI integration is not configured.'
                        WHEN r.failed
                          THEN 'PR Title: ' || a.pr_title || chr(10) || 'Summary: An error occurred during automated analysis.'
                        ELSE coalesce(r.reply, 'Summary could not be generated.') END AS summary
                    FROM v_analyses a LEFT JOIN rep r ON a.id = r.id""",
        },
    )
    + "SELECT id, turn, CAST(length(summary) AS INTEGER) AS summary_chars, sha256(summary) AS summary_sha FROM s",
)
def review_replies(spark, d):
    """J6 + F7: every assistant turn is a review; some failed, some without text."""
    from revlens.operators import replies as RP

    rep = P.table(spark, d, "conversations").filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("id"),
        "turn",
        F.when(F.col("turn") % 7 != 5, F.col("text")).alias("reply"),
        (F.col("turn") % 5 == 3).alias("failed"),
    )
    a = RP.with_review(P.analyses(spark, d).select("id", "pr_title"), rep)
    return a.select("id", "turn", F.length("summary").alias("summary_chars"), F.sha2("summary", 256).alias("summary_sha"))


# ---------------------------------------------------------------------------
# Detail view and summary HTML
def detail_rows(spark: SparkSession, d: str, with_scores: bool = True) -> DataFrame:
    from revlens.functions import jsonio as J

    a = scored(spark, d) if with_scores else P.analyses(spark, d)
    pf = J.pack_findings(P.findings(spark, d)).withColumnRenamed("analysis_id", "id")
    sug = P.suggestions(spark, d).withColumn("tags", F.array(F.lit("t"), F.lit(" "), F.col("category")))
    ps = J.pack_suggestions(sug).withColumnRenamed("analysis_id", "id")
    j = a.drop("findings_json", "suggestions_json").join(pf, "id", "left").join(ps, "id", "left")
    j = j.withColumn("findings_json", F.coalesce("findings_json", F.lit("[]"))).withColumn(
        "suggestions_json", F.coalesce("suggestions_json", F.lit("[]"))
    )
    return SV.analysis_detail(j)


@register(
    "analysis_detail",
    with_scored(
        extra={
            "ff": """SELECT analysis_id, rule_id, row_number() OVER (PARTITION BY analysis_id
                        ORDER BY file_idx, file_path, line_number, rule_id, id) AS r FROM v_findings""",
            "fc": """SELECT analysis_id, count(*) AS n, count(*) FILTER (WHERE severity = 2) AS e FROM v_findings
                     GROUP BY analysis_id""",
            "sc": """SELECT analysis_id, count(*) AS n, count(*) FILTER (WHERE priority = 3) AS c FROM v_suggestions
                     GROUP BY analysis_id""",
        }
    )
    + """SELECT s.id,
               CASE s.status WHEN 0 THEN 'Pending' WHEN 1 THEN 'InProgress' WHEN 2 THEN 'Completed'
                             WHEN 3 THEN 'Failed' END AS status,
               s.quality_score,
               CASE s.risk_level WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' END AS risk_level,
               '<ol><li><strong>Status</strong><br/>' || o.o_orderstatus || '</li><li><strong>Priority</strong><br/>'
                 || o.o_orderpriority || '</li></ol>' AS summary,
               CAST(coalesce(fc.n, 0) AS INTEGER) AS finding_count,
               CAST(coalesce(fc.e, 0) AS INTEGER) AS error_findings,
               ff.rule_id AS first_rule,
               CAST(coalesce(sc.n, 0) AS INTEGER) AS suggestion_count,
               CAST(coalesce(sc.c, 0) AS INTEGER) AS critical_suggestions,
               CAST(2 * coalesce(sc.n, 0) AS INTEGER) AS tag_count
         FROM v_scored s JOIN orders o ON o.o_orderkey = s.id
         LEFT JOIN fc ON fc.analysis_id = s.id
         LEFT JOIN sc ON sc.analysis_id = s.id
         LEFT JOIN ff ON ff.analysis_id = s.id AND ff.r = 1""",
)
def analysis_detail(spark, d):
    det = detail_rows(spark, d)
    return det.select(
        "id",
        "status",
        "quality_score",
        "risk_level",
        "summary",
        F.size("findings").alias("finding_count"),
        F.size(F.filter("findings", lambda f: f["severity"] == "Error")).alias("error_findings"),
        F.get("findings", 0)["rule_id"].alias("first_rule"),
        F.size("suggestions").alias("suggestion_count"),
        F.size(F.filter("suggestions", lambda s: s["priority"] == "Critical")).alias("critical_suggestions"),
        F.aggregate("suggestions", F.lit(0), lambda acc, s: acc + F.size(s["tags"])).alias("tag_count"),
    )


@register(
    "finding_counts",
    with_scored()
    + """SELECT id, finding_count, suggestion_count,
               CAST(finding_count + suggestion_count AS INTEGER) AS result_count FROM v_scored""",
)
def finding_counts(spark, d):
    """List sizes shown next to the detail lists, from the per-analysis
    aggregates (A1, A2); no list is built for them."""
    return scored(spark, d).select(
        "id", "finding_count", "suggestion_count", (F.col("finding_count") + F.col("suggestion_count")).alias("result_count")
    )


@register(
    "detail_findings",
    sql_with("v_findings")
    + """SELECT analysis_id, row_number() OVER (PARTITION BY analysis_id ORDER BY file_idx, file_path, line_number, rule_id, id)
                  - 1 AS position, id, rule_id,
               CASE severity WHEN 0 THEN 'Info' WHEN 1 THEN 'Warning' WHEN 2 THEN 'Error' END AS severity, message,
               file_path, line_number, category, CAST(NULL AS VARCHAR) AS description
         FROM v_findings""",
)
def detail_findings(spark, d):
    """The eight fields of every finding of the detail view, in file order."""
    det = detail_rows(spark, d, with_scores=False)
    rows = det.select(F.col("id").alias("analysis_id"), F.posexplode_outer("findings").alias("position", "f"))
    return rows.where("position is not null").select("analysis_id", F.col("position").cast("long").alias("position"), "f.*")


@register(
    "detail_suggestions",
    sql_with("v_suggestions")
    + """SELECT analysis_id, id, 'PotentialIssue' AS type, title, 'No description' AS description,
               CASE priority WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' WHEN 3 THEN 'Critical' END AS priority,
               'mixed' AS file_path, CAST(NULL AS INTEGER) AS start_line, CAST(NULL AS INTEGER) AS end_line,
               CAST(NULL AS VARCHAR) AS original_code, CAST(NULL AS VARCHAR) AS suggested_code,
               'code_quality' AS category, impact_score, 't,code_quality' AS tags
         FROM v_suggestions""",
)
def detail_suggestions(spark, d):
    """The fields of every suggestion of the detail view, with clean tags."""
    det = detail_rows(spark, d, with_scores=False)
    rows = det.select(F.col("id").alias("analysis_id"), F.explode_outer("suggestions").alias("s")).where("s is not null").select("analysis_id", "s.*")
    return rows.withColumn("tags", F.array_join("tags", ","))


def _sql_encode(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: "
        "CASE WHEN c = '&' THEN '&amp;' WHEN c = '<' THEN '&lt;' WHEN c = '>' THEN '&gt;' "
        "WHEN c = '\"' THEN '&quot;' WHEN c = '''' THEN '&#39;' "
        "WHEN unicode(c) BETWEEN 160 AND 255 OR unicode(c) >= 65536 THEN '&#' || CAST(unicode(c) AS VARCHAR) || ';' "
        "ELSE c END), '')"
    )


def _sql_f18(src: str) -> dict[str, str]:
    num = r"^\s*\d+[.)]\s+(.*)$"
    return {
        "f18_in": f"SELECT key, coalesce(t, '') AS t FROM ({src})",
        "f18_lines": """SELECT key, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i
                        FROM (SELECT key, string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10)) AS ls
                              FROM f18_in)""",
        "f18_l2": f"""SELECT key, i, line, regexp_matches(line, '{num}') AS li,
                             regexp_replace(regexp_extract(line, '{num}', 1), '^\\s+|\\s+$', '', 'g') AS content
                      FROM (SELECT key, i, regexp_replace(raw, '\\s+$', '') AS line FROM f18_lines)""",
        "f18_l3": """SELECT *, coalesce(lag(li) OVER (PARTITION BY key ORDER BY i), false) AS prev_li,
                            instr(content, ':') - 1 AS idx FROM f18_l2""",
        "f18_l4": f"""SELECT key, i, li,
               CASE WHEN li THEN (CASE WHEN NOT prev_li THEN '<ol>' ELSE '' END) ||
                    CASE WHEN idx > 0 AND idx < 120 THEN
                         '<li><strong>' || {_sql_encode("regexp_replace(substr(content, 1, idx), '^\\s+|\\s+$', '', 'g')")}
                         || '</strong>' ||
                         CASE WHEN regexp_replace(substr(content, idx + 2), '^\\s+|\\s+$', '', 'g') <> ''
                              THEN '<br/>' || {_sql_encode("regexp_replace(substr(content, idx + 2), '^\\s+|\\s+$', '', 'g')")}
                              ELSE '' END || '</li>'
                    ELSE '<li>' || {_sql_encode("content")} || '</li>' END
               ELSE (CASE WHEN prev_li THEN '</ol>' ELSE '' END) ||
                    CASE WHEN regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> '' THEN '<p>' || line || '</p>' ELSE '' END
               END AS piece
            FROM f18_l3""",
        "f18_out": """SELECT i.key,
               CASE WHEN regexp_replace(i.t, '^\\s+|\\s+$', '', 'g') = '' THEN ''
                    WHEN contains(i.t, '<ol') OR contains(i.t, '<ul') THEN i.t
                    ELSE h.body || CASE WHEN h.last_li THEN '</ol>' ELSE '' END END AS html
            FROM f18_in i JOIN (SELECT key, string_agg(piece, '' ORDER BY i) AS body, arg_max(li, i) AS last_li
                                FROM f18_l4 GROUP BY key) h ON h.key = i.key""",
    }


def _sql_sanitize(x: str) -> str:
    """The sanitiser by marking: allowed tags become chr(1)name chr(2), all other
    markup goes, and the marks become tags again."""
    names = "p|br|strong|b|em|i|u|ul|ol|li|code|pre|h1|h2|h3|h4"
    rest = """(?:[^<>"'']|"[^"]*"|''[^'']*'')*"""
    s = x
    for gone in ("<script(?:\\s[^>]*)?>.*?</script\\s*>", "<style(?:\\s[^>]*)?>.*?</style\\s*>", "<!--.*?-->"):
        s = f"regexp_replace({s}, '(?is){gone}', '', 'g')"
    s = f"regexp_replace({s}, '(?i)<(/?(?:{names}))(?:[\\s/]{rest}?)?(/?)>', chr(1) || '\\1\\2' || chr(2), 'g')"
    s = f"replace(regexp_replace({s}, '<[a-zA-Z/!?]{rest}>', '', 'g'), '<', '&lt;')"
    return f"replace(replace({s}, chr(1), '<'), chr(2), '>')"


@register(
    "summary_html",
    "WITH "
    + ",\n".join(f"{k} AS ({v})" for k, v in _sql_f18("SELECT doc_id AS key, text AS t FROM documents").items())
    + f", s AS (SELECT key AS doc_id, CASE WHEN regexp_replace(html, '^\\s+|\\s+$', '', 'g') = '' THEN ''"
    f" ELSE {_sql_sanitize('html')} END AS h FROM f18_out)"
    + " SELECT doc_id, CAST(length(h) AS INTEGER) AS html_chars, sha256(h) AS html_sha FROM s",
)
def summary_html(spark, d):
    from revlens.functions import html as H

    doc = P.table(spark, d, "documents").select("doc_id", "text")
    return H.with_clean_summary(doc, "text", "h").select(
        "doc_id", F.length("h").alias("html_chars"), F.sha2("h", 256).alias("html_sha")
    )


@register(
    "sanitize_html",
    f"SELECT page_id, CAST(length(h) AS INTEGER) AS html_chars, sha256(h) AS html_sha FROM "
    f"(SELECT page_id, CASE WHEN regexp_replace(html, '^\\s+|\\s+$', '', 'g') = '' THEN '' "
    f"ELSE {_sql_sanitize('html')} END AS h FROM pages)",
)
def sanitize_html(spark, d):
    from revlens.functions import html as H

    pg = P.table(spark, d, "pages").select("page_id", "html")
    return pg.select("page_id", H.sanitize_html(F.col("html")).alias("h")).select(
        "page_id", F.length("h").alias("html_chars"), F.sha2("h", 256).alias("html_sha")
    )


# ---------------------------------------------------------------------------
# Status transitions and the notification log
# Only a job's first enqueue concerns the analysis: a retry's leaves it Failed.
SQL_EFFECTIVE = """
    SELECT job_id, seq, kind,
           CASE kind WHEN 'enqueue' THEN CASE WHEN was IS NULL THEN 0 END WHEN 'dequeue' THEN 1 WHEN 'complete' THEN 2
                     ELSE 3 END AS analysis_status,
           CASE kind WHEN 'dequeue' THEN 'AnalysisUpdated' WHEN 'complete' THEN 'AnalysisCompleted' END AS hub_event,
           CAST(split_part(job_id, '-', 1) AS BIGINT) * 100 + CAST(split_part(job_id, '-', 2) AS BIGINT) AS analysis_id
    FROM jfold WHERE effective"""


@register("status_events", with_jobs(extra={"eff": SQL_EFFECTIVE}) + "SELECT job_id, seq, kind, analysis_status, hub_event FROM eff")
def status_events(spark, d):
    return Q.effective_events(P.job_events(spark, d)).select(
        "job_id", "seq", "kind", "analysis_status", "hub_event"
    )


@register(
    "notification_log",
    with_jobs("v_webhooks", "v_analyses", extra={"eff": SQL_EFFECTIVE, **{k: v for k, v in SQL_SEGMENTS.items()}})
    + """SELECT 'NewPullRequest' AS event, seq, repo_name, pr_number, pr_title AS title, pr_author AS author,
               CAST(NULL AS VARCHAR) AS analysis_id
         FROM ev WHERE route = 'upsert'
         UNION ALL
         SELECT 'PullRequestClosed', c.seq, c.repo_name, c.pr_number, c.pr_title, NULL,
                sha256(c.repo_name || '#' || CAST(c.pr_number AS VARCHAR) || '#' || CAST(k.creator_seq AS VARCHAR))
         FROM ev2 c JOIN creators k
           ON k.repo_name = c.repo_name AND k.pr_number = c.pr_number AND k.seg = coalesce(c.prev_close, -1)
         WHERE c.route = 'delete' AND coalesce(c.prev_upsert > coalesce(c.prev_close, -1), false)
         UNION ALL
         SELECT hub_event, seq, NULL, NULL, NULL, NULL, CAST(analysis_id AS VARCHAR)
         FROM eff WHERE hub_event IS NOT NULL AND analysis_id IN (SELECT id FROM v_analyses)""",
)
def notification_log(spark, d):
    """All notification events as one typed table."""
    from revlens.operators.notifications import notification_log as S7

    jobs_of = with_analysis_id(Q.effective_events(P.job_events(spark, d)))
    return S7(P.webhook_rows(spark, d), jobs_of, P.analyses(spark, d))


# ---------------------------------------------------------------------------
# K1, K2, K6: streaming twins (file source, availableNow, run to completion)
@register(
    "stream_state",
    sql_with(
        "v_webhooks",
        extra={
            **SQL_REPLAY,
            "ev": """SELECT *, CASE WHEN action IN ('opened', 'synchronize', 'reopened') THEN 'upsert'
                                    WHEN action = 'closed' THEN 'delete' END AS route
                     FROM v_webhooks WHERE seq % 50 NOT IN (7, 8, 9)""",
        },
    )
    + f"SELECT {STATE_COLS} FROM v_state",
)
def stream_state(spark, d):
    from revlens.streaming import jobs as SJ

    root = SJ.scratch(spark, "stream-state")
    src = f"{root}/source"
    out = SJ.feed(webhook_payloads(spark, d), src, "seq", 4, lambda: SJ.run_state_stream(spark, src, root))
    return out.select(*[c.strip() for c in STATE_COLS.split(",")])


@register("stream_notifications", ORACLE["notification_log"].replace("FROM v_webhooks", "FROM v_webhooks WHERE seq % 50 NOT IN (7, 8, 9)"))
def stream_notifications(spark, d):
    """S7 as streams: the webhook stream's notifications and the hub events of
    the job stream, each from the batches that caused them."""
    from revlens.sources import tables as TB
    from revlens.streaming import jobs as SJ
    from revlens.streaming import lifecycle as LC

    hooks, work = SJ.scratch(spark, "notify-hooks"), SJ.scratch(spark, "notify-jobs")
    SJ.feed(webhook_payloads(spark, d), f"{hooks}/source", "seq", 3, lambda: SJ.run_state_stream(spark, f"{hooks}/source", hooks))
    analyses = P.analyses(spark, d)
    TB.store_keyed(analyses, f"{work}/analyses")
    sink = LC.StatusSinks(spark, work, f"{work}/analyses", analyses.schema, job_analysis_id())
    SJ.feed(P.job_events(spark, d), f"{work}/source", "seq", 3, lambda: LC.run_job_stream(spark, f"{work}/source", work, sink=sink))
    return LC.hub_log(spark, hooks).unionByName(LC.hub_log(spark, work)).select("event", "seq", "repo_name", "pr_number", "title", "author", "analysis_id")


@register("stream_jobs", with_jobs() + "SELECT * FROM v_jobs")
def stream_jobs(spark, d):
    from revlens.streaming import jobs as SJ

    root = SJ.scratch(spark, "stream-jobs")
    src = f"{root}/source"
    return SJ.feed(P.job_events(spark, d), src, "seq", 4, lambda: SJ.run_job_stream(spark, src, root))


def _sql_outcomes() -> str:
    from revlens.functions import replies as RF

    q = P._sql_str
    return f"""
        SELECT doc_id, sum(CASE k % 4 WHEN 3 THEN 15 WHEN 2 THEN 10 WHEN 1 THEN 5 ELSE 2 END) AS pen, count(*) AS n
        FROM (SELECT doc_id, length({q(RF.ISSUES_HEAD)} || x.p) AS k
              FROM (SELECT doc_id, {_sql_parts('diff', 10000)} AS x FROM v_diffs)) GROUP BY doc_id"""


def _sql_summaries() -> str:
    from revlens.functions import replies as RF

    q = P._sql_str
    head = f"{q(RF.SUMMARY_HEAD)} || 'Doc ' || CAST(doc_id AS VARCHAR) || {q(RF.SUMMARY_MID)}"
    reply = """'{"suggestions": [{"priority": "' || ['Low', 'Medium', 'High', 'Critical'][k % 4 + 1]
               || '", "impactScore": "' || CAST(k % 12 AS VARCHAR) || '", "title": "len ' || CAST(k AS VARCHAR) || '"}]}'"""
    return f"""
        SELECT doc_id, string_agg({reply}, chr(10) ORDER BY part) AS summary
        FROM (SELECT doc_id, x.part AS part, length({head} || x.p) AS k
              FROM (SELECT doc_id, {_sql_parts('diff', 12000)} AS x FROM v_diffs)) GROUP BY doc_id"""


# Every tenth document has no analysis (an orphan job), every thirteenth a diff that cannot be read.
@register(
    "stream_enrich",
    "WITH df AS (" + SQL_DIFF_FINDINGS + "), v_diffs AS (" + P.SQL_DIFF_TEXT + "), sg AS (" + _sql_outcomes()
    + "), sm AS (" + _sql_summaries() + """), o AS (
    SELECT d.doc_id, d.doc_id % 10 <> 9 AS known, CASE WHEN d.doc_id % 10 = 9 THEN 'Analysis record not found'
                WHEN d.doc_id % 13 = 5 THEN 'diff ' || CAST(d.doc_id AS VARCHAR) || ' not readable' END AS error_message,
           CAST(coalesce(f.finding_count, 0) AS INTEGER) AS finding_count,
           CAST(coalesce(f.errors, 0) AS INTEGER) AS errors, CAST(coalesce(f.warnings, 0) AS INTEGER) AS warnings,
           CAST(coalesce(f.finding_score, 100) AS INTEGER) AS finding_score, coalesce(f.risk_level, 0) AS risk_level,
           CAST(sg.n AS INTEGER) AS suggestion_count, CAST(greatest(0, 100 - sg.pen) AS INTEGER) AS suggestion_score,
           sha256(sm.summary) AS summary_sha,
           CAST(trunc(coalesce(f.finding_score, 100) * 0.6::DOUBLE + greatest(0, 100 - sg.pen) * 0.4::DOUBLE) AS INTEGER) AS quality_score,
           TIMESTAMP '2024-01-01' + to_seconds(d.doc_id) AS processed_at
    FROM documents d LEFT JOIN df f ON f.analysis_id = CAST(d.doc_id AS VARCHAR)
    JOIN sg USING (doc_id) JOIN sm USING (doc_id)), g AS (SELECT *, error_message IS NULL AS good FROM o)
    SELECT CAST(doc_id AS VARCHAR) AS analysis_id, CASE WHEN good THEN 2 ELSE 3 END AS status, error_message,
           CASE WHEN good THEN finding_count END AS finding_count, CASE WHEN good THEN errors END AS errors,
           CASE WHEN good THEN warnings END AS warnings, CASE WHEN good THEN finding_score END AS finding_score,
           CASE WHEN good THEN suggestion_count END AS suggestion_count, CASE WHEN good THEN suggestion_score END AS suggestion_score,
           CASE WHEN good THEN risk_level END AS risk_level, CASE WHEN good THEN quality_score END AS quality_score,
           CASE WHEN good THEN processed_at END AS processed_at,
           CASE WHEN known THEN CASE WHEN good THEN 2 ELSE 3 END END AS stored_status,
           CASE WHEN known THEN CASE WHEN good THEN quality_score ELSE 0 END END AS stored_quality,
           CASE WHEN known THEN CASE WHEN good THEN risk_level ELSE 0 END END AS stored_risk,
           CASE WHEN known THEN CASE WHEN good THEN finding_count ELSE 0 END END AS stored_findings,
           CASE WHEN known THEN CASE WHEN good THEN suggestion_count ELSE 0 END END AS stored_suggestions,
           CASE WHEN known THEN CASE WHEN good THEN summary_sha ELSE sha256('') END END AS stored_summary
    FROM g""",
)
def stream_enrich(spark, d):
    """K6: the streaming twin of `diff_findings` with reviews: the outcome of
    every new job, and what the analyses hold afterwards."""
    from revlens.sources import tables as TB
    from revlens.streaming import jobs as SJ

    root = SJ.scratch(spark, "stream-enrich")
    out, table = enriched(spark, d, root)
    after = TB.read_keyed(spark, table, S.ANALYSES).select(
        F.col("id").alias("analysis_id"),
        F.col("status").alias("stored_status"),
        F.col("quality_score").alias("stored_quality"),
        F.col("risk_level").alias("stored_risk"),
        F.json_array_length("findings_json").alias("stored_findings"),
        F.json_array_length("suggestions_json").alias("stored_suggestions"),
        F.sha2("summary", 256).alias("stored_summary"),
    )
    return out.drop("summary", "updated_at", "findings_json", "suggestions_json").join(after, "analysis_id", "left")


def enriched(spark: SparkSession, d: str, root: str, metrics=None) -> tuple[DataFrame, str]:
    """K6 over the documents' diffs in three deliveries: the outcomes, and the
    path of the analyses."""
    from revlens.operators import state as ST
    from revlens.sources import tables as TB
    from revlens.streaming import jobs as SJ

    src, table, doc = f"{root}/source", f"{root}/analyses", F.col("doc_id")
    newjobs = P.table(spark, d, "documents").select(
        doc.cast("string").alias("analysis_id"),
        F.lit("org/docs").alias("repo_name"),
        doc.cast("int").alias("pr_number"),
        F.concat(F.lit("Doc "), doc.cast("string")).alias("pr_title"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + doc).alias("ts"),
        doc.alias("seq"),
    )
    made = newjobs.where(doc_known(F.col("seq"))).select(F.col("analysis_id").alias("id"), "repo_name", "pr_number", "pr_title", F.lit("").alias("pr_author"))
    TB.store_keyed(ST.new_analysis_defaults(made, F.lit("2023-12-31 00:00:00").cast("timestamp")), table)
    error = F.when(F.col("pr_number") % 13 == 5, F.concat(F.lit("diff "), F.col("pr_number").cast("string"), F.lit(" not readable")))
    static = SJ.store_diffs(P.diffs(spark, d).withColumn("error", error), f"{root}/diffs")
    diags = P.diagnostics_input(spark, d)
    run = lambda: SJ.run_enrich_stream(spark, src, root, static, stub_responder, diags, table, metrics=metrics)
    if metrics is not None:
        metrics.start(TB.read_keyed(spark, table, S.ANALYSES))
    return SJ.feed(newjobs, src, "seq", 3, run), table


@register(
    "stream_metrics",
    ", res AS (SELECT".join(ORACLE["stream_enrich"].rsplit("SELECT CAST(doc_id AS VARCHAR) AS analysis_id,", 1))
    + """) SELECT CAST(count(*) AS INTEGER) AS total, CAST(count(*) FILTER (WHERE stored_quality >= 90) AS INTEGER) AS high_quality,
               CAST(count(*) FILTER (WHERE stored_quality BETWEEN 70 AND 89) AS INTEGER) AS medium_quality,
               CAST(count(*) FILTER (WHERE stored_quality < 70) AS INTEGER) AS low_quality,
               CAST(coalesce(round_even(avg(stored_quality), 0), 0) AS INTEGER) AS average_score,
               CAST(count(*) FILTER (WHERE stored_risk = 2) AS INTEGER) AS high_risk,
               CAST(count(*) FILTER (WHERE stored_risk = 1) AS INTEGER) AS medium_risk,
               CAST(count(*) FILTER (WHERE stored_risk = 0) AS INTEGER) AS low_risk
         FROM res WHERE stored_status IS NOT NULL""",
)
def stream_metrics(spark, d):
    """A7-A10 as a running total over K6's batches: equal to the full aggregate
    over the analyses, without reading them."""
    from revlens.streaming import jobs as SJ
    from revlens.streaming.metrics import RunningMetrics

    root = SJ.scratch(spark, "stream-metrics")
    metrics = RunningMetrics(spark, root)
    enriched(spark, d, root, metrics)
    return metrics.current()


def doc_known(doc_id: Column) -> Column:
    return doc_id % 10 != 9


@register(
    "webhook_stream",
    sql_with("v_webhooks", extra={"f": SQL_WEBHOOK_FLAT}) + "SELECT parse_status, action, repo_name, pr_number, pr_title, pr_author FROM f",
)
def webhook_stream(spark, d):
    """S1 as a stream of JSON-lines files in two deliveries: equal to `webhook_flat`."""
    from revlens.sources.webhooks import run_webhook_stream
    from revlens.streaming.jobs import scratch

    root = scratch(spark, "webhook-stream")
    out = None
    for half in (0, 1):
        lines = webhook_payloads(spark, d).where(F.col("seq") % 2 == half).select(F.col("raw").alias("value"))
        lines.write.mode("append").text(f"{root}/source")
        out = run_webhook_stream(spark, f"{root}/source", root)
    return out.select("parse_status", "action", "repo_name", "pr_number", "pr_title", "pr_author")


@register(
    "stream_status",
    with_jobs("v_analyses", extra={"eff": SQL_EFFECTIVE})
    + """SELECT e.job_id, e.seq, e.kind, e.analysis_status, e.hub_event, e.hub_event IS NOT NULL AND a.id IS NOT NULL AS sent,
               CASE WHEN a.id IS NOT NULL THEN coalesce(l.st, a.status) END AS stored_status
         FROM eff e LEFT JOIN v_analyses a ON a.id = e.analysis_id
         LEFT JOIN (SELECT analysis_id, arg_max(analysis_status, seq) AS st
                    FROM eff WHERE analysis_status IS NOT NULL GROUP BY analysis_id) l ON l.analysis_id = e.analysis_id""",
)
def stream_status(spark, d):
    """K5 and S7 as one stream with two sinks: every status event, whether its
    hub event was sent, and the status that the analysis has afterwards."""
    from revlens.sources import tables as TB
    from revlens.streaming import jobs as SJ
    from revlens.streaming import lifecycle as LC

    root = SJ.scratch(spark, "stream-status")
    src, table, analyses = f"{root}/source", f"{root}/analyses", P.analyses(spark, d)
    TB.store_keyed(analyses, table)
    sink = LC.StatusSinks(spark, root, table, analyses.schema, job_analysis_id())
    SJ.feed(P.job_events(spark, d), src, "seq", 4, lambda: LC.run_job_stream(spark, src, root, sink=sink))
    sent = LC.hub_log(spark, root).select("seq", F.lit(True).alias("sent"))
    after = TB.read_keyed(spark, table, analyses.schema).select(F.col("id").cast("string").alias("analysis_id"), F.col("status").alias("stored_status"))
    log = LC.status_log(spark, root).join(sent, "seq", "left").join(after, "analysis_id", "left")
    return log.select("job_id", "seq", "kind", "analysis_status", "hub_event", F.coalesce("sent", F.lit(False)).alias("sent"), "stored_status")


# ---------------------------------------------------------------------------
# Counting and the table round trip
@register(
    "count_rows",
    with_scored()
    + """SELECT CAST(count(*) AS BIGINT) AS total,
               CAST(count(*) FILTER (WHERE risk_level = 2 OR quality_score < 50) AS BIGINT) AS matching
         FROM v_scored""",
)
def count_rows(spark, d):
    """A6 with and without a caller predicate (X1), as one aggregate."""
    risky = (F.col("risk_level") == 2) | (F.col("quality_score") < 50)
    return SV.count_rows(scored(spark, d), matching=risky).withColumnRenamed("count", "total")


@register(
    "table_roundtrip",
    sql_with("v_webhooks", extra=SQL_SEGMENTS)
    + """SELECT sha256(repo_name || '#' || CAST(pr_number AS VARCHAR) || '#' || CAST(creator_seq AS VARCHAR)) AS id,
               repo_name, pr_number, pr_title, 0 AS status, 0 AS quality_score, '[]' AS findings_json,
               ts AS created_at
         FROM creators""",
)
def table_roundtrip(spark, d):
    """S4 then S3: append the inserted analyses to a table in the shared
    checkpoint folder, in two appends, and read it back with the fixed schema."""
    from revlens.operators import state as ST
    from revlens.sources import tables as TB
    from revlens.streaming.jobs import scratch

    path = scratch(spark, "analyses-table")
    rows = ST.inserted_rows(P.webhook_rows(spark, d))
    TB.insert_rows(rows.filter(F.col("created_at") < F.lit(AS_OF).cast("timestamp")), path)
    TB.insert_rows(rows.filter(F.col("created_at") >= F.lit(AS_OF).cast("timestamp")), path)
    back = TB.read_table(spark, path, "analyses")
    return back.select("id", "repo_name", "pr_number", "pr_title", "status", "quality_score", "findings_json", "created_at")



@register(
    "analysis_status",
    with_jobs("v_analyses", extra={"eff": SQL_EFFECTIVE})
    + """SELECT a.id, coalesce(l.st, a.status) AS status
         FROM v_analyses a LEFT JOIN (
            SELECT analysis_id, arg_max(analysis_status, seq) AS st
            FROM eff WHERE analysis_status IS NOT NULL GROUP BY analysis_id) l ON l.analysis_id = a.id""",
)
def analysis_status(spark, d):
    """K5: analysis status driven by the job lifecycle events."""
    ev = with_analysis_id(Q.effective_events(P.job_events(spark, d)))
    return Q.apply_status_events(P.analyses(spark, d), ev).select("id", "status")
