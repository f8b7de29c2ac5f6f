"""The notification events as one typed table.

NewPullRequest and PullRequestClosed follow from the webhook log,
AnalysisUpdated and AnalysisCompleted from the job log; a job without an
analysis record sends nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators import state as ST


COLUMNS = ("event", "seq", "repo_name", "pr_number", "title", "author", "analysis_id")


def webhook_notifications(webhooks: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """NewPullRequest and PullRequestClosed; `prior`: the analyses stored before
    the events (see state.closed_report)."""
    new = webhooks.filter(ST.route_action("action") == "upsert").select(
        F.lit("NewPullRequest").alias("event"),
        "seq",
        "repo_name",
        "pr_number",
        F.col("pr_title").alias("title"),
        F.col("pr_author").alias("author"),
    )
    closed = ST.closed_report(webhooks, prior=prior).filter(F.col("outcome") == ST.DELETED).select(
        F.lit("PullRequestClosed").alias("event"), "seq", "repo_name", "pr_number", F.col("pr_title").alias("title"), "analysis_id"
    )
    return new.unionByName(closed, allowMissingColumns=True).select(*COLUMNS)


def notification_log(webhooks: DataFrame, job_events: DataFrame, analyses: DataFrame) -> DataFrame:
    """`job_events`: effective events with analysis_id (see queue.effective_events)."""
    hub = (
        job_events.filter(F.col("hub_event").isNotNull())
        .join(analyses.select(F.col("id").alias("analysis_id")), "analysis_id", "left_semi")
        .select(F.col("hub_event").alias("event"), "seq", F.col("analysis_id").cast("string").alias("analysis_id"))
    )
    return webhook_notifications(webhooks).unionByName(hub, allowMissingColumns=True).select(*COLUMNS)
