"""Keyed analysis state from pull-request events.

An event is (seq, ts, action, repo_name, pr_number, pr_title, pr_author).
Actions opened / synchronize / reopened upsert the analysis of (repo, pr);
closed deletes it; anything else (and any other casing) is ignored.

Replaying a log per key: only events after the key's last `closed` matter; the
first of them creates the row (its id, created_at), the last one sets title,
author and updated_at. Both are aggregations (partial on the map side), joined
back on the key, so a key with a huge number of events is still split across
tasks (AQE skew join + partial aggregation) instead of landing in one task.

Row ids are sha2 of (repo, pr, seq of the creating event), so reruns repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens import schemas as S
from revlens.operators.scan import DEFAULT_SPAN, running_max

# --- fixed values ---------------------------------------------------------------
UPSERT_ACTIONS = ("opened", "synchronize", "reopened")
DELETE_ACTION = "closed"
NOT_FOUND = "no analysis found"
DELETED = "deleted"
# ----------------------------------------------------------------------------------

KEY = ["repo_name", "pr_number"]


def route_action(action) -> Column:
    """P4: 'upsert' | 'delete' | null (ignored); case-sensitive."""
    a = F.col(action) if isinstance(action, str) else action
    return F.when(a.isin(*UPSERT_ACTIONS), F.lit("upsert")).when(a == DELETE_ACTION, F.lit("delete"))


def analysis_id(repo: Column, pr: Column, seq: Column) -> Column:
    return F.sha2(F.concat_ws("#", repo, pr.cast("string"), seq.cast("string")), 256)


def default_values(now: Column, updated: Column | None = None) -> dict[str, Column]:
    """P9 + F26: the values of a fresh analysis (Pending, score 0, Low, '[]'
    JSON, empty text); `now` is the write time (one literal per run, or the
    event time for replays)."""
    return {
        "summary": F.lit(""),
        "quality_score": F.lit(0),
        "findings_json": F.lit("[]"),
        "suggestions_json": F.lit("[]"),
        "risk_level": F.lit(S.RISK_LOW),
        "processed_at": now,
        "raw_diff": F.lit(""),
        "status": F.lit(S.ST_PENDING),
        "created_at": now,
        "updated_at": now if updated is None else updated,
    }


def new_analysis_defaults(rows: DataFrame, now: Column, updated: Column | None = None) -> DataFrame:
    """P9 rows; `rows` carries id, repo_name, pr_number, pr_title, pr_author."""
    values = default_values(now, updated)
    return rows.select(
        "id", "repo_name", F.col("pr_number").cast("int").alias("pr_number"), "pr_title", "pr_author", *[v.alias(c) for c, v in values.items()]
    )


def _summarise(events: DataFrame) -> DataFrame:
    """Per key: last close seq, and the first/last upsert after it (if any)."""
    ev = events.withColumn("_route", route_action("action")).filter(F.col("_route").isNotNull())
    last_close = (
        ev.filter(F.col("_route") == "delete").groupBy(*KEY).agg(F.max("seq").alias("last_close"))
    )
    ups = ev.filter(F.col("_route") == "upsert").join(last_close, KEY, "left")
    live = ups.filter(F.col("last_close").isNull() | (F.col("seq") > F.col("last_close")))
    alive = live.groupBy(*KEY).agg(
        F.min(F.struct("seq", "ts")).alias("first"),
        F.max(F.struct("seq", "ts", "pr_title", "pr_author")).alias("last"),
    )
    return alive, last_close


def _created_rows(alive: DataFrame) -> DataFrame:
    rows = alive.select(
        analysis_id(F.col("repo_name"), F.col("pr_number"), F.col("first.seq")).alias("id"),
        *KEY,
        F.col("last.pr_title").alias("pr_title"),
        F.col("last.pr_author").alias("pr_author"),
        F.col("first.ts").alias("_created"),
        F.col("last.ts").alias("_updated"),
    )
    return new_analysis_defaults(rows, F.col("_created"), F.col("_updated"))


def replay(events: DataFrame) -> DataFrame:
    """Current analysis rows after applying a whole event log from empty state."""
    alive, _ = _summarise(events)
    return _created_rows(alive)


def apply_batch(state: DataFrame, events: DataFrame) -> DataFrame:
    """J3 + J4 for one batch of events on an existing state table.

    Matched key without a close in the batch: title, author, status=Pending and
    updated_at overwritten, everything else kept (old scores stay, T2).
    A close in the batch deletes the row; upserts after that close create a new
    row (new id). Unmatched keys with upserts get a P9 row.
    """
    alive, last_close = _summarise(events)
    batch = alive.join(last_close, KEY, "full_outer")
    s = state.withColumn("_in_state", F.lit(True))
    j = s.join(batch, KEY, "full_outer")

    closed = F.col("last_close").isNotNull()
    has_up = F.col("first").isNotNull()
    in_state = F.coalesce(F.col("_in_state"), F.lit(False))

    keep_old = in_state & ~closed & ~has_up
    update_old = in_state & ~closed & has_up
    create = has_up & (closed | ~in_state)

    fresh = default_values(F.col("first.ts"), F.col("last.ts")) | {
        "id": analysis_id(F.col("repo_name"), F.col("pr_number"), F.col("first.seq")),
        "repo_name": F.col("repo_name"),
        "pr_number": F.col("pr_number").cast("int"),
        "pr_title": F.col("last.pr_title"),
        "pr_author": F.col("last.pr_author"),
    }
    changed = {
        "pr_title": F.col("last.pr_title"),
        "pr_author": F.col("last.pr_author"),
        "status": F.lit(S.ST_PENDING),
        "updated_at": F.col("last.ts"),
    }

    def value(c: str) -> Column:
        old = F.when(update_old, changed[c]).otherwise(F.col(c)) if c in changed else F.col(c)
        return F.when(create, fresh[c]).otherwise(old).alias(c)

    return j.filter(create | update_old | keep_old).select(*[value(c) for c in state.columns])


PRIOR_SEQ = -(1 << 62)  # a stored analysis comes before every event


def closed_report(events: DataFrame, span: int = DEFAULT_SPAN, prior: DataFrame | None = None) -> DataFrame:
    """For every close event, whether an analysis existed (deleted) or not,
    and which. The analysis that a close deletes was created by the first upsert
    after the close before it, or is one of `prior` (id and key), the analyses
    stored before the events."""
    ev = events.withColumn("_route", route_action("action")).filter(F.col("_route").isNotNull())
    if prior is not None:
        stored = prior.select(*KEY, F.lit(PRIOR_SEQ).alias("seq"), F.lit("upsert").alias("_route"))
        ev = ev.select(*KEY, "seq", "pr_title", "_route").unionByName(stored, allowMissingColumns=True)
    scanned = running_max(
        ev.select(*KEY, "seq", "pr_title", "_route"),
        KEY,
        "seq",
        {"prev_close": F.when(F.col("_route") == "delete", F.col("seq"))},
        inclusive=False,
        span=span,
    ).withColumn("seg", F.coalesce("prev_close", F.lit(-1)))
    upsert = F.col("_route") == "upsert"
    segments = scanned.groupBy(*KEY, "seg").agg(
        F.min(F.when(upsert, F.col("seq"))).alias("creator_seq"),
        F.min(F.when(~upsert, F.struct("seq", "pr_title"))).alias("close"),
    )
    found = F.coalesce(F.col("creator_seq") < F.col("close.seq"), F.lit(False))
    own = analysis_id(F.col("repo_name"), F.col("pr_number"), F.col("creator_seq"))
    if prior is not None:
        segments = segments.join(prior.select(*KEY, F.col("id").alias("_prior_id")), KEY, "left")
        own = F.when(F.col("creator_seq") == PRIOR_SEQ, F.col("_prior_id")).otherwise(own)
    return segments.filter(F.col("close").isNotNull()).select(
        F.col("close.seq").alias("seq"),
        *KEY,
        F.col("close.pr_title").alias("pr_title"),
        F.when(found, F.lit(DELETED)).otherwise(F.lit(NOT_FOUND)).alias("outcome"),
        F.when(found, own).alias("analysis_id"),
    )


def inserted_rows(events: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """S4 feed: every row the replay inserts over time (first upsert after each close)."""
    ev = events.withColumn("_route", route_action("action")).filter(F.col("_route").isNotNull())
    scanned = running_max(
        ev.select(*KEY, "seq", "ts", "pr_title", "pr_author", "_route"),
        KEY,
        "seq",
        {"seg": F.when(F.col("_route") == "delete", F.col("seq"))},
        span=span,
    ).filter(F.col("_route") == "upsert")
    firsts = scanned.groupBy(*KEY, F.coalesce(F.col("seg"), F.lit(-1)).alias("seg")).agg(
        F.min(F.struct("seq", "ts", "pr_title", "pr_author")).alias("f")
    )
    rows = firsts.select(
        analysis_id(F.col("repo_name"), F.col("pr_number"), F.col("f.seq")).alias("id"),
        *KEY,
        F.col("f.pr_title").alias("pr_title"),
        F.col("f.pr_author").alias("pr_author"),
        F.col("f.ts").alias("_ts"),
    )
    return new_analysis_defaults(rows, F.col("_ts"))


def delete_cascade(analyses: DataFrame, notifications: DataFrame, deleted_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove analyses by id and, by cascade, their notifications."""
    ids = deleted_ids.select(F.col("id"))
    kept_a = analyses.join(ids, "id", "left_anti")
    kept_n = notifications.join(ids.withColumnRenamed("id", "analysis_id"), "analysis_id", "left_anti")
    return kept_a, kept_n


def with_notifications(analyses: DataFrame, notifications: DataFrame) -> DataFrame:
    """One row per analysis and notification (nulls where it has none).
    Rows, not a list, so an analysis with very many notifications is no single
    large row and a skewed key can be split."""
    n = notifications.select(F.col("analysis_id").alias("id"), *[F.col(c).alias(f"notification_{c}") for c in notifications.columns if c != "analysis_id"])
    return analyses.join(n, "id", "left")


def notification_summary(analyses: DataFrame, notifications: DataFrame) -> DataFrame:
    """J1 summarised per analysis.

    Notifications are aggregated per analysis first (partial aggregation, so a
    hot analysis is reduced map-side), then joined one-to-one; analyses with no
    notification get zero counts. The summary carries count, unread count and
    the latest notification (by created_at, id) instead of an unbounded list.
    """
    per = notifications.groupBy("analysis_id").agg(
        F.count(F.lit(1)).cast("int").alias("notification_count"),
        F.count_if(~F.col("is_read")).cast("int").alias("unread_count"),
        F.max(F.struct("created_at", "id", "type")).alias("_latest"),
    )
    j = analyses.join(per.withColumnRenamed("analysis_id", "id"), "id", "left")
    return j.select(
        *analyses.columns,
        F.coalesce("notification_count", F.lit(0)).alias("notification_count"),
        F.coalesce("unread_count", F.lit(0)).alias("unread_count"),
        F.col("_latest.id").alias("latest_notification_id"),
        F.col("_latest.type").alias("latest_notification_type"),
    )
