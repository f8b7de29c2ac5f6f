"""Scores and risk (A1-A5).

Every per-analysis figure is one `groupBy(analysis_id)` over the findings /
suggestions table: Spark aggregates partially on the map side, so a PR with a
huge number of findings is reduced to one row per task before any shuffle.
The per-analysis results are then left-joined to the analyses on the same key;
both aggregates come out hash-partitioned on `analysis_id`, so the joins add no
exchange beyond the one on the analyses side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens import schemas as S

# --- fixed values: penalties and weights --------------------------------------
BASE_SCORE = 100
SEVERITY_PENALTY = {S.SEV_ERROR: 10, S.SEV_WARNING: 5, S.SEV_INFO: 1}
PRIORITY_PENALTY = {S.PRI_CRITICAL: 15, S.PRI_HIGH: 10, S.PRI_MEDIUM: 5, S.PRI_LOW: 2}
RULE_WEIGHT = 0.6
REVIEW_WEIGHT = 0.4
# ------------------------------------------------------------------------------


def _penalty(code: Column, table: dict[int, int]) -> Column:
    expr = None
    for k, v in table.items():
        expr = F.when(code == k, F.lit(v)) if expr is None else expr.when(code == k, F.lit(v))
    return expr.otherwise(F.lit(0))


def severity_penalty(severity: Column) -> Column:
    return _penalty(severity, SEVERITY_PENALTY)


def priority_penalty(priority: Column) -> Column:
    return _penalty(priority, PRIORITY_PENALTY)


def score_from_penalty(total_penalty: Column) -> Column:
    """max(0, 100 - penalty); a missing penalty (no rows) counts as 0 first."""
    return F.greatest(F.lit(0), F.lit(BASE_SCORE) - F.coalesce(total_penalty, F.lit(0))).cast("int")


def risk_level(errors: Column, warnings: Column) -> Column:
    """A4: ordered rule chain over the error / warning counts."""
    e = F.coalesce(errors, F.lit(0))
    w = F.coalesce(warnings, F.lit(0))
    return (
        F.when(e >= 5, F.lit(S.RISK_HIGH))
        .when((e >= 1) & (w >= 10), F.lit(S.RISK_HIGH))
        .when(e >= 1, F.lit(S.RISK_MEDIUM))
        .when(w >= 15, F.lit(S.RISK_MEDIUM))
        .otherwise(F.lit(S.RISK_LOW))
    )


def quality_score(rule_score: Column, review_score: Column) -> Column:
    """A5: truncation of the IEEE-double weighted sum (not exact decimal)."""
    return (rule_score.cast("double") * F.lit(RULE_WEIGHT) + review_score.cast("double") * F.lit(REVIEW_WEIGHT)).cast(
        "int"
    )


def finding_stats(findings: DataFrame, key: str = "analysis_id") -> DataFrame:
    """A1 + A3 per analysis: penalty sum, error and warning counts."""
    sev = F.col("severity")
    return findings.groupBy(key).agg(
        F.sum(severity_penalty(sev)).alias("finding_penalty"),
        F.count_if(sev == S.SEV_ERROR).cast("int").alias("errors"),
        F.count_if(sev == S.SEV_WARNING).cast("int").alias("warnings"),
        F.count(F.lit(1)).cast("int").alias("finding_count"),
    )


def suggestion_stats(suggestions: DataFrame, key: str = "analysis_id") -> DataFrame:
    """A2 per analysis: priority penalty sum and suggestion count."""
    return suggestions.groupBy(key).agg(
        F.sum(priority_penalty(F.col("priority"))).alias("suggestion_penalty"),
        F.count(F.lit(1)).cast("int").alias("suggestion_count"),
    )


def score_analyses(analyses: DataFrame, findings: DataFrame, suggestions: DataFrame, key: str = "id") -> DataFrame:
    """A1-A5 for every analysis row; analyses without findings / suggestions score 100.

    Returns the analyses columns plus finding_score, suggestion_score, errors,
    warnings, finding_count, suggestion_count; `quality_score` and `risk_level`
    are replaced by the recomputed values.
    """
    fs = finding_stats(findings).withColumnRenamed("analysis_id", key)
    ss = suggestion_stats(suggestions).withColumnRenamed("analysis_id", key)
    out = analyses.join(fs, key, "left").join(ss, key, "left")
    return out.select(
        *[c for c in analyses.columns if c not in ("quality_score", "risk_level")],
        score_from_penalty(F.col("finding_penalty")).alias("finding_score"),
        score_from_penalty(F.col("suggestion_penalty")).alias("suggestion_score"),
        F.coalesce("errors", F.lit(0)).alias("errors"),
        F.coalesce("warnings", F.lit(0)).alias("warnings"),
        F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
        F.coalesce("suggestion_count", F.lit(0)).alias("suggestion_count"),
    ).select(
        "*",
        risk_level(F.col("errors"), F.col("warnings")).alias("risk_level"),
        quality_score(F.col("finding_score"), F.col("suggestion_score")).alias("quality_score"),
    )
