"""Fixed schemas and enum codes of the review data model.

Enums are stored as integer codes (tables and packed JSON) and shown as labels
in list/detail output.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: enum codes and labels (must match the stored data) -------
RISK_LEVEL = {0: "Low", 1: "Medium", 2: "High"}
ANALYSIS_STATUS = {0: "Pending", 1: "InProgress", 2: "Completed", 3: "Failed"}
SEVERITY = {0: "Info", 1: "Warning", 2: "Error"}
PRIORITY = {0: "Low", 1: "Medium", 2: "High", 3: "Critical"}
SUGGESTION_TYPE = {
    0: "PotentialIssue",
    1: "Refactor",
    2: "Performance",
    3: "Security",
    4: "CodeQuality",
    5: "BestPractice",
}
NOTIFICATION_TYPE = {0: "Started", 1: "Completed", 2: "Failed", 3: "HighRisk"}
JOB_STATUS = {0: "Pending", 1: "Processing", 2: "Completed", 3: "Failed", 4: "Retrying"}
# ---------------------------------------------------------------------------

ENUMS = {
    "risk_level": RISK_LEVEL,
    "status": ANALYSIS_STATUS,
    "severity": SEVERITY,
    "priority": PRIORITY,
    "suggestion_type": SUGGESTION_TYPE,
    "notification_type": NOTIFICATION_TYPE,
    "job_status": JOB_STATUS,
}

# Codes used in expressions.
RISK_LOW, RISK_MEDIUM, RISK_HIGH = 0, 1, 2
ST_PENDING, ST_IN_PROGRESS, ST_COMPLETED, ST_FAILED = 0, 1, 2, 3
SEV_INFO, SEV_WARNING, SEV_ERROR = 0, 1, 2
PRI_LOW, PRI_MEDIUM, PRI_HIGH, PRI_CRITICAL = 0, 1, 2, 3
JOB_PENDING, JOB_PROCESSING, JOB_COMPLETED, JOB_FAILED, JOB_RETRYING = 0, 1, 2, 3, 4

ANALYSES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("repo_name", T.StringType()),
        T.StructField("pr_number", T.IntegerType()),
        T.StructField("pr_title", T.StringType()),
        T.StructField("pr_author", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("quality_score", T.IntegerType()),
        T.StructField("findings_json", T.StringType()),
        T.StructField("suggestions_json", T.StringType()),
        T.StructField("risk_level", T.IntegerType()),
        T.StructField("processed_at", T.TimestampType()),
        T.StructField("raw_diff", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

# Property order of the packed JSON follows the entity declaration order.
FINDING = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("line_number", T.IntegerType()),
        T.StructField("column_number", T.IntegerType()),
        T.StructField("code_snippet", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("suggested_fix", T.StringType()),
    ]
)

SUGGESTION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("line_number", T.IntegerType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("code_snippet", T.StringType()),
        T.StructField("original_code", T.StringType()),
        T.StructField("suggested_code", T.StringType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("category", T.StringType()),
        T.StructField("impact_score", T.IntegerType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)

JOBS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("analysis_id", T.StringType()),
        T.StructField("repo_name", T.StringType()),
        T.StructField("pr_number", T.IntegerType()),
        T.StructField("pr_title", T.StringType()),
        T.StructField("pr_author", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("retry_count", T.IntegerType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("error_message", T.StringType()),
    ]
)

JOB_EVENTS = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("kind", T.StringType()),
    ]
)

NOTIFICATIONS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("analysis_id", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("type", T.IntegerType()),
        T.StructField("is_read", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

_USER = T.StructType([T.StructField("login", T.StringType())])
_REF = T.StructType([T.StructField("sha", T.StringType()), T.StructField("ref", T.StringType())])

WEBHOOK_EVENT = T.StructType(
    [
        T.StructField("action", T.StringType()),
        T.StructField(
            "pull_request",
            T.StructType(
                [
                    T.StructField("number", T.IntegerType()),
                    T.StructField("title", T.StringType()),
                    T.StructField("state", T.StringType()),
                    T.StructField("user", _USER),
                    T.StructField("head", _REF),
                    T.StructField("base", _REF),
                    T.StructField("created_at", T.TimestampType()),
                    T.StructField("updated_at", T.TimestampType()),
                ]
            ),
        ),
        T.StructField(
            "repository",
            T.StructType(
                [
                    T.StructField("name", T.StringType()),
                    T.StructField("full_name", T.StringType()),
                    T.StructField("owner", _USER),
                ]
            ),
        ),
    ]
)

# Review reply body: every field optional; impactScore arrives as text.
REPLY_ITEM = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("priority", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("suggestedCode", T.StringType()),
        T.StructField("impactScore", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)
