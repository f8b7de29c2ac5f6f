"""Read path: find / page / list / detail / metrics / dashboard.

Everything here is a lazy DataFrame. Metrics are ONE aggregate (the reference
issues up to eight statements); pages and "recent" lists are
`orderBy(...).offset().limit()`, which Spark plans as a distributed top-k
(TakeOrderedAndProject) instead of a full sort. One-row results are combined
with a union + single-row aggregate, never with a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens import schemas as S
from revlens.functions import labels as L

# --- fixed values ---------------------------------------------------------------
SERVICE_PAGE_SIZE = 50
API_PAGE_SIZE = 10
DASHBOARD_RECENT = 5
QUEUE_HEALTH_LIMIT = 50
HIGH_QUALITY_MIN = 90
MEDIUM_QUALITY_MIN = 70
# ----------------------------------------------------------------------------------



def page_order() -> list[Column]:
    return [F.col("processed_at").desc(), F.col("id").asc()]


def find(df: DataFrame, predicate: Column) -> DataFrame:
    """Caller-supplied row predicate (pushed to the scan by Catalyst)."""
    return df.filter(predicate)


def get_by_id(df: DataFrame, id_value: str | int, key: str = "id") -> DataFrame:
    """The row with this id (at most one)."""
    return df.filter(F.col(key) == F.lit(id_value)).limit(1)


def first_or_default(df: DataFrame, predicate: Column, order: list[Column] | None = None) -> DataFrame:
    """First row matching the predicate in a deterministic order (empty if none)."""
    return df.filter(predicate).orderBy(*(order or [F.col("id")])).limit(1)


def by_repo(df: DataFrame, repo: str) -> DataFrame:
    """P5: exact repository match."""
    return df.filter(F.col("repo_name") == F.lit(repo))


def page(df: DataFrame, skip: int = 0, take: int = SERVICE_PAGE_SIZE, order: list[Column] | None = None) -> DataFrame:
    """Newest first with an id tie-break, then skip/take (distributed top-k)."""
    out = df.orderBy(*(order or page_order()))
    if skip:
        out = out.offset(skip)
    return out.limit(take)


def _beyond(processed_at, row_id, inclusive: bool = False) -> Column:
    """Rows behind a place in the page order (newest first, null times last)."""
    t, i = F.col("processed_at"), F.col("id")
    tie = i >= F.lit(row_id) if inclusive else i > F.lit(row_id)
    if processed_at is None:
        return t.isNull() & tie
    at = F.lit(processed_at)
    return t.isNull() | (t < at) | ((t == at) & tie)


def page_after(df: DataFrame, last: tuple | None, take: int = SERVICE_PAGE_SIZE) -> DataFrame:
    """W2, the next page behind the row `last` (processed_at, id), or the first
    page: a seek predicate instead of an offset, so every task keeps at most
    `take` rows at any depth."""
    rows = df if last is None else df.filter(_beyond(*last))
    return rows.orderBy(*page_order()).limit(take)


def page_index(df: DataFrame, step: int = 1000) -> DataFrame:
    """W2, the places of every `step`-th row in the page order: rank, processed_at,
    id. Row counts of a range-sorted table give the ranks, so nothing but two
    columns is sorted and no task holds more than a range."""
    from pyspark.sql import Window

    from revlens.session import materialize

    keys = df.select("processed_at", "id").repartitionByRange(*page_order())
    sorted_ = materialize(keys.withColumn("part", F.spark_partition_id()), "page-keys")
    sizes = sorted_.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # rows are ranges
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*page_order())) - 1
    ranked = sorted_.withColumn("nth", inside).join(starts, "part").withColumn("rank", F.col("start") + F.col("nth"))
    return ranked.filter(F.col("rank") % step == 0).select("rank", "processed_at", "id")


def page_at(df: DataFrame, index: DataFrame, skip: int, take: int = SERVICE_PAGE_SIZE) -> DataFrame:
    """W2 at any depth: seek to the last place of the `page_index` at or before
    `skip`; a task keeps at most the index's step and `take` rows."""
    place = index.filter(F.col("rank") <= skip).orderBy(F.desc("rank")).limit(1).first()
    if place is None:
        return df.limit(0)
    rows = df.filter(_beyond(place["processed_at"], place["id"], inclusive=True)).orderBy(*page_order())
    return rows.offset(skip - place["rank"]).limit(take)


def recent(df: DataFrame, n: int = DASHBOARD_RECENT) -> DataFrame:
    """The n most recent analyses."""
    return page(df, 0, n)


def analysis_list(df: DataFrame) -> DataFrame:
    """10-column list projection with enum labels (columns not listed are pruned)."""
    return df.select(
        "id",
        "repo_name",
        "pr_number",
        "pr_title",
        "pr_author",
        L.enum_label("status", "status").alias("status"),
        "quality_score",
        L.enum_label("risk_level", "risk_level").alias("risk_level"),
        "processed_at",
        "created_at",
    )


def count_rows(df: DataFrame, predicate: Column | None = None, **matching: Column) -> DataFrame:
    """Number of rows, or of rows matching a predicate, as `count`; further
    named predicates (X1) are counted in the same aggregate."""
    first = F.count(F.lit(1)) if predicate is None else F.count_if(predicate)
    return df.agg(first.alias("count"), *[F.count_if(p).alias(n) for n, p in matching.items()])


def quality_metrics(df: DataFrame) -> DataFrame:
    """The eight dashboard numbers in one aggregate; zeros on an empty table.

    The average is rounded half-to-even (bround), like the reference's rounding.
    """
    q = F.col("quality_score")
    r = F.col("risk_level")
    return df.agg(
        F.count(F.lit(1)).cast("int").alias("total"),
        F.count_if(q >= HIGH_QUALITY_MIN).cast("int").alias("high_quality"),
        F.count_if((q >= MEDIUM_QUALITY_MIN) & (q < HIGH_QUALITY_MIN)).cast("int").alias("medium_quality"),
        F.count_if(q < MEDIUM_QUALITY_MIN).cast("int").alias("low_quality"),
        F.coalesce(F.bround(F.avg(q), 0), F.lit(0.0)).cast("int").alias("average_score"),
        F.count_if(r == S.RISK_HIGH).cast("int").alias("high_risk"),
        F.count_if(r == S.RISK_MEDIUM).cast("int").alias("medium_risk"),
        F.count_if(r == S.RISK_LOW).cast("int").alias("low_risk"),
    )


def risk_distribution(metrics: DataFrame) -> DataFrame:
    """A8."""
    return metrics.select(
        F.col("high_risk").alias("high"), F.col("medium_risk").alias("medium"), F.col("low_risk").alias("low")
    )


def quality_distribution(metrics: DataFrame) -> DataFrame:
    """A9."""
    return metrics.select(
        F.col("high_quality").alias("excellent"),
        F.col("medium_quality").alias("good"),
        F.col("low_quality").alias("needs_improvement"),
    )


def queue_status(queue_length: DataFrame) -> DataFrame:
    """Queue length (waiting jobs only) and health flag; input has `queue_length`."""
    return queue_length.select(
        "queue_length",
        (F.col("queue_length") < QUEUE_HEALTH_LIMIT).alias("is_healthy"),
        L.queue_caption(F.col("queue_length")).alias("queue_caption"),
    )


def combine_rows(*frames: DataFrame) -> DataFrame:
    """Merge one-row frames with disjoint columns into one row (union + 1-row aggregate)."""
    merged = frames[0]
    for f in frames[1:]:
        merged = merged.unionByName(f, allowMissingColumns=True)
    cols = []
    for f in frames:
        cols.extend(c for c in f.columns if c not in cols)
    return merged.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def dashboard(analyses: DataFrame, queue_length: DataFrame, n_recent: int = DASHBOARD_RECENT) -> DataFrame:
    """A10: overview + distributions + recent list + queue status, as one row.

    `recent_analyses` is an array of list-projection structs, newest first.
    `recent_notifications` is always empty, as in the reference.
    """
    m = quality_metrics(analyses)
    overview = m.select(
        F.col("total").alias("total_analyses"),
        F.col("average_score").alias("average_quality_score"),
        F.col("high_quality").alias("high_quality_count"),
        F.col("medium_quality").alias("medium_quality_count"),
        F.col("low_quality").alias("low_quality_count"),
        F.col("high_risk").alias("risk_high"),
        F.col("medium_risk").alias("risk_medium"),
        F.col("low_risk").alias("risk_low"),
        L.quality_band(F.col("average_score")).alias("quality_band"),
        L.quality_description(F.col("average_score")).alias("quality_description"),
    )
    top = analysis_list(recent(analyses, n_recent)).drop("created_at")
    # `top` holds at most n rows, so collecting it into one array is bounded.
    recent_row = top.agg(F.collect_list(F.struct(*top.columns)).alias("r")).select(
        F.array_sort(
            "r",
            lambda a, b: F.when(a["processed_at"] > b["processed_at"], -1)
            .when(a["processed_at"] < b["processed_at"], 1)
            .when(a["id"] < b["id"], -1)
            .when(a["id"] > b["id"], 1)
            .otherwise(0),
        ).alias("recent_analyses")
    )
    q = queue_status(queue_length).withColumn("pending_analyses", F.col("queue_length"))
    out = combine_rows(overview, recent_row, q)
    return out.withColumn("recent_notifications", F.array().cast("array<string>"))


def high_risk_errors(analyses: DataFrame, findings: DataFrame) -> DataFrame:
    """P10: Error findings of High-risk analyses (semi-join keeps the finding rows whole)."""
    hi = analyses.filter(F.col("risk_level") == S.RISK_HIGH).select(F.col("id").alias("analysis_id"))
    return findings.filter(F.col("severity") == S.SEV_ERROR).join(hi, "analysis_id", "left_semi")


def analysis_detail(df: DataFrame) -> DataFrame:
    """One analysis with parsed findings (8 fields) and suggestions (10 fields
    + category, impact score, clean tags: T17) and the cleaned summary HTML.

    Expects `findings_json` / `suggestions_json` in the stored format (S6).
    """
    from revlens.functions import html as H
    from revlens.functions import jsonio as J

    findings = F.transform(
        J.read_findings("findings_json"),
        lambda f: F.struct(
            f["Id"].alias("id"),
            f["RuleId"].alias("rule_id"),
            L.enum_label(f["Severity"], "severity").alias("severity"),
            f["Message"].alias("message"),
            f["FilePath"].alias("file_path"),
            f["LineNumber"].alias("line_number"),
            f["Category"].alias("category"),
            f["Description"].alias("description"),
        ),
    )
    suggestions = F.transform(
        J.read_suggestions("suggestions_json"),
        lambda s: F.struct(
            s["Id"].alias("id"),
            L.enum_label(s["Type"], "suggestion_type").alias("type"),
            s["Title"].alias("title"),
            s["Description"].alias("description"),
            L.enum_label(s["Priority"], "priority").alias("priority"),
            s["FilePath"].alias("file_path"),
            s["StartLine"].alias("start_line"),
            s["EndLine"].alias("end_line"),
            s["OriginalCode"].alias("original_code"),
            s["SuggestedCode"].alias("suggested_code"),
            s["Category"].alias("category"),
            s["ImpactScore"].alias("impact_score"),
            J.clean_tags(s["Tags"]).alias("tags"),
        ),
    )
    df = H.with_clean_summary(df, "summary", "_clean_summary")
    return df.select(
        "id",
        "repo_name",
        "pr_number",
        "pr_title",
        "pr_author",
        L.enum_label("status", "status").alias("status"),
        "quality_score",
        L.enum_label("risk_level", "risk_level").alias("risk_level"),
        F.col("_clean_summary").alias("summary"),
        "processed_at",
        "created_at",
        findings.alias("findings"),
        suggestions.alias("suggestions"),
    )
