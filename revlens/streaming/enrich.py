"""K6: new jobs joined to their analyses and diffs, analysed, reviewed, written back.

One micro-batch, step by step, each stored before the next one reads it:

1. `work`: one row an analysis (its latest job of the batch) with its diff and the
   reason why it fails, if it does: no analysis, or an unreadable diff.
2. `files`: the C# files of the jobs that do not fail, cut out of their diffs once,
   and `findings` of all rules (R5) over them.
3. `replies`: the prompts of the tasks in use are asked once. The folder carries the
   batch's number and a mark that is written after it; a batch that is repeated
   finds the mark and reads the replies instead of asking again.
4. `suggestions` (F9, F10), and with them `outcomes`: scores, risk, summary, status
   Completed or Failed, and the packed findings and suggestions (S6). An analysis
   with a file that the rules could not read is Failed: it keeps its review and the
   findings of its other files, but has no figures or risk of them.
5. The analyses take the outcomes (S5); only the folders of their keys are touched.
   With `metrics` the dashboard's numbers follow the same change (A7-A10).

A batch that is repeated after a crash writes the same rows to the same places.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens import schemas as S
from revlens.functions import jsonio as J
from revlens.operators import diffs as DF
from revlens.operators import queue as Q
from revlens.operators import replies as RP
from revlens.operators import rules as R
from revlens.operators import scoring as SC
from revlens.sources import tables as TB
from revlens.streaming.metrics import RunningMetrics

METRIC_COLUMNS = ("quality_score", "risk_level")
NEW_JOBS = "analysis_id string, repo_name string, pr_number int, pr_title string, ts timestamp"
TASKS = ("summary", "issues")  # the tasks whose replies an analysis keeps
DIFF_BUCKETS = 16  # fixed: folders of the static diff table


def diff_bucket() -> Column:
    return F.pmod(F.hash("repo_name", "pr_number"), F.lit(DIFF_BUCKETS))


def store_diffs(diffs: DataFrame, path: str) -> DataFrame:
    """The static diffs in folders by a fixed hash of their key, sorted by it, so
    that a range of numbers reads only its pages. `error`, if there, says why a
    diff could not be read."""
    error = F.col("error") if "error" in diffs.columns else F.lit(None).cast("string")
    kept = diffs.select("repo_name", "pr_number", "diff", error.alias("error"), diff_bucket().alias("bucket"))
    kept.sortWithinPartitions("bucket", "repo_name", "pr_number").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return diffs.sparkSession.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        return spark.read.schema("done boolean").parquet(path).first() is not None
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


class Enrichment:
    """The steps of a micro-batch. `analyses` is the path of a keyed table with
    `schema`; without it every job counts as known and nothing is written back."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        diffs: DataFrame,
        responder: Callable[[pd.Series], pd.Series],
        diags: DataFrame | None = None,
        analyses: str | None = None,
        schema: T.StructType = S.ANALYSES,
        metrics: RunningMetrics | None = None,
        buckets: int = TB.BUCKETS,
    ) -> None:
        self.metrics, self.buckets = metrics, buckets
        self.spark, self.root, self.diffs, self.responder, self.diags = spark, root, diffs, responder, diags
        self.analyses, self.schema = analyses, schema

    def stored(self, rows: DataFrame, step: str, batch_id: int) -> DataFrame:
        """Scratch of a batch: two slots, so folders do not grow."""
        path = f"{self.root}/{step}/slot={batch_id % 2}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def work(self, batch: DataFrame) -> DataFrame:
        """The batch's jobs. The diffs come last, so that their texts go through one
        exchange, and only those between the batch's least and greatest number."""
        latest = batch.groupBy("analysis_id").agg(F.max(F.struct("ts", "repo_name", "pr_number", "pr_title")).alias("j"))
        jobs = latest.select("analysis_id", "j.*").withColumn("bucket", diff_bucket())
        spans = jobs.groupBy("bucket").agg(F.min("pr_number"), F.max("pr_number")).collect()  # DIFF_BUCKETS rows at most
        lows, highs = ([s[i] for s in spans if s[i] is not None] for i in (1, 2))
        mine = self.diffs.where(F.col("bucket").isin([s[0] for s in spans]))
        mine = mine.where(F.col("pr_number").between(min(lows, default=None), max(highs, default=None)))
        keys = ["bucket", "repo_name", "pr_number"]
        failure = F.lit(None).cast("string")
        if "error" in self.diffs.columns:
            unread = mine.where("error is not null").groupBy(*keys).agg(F.first("error").alias("error"))
            jobs, failure = jobs.join(unread, keys, "left"), F.col("error")
        if self.analyses is not None:
            key = self.schema["id"].dataType
            touched = TB.touched_buckets(jobs.select(F.col("analysis_id").cast(key).alias("id")), buckets=self.buckets)
            known = TB.read_keyed(self.spark, self.analyses, self.schema, touched).select(F.col("id").cast("string").alias("analysis_id"), F.lit(True).alias("known"))
            jobs = jobs.join(known, "analysis_id", "left")
            failure = F.when(F.col("known").isNull(), F.lit(Q.ORPHAN_MESSAGE)).otherwise(failure)
        jobs = jobs.select("analysis_id", "ts", "pr_title", *keys, failure.alias("failure"))
        return DF.attach_diffs(jobs, mine, keys).drop("bucket")

    def replies(self, jobs: DataFrame, batch_id: int) -> DataFrame:
        """The reviewer's replies, asked once whatever happens to the batch."""
        path, mark = f"{self.root}/replies/batch={batch_id}", f"{self.root}/asked/batch={batch_id}"
        asked = RP.review_prompts(jobs, "analysis_id", "diff", "pr_title", tasks=TASKS)
        if not exists(self.spark, mark):
            RP.respond(asked, self.responder, keep_prompt=False).write.mode("overwrite").parquet(path)
            self.spark.range(1).select(F.lit(True).alias("done")).write.mode("overwrite").parquet(mark)
        return self.spark.read.parquet(path)

    def outcomes(self, work: DataFrame, found: DataFrame, replies: DataFrame, suggestions: DataFrame) -> DataFrame:
        scored = (
            work.join(SC.finding_stats(found), "analysis_id", "left")
            .join(SC.suggestion_stats(suggestions), "analysis_id", "left")
            .join(RP.summaries(replies.where("task = 'summary'"), "analysis_id"), "analysis_id", "left")
            .join(R.unread_message(found), "analysis_id", "left")
            .join(J.pack_findings(R.finding_ids(found)), "analysis_id", "left")
            .join(J.pack_suggestions(suggestions), "analysis_id", "left")
        )
        begun = F.col("failure").isNull()
        good = begun & F.col("unread").isNull()
        if_begun = lambda c: F.when(begun, c)
        if_good = lambda c: F.when(good, c)
        out = scored.select(
            "analysis_id",
            F.when(good, F.lit(S.ST_COMPLETED)).otherwise(F.lit(S.ST_FAILED)).alias("status"),
            F.coalesce("failure", "unread").alias("error_message"),
            *[if_good(F.coalesce(c, F.lit(0))).alias(c) for c in ("finding_count", "errors", "warnings")],
            if_begun(F.coalesce("suggestion_count", F.lit(0))).alias("suggestion_count"),
            if_good(SC.score_from_penalty(F.col("finding_penalty"))).alias("finding_score"),
            if_begun(SC.score_from_penalty(F.col("suggestion_penalty"))).alias("suggestion_score"),
            if_good(SC.risk_level(F.col("errors"), F.col("warnings"))).alias("risk_level"),
            if_begun(F.col("summary")).alias("summary"),
            *[if_begun(F.coalesce(c, F.lit("[]"))).alias(c) for c in ("findings_json", "suggestions_json")],
            if_good(F.col("ts")).alias("processed_at"),
            F.col("ts").alias("updated_at"),
        )
        return out.withColumn("quality_score", SC.quality_score(F.col("finding_score"), F.col("suggestion_score")))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        work = self.stored(self.work(batch), "work", batch_id)
        jobs = work.where("failure is null")
        own = None if self.diags is None else self.diags.join(jobs.select("analysis_id"), "analysis_id", "left_semi")
        files = DF.csharp_files(DF.changed_files(jobs)).select(*R.LINE_KEYS, "file_path", "content")
        files = self.stored(files, "files", batch_id)
        found = self.stored(R.analyze_files(files, own), "findings", batch_id)
        replies = self.replies(jobs, batch_id)
        parsed = RP.parse_replies(replies.where("task = 'issues' and not failed"), "analysis_id")
        suggestions = self.stored(parsed, "suggestions", batch_id)
        path = f"{self.root}/outcomes/batch={batch_id}"
        self.outcomes(work, found, replies, suggestions).write.mode("overwrite").parquet(path)
        if self.analyses is not None:
            done = self.spark.read.parquet(path)
            key = F.col("analysis_id").cast(self.schema["id"].dataType).alias("id")
            set_columns = ("status", "summary", "quality_score", "findings_json", "suggestions_json", "risk_level", "processed_at", "updated_at")
            changes = done.select(key, *set_columns)
            if self.metrics is not None:
                old = self.before(changes.select("id"), batch_id)
                new = old.select("id", *[F.col(c).alias(f"old_{c}") for c in METRIC_COLUMNS]).join(changes, "id")
                new = new.select(*[F.coalesce(c, f"old_{c}").alias(c) for c in METRIC_COLUMNS])
                self.metrics.change(old.select(*METRIC_COLUMNS), new, batch_id)
            TB.update_touched(self.spark, self.analyses, self.schema, changes, buckets=self.buckets)

    def before(self, ids: DataFrame, batch_id: int) -> DataFrame:
        """The analyses as they were before the batch, stored once."""
        path, mark = f"{self.root}/before/batch={batch_id}", f"{self.root}/noted/batch={batch_id}"
        if not exists(self.spark, mark):
            rows = TB.read_keyed(self.spark, self.analyses, self.schema, TB.touched_buckets(ids, buckets=self.buckets))
            rows.select("id", *METRIC_COLUMNS).join(ids, "id", "left_semi").write.mode("overwrite").parquet(path)
            self.spark.range(1).select(F.lit(True).alias("done")).write.mode("overwrite").parquet(mark)
        return self.spark.read.parquet(path)


def run_enrich_stream(
    spark: SparkSession,
    source: str,
    root: str,
    diffs: DataFrame,
    responder: Callable[[pd.Series], pd.Series],
    diags: DataFrame | None = None,
    analyses: str | None = None,
    schema: T.StructType = S.ANALYSES,
    metrics: RunningMetrics | None = None,
    buckets: int = TB.BUCKETS,
) -> DataFrame:
    """K6: take in all new-job files that have arrived and return the outcomes so
    far, a row for every analysis and batch. `diffs` is a table of `store_diffs`,
    `analyses` one of `tables.store_keyed`. Several jobs of one analysis in a
    batch are one job, the latest; jobs without an analysis id are left out."""
    from revlens.streaming.jobs import run_available

    step = Enrichment(spark, root, diffs, responder, diags, analyses, schema, metrics, buckets)
    run_available(spark, source, NEW_JOBS, root, lambda b, i: step(b.where("analysis_id is not null"), i))
    return spark.read.parquet(f"{root}/outcomes").drop("batch")
