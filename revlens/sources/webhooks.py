"""Pull-request webhook events.

Nested webhook JSON is read with an explicit schema (no inference), batch or
streaming, and flattened. Absent nested objects / strings become '' and absent
numbers 0, like the reference's class defaults; an explicit
`"pull_request": null` is rejected, and text that is not a JSON object is
marked malformed (it fails that event only, never the job).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens import schemas as S

# --- fixed values ---------------------------------------------------------------
OK, REJECTED, MALFORMED = "ok", "rejected", "malformed"
# ----------------------------------------------------------------------------------


def _s(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def parse_pr_events(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Flatten a string column of webhook JSON into event columns (+ `parse_status`)."""
    keys = F.json_object_keys(F.col(raw))
    p = F.from_json(F.col(raw), S.WEBHOOK_EVENT)
    explicit_null = F.array_contains(keys, "pull_request") & F.get_json_object(F.col(raw), "$.pull_request").isNull()
    status = (
        F.when(keys.isNull(), F.lit(MALFORMED)).when(explicit_null, F.lit(REJECTED)).otherwise(F.lit(OK))
    )
    pr = p["pull_request"]
    repo = p["repository"]
    rest = [c for c in df.columns if c != raw]
    return df.select(
        *rest,
        status.alias("parse_status"),
        _s(p["action"]).alias("action"),
        _s(repo["full_name"]).alias("repo_name"),
        _s(repo["name"]).alias("repo_short"),
        _s(repo["owner"]["login"]).alias("repo_owner"),
        F.coalesce(pr["number"], F.lit(0)).alias("pr_number"),
        _s(pr["title"]).alias("pr_title"),
        _s(pr["state"]).alias("pr_state"),
        _s(pr["user"]["login"]).alias("pr_author"),
        _s(pr["head"]["sha"]).alias("head_sha"),
        _s(pr["head"]["ref"]).alias("head_ref"),
        _s(pr["base"]["sha"]).alias("base_sha"),
        _s(pr["base"]["ref"]).alias("base_ref"),
        pr["created_at"].alias("pr_created_at"),
        pr["updated_at"].alias("pr_updated_at"),
    )


def read_pr_events(spark: SparkSession, path: str, streaming: bool = False, **options) -> DataFrame:
    """JSON-lines webhook files -> flat events. Each line is kept as text
    first so a malformed line is flagged instead of failing the read."""
    reader = spark.readStream if streaming else spark.read
    raw = reader.options(**options).format("text").load(path).withColumnRenamed("value", "raw")
    return parse_pr_events(raw, "raw")


def run_webhook_stream(spark: SparkSession, path: str, root: str, files_per_batch: int | None = None) -> DataFrame:
    """S1 as a file stream: take in all JSON-lines files that have arrived. Each
    batch's flat events are written under its number, bad lines included with
    their status, so a repeated batch writes the same rows again. Returns all
    events so far."""
    options = {"maxFilesPerTrigger": files_per_batch} if files_per_batch else {}
    events = read_pr_events(spark, path, streaming=True, **options)
    out = f"{root}/events"
    writer = events.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"))
    writer.option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(out)


def encode_pr_event(action: Column, repo: Column, number: Column, title: Column, author: Column, ts: Column) -> Column:
    """Webhook JSON text for one event (used to turn event tables into payloads)."""
    owner = F.split(repo, "/")[0]
    name = F.element_at(F.split(repo, "/"), -1)
    return F.to_json(
        F.struct(
            action.alias("action"),
            F.struct(
                number.alias("number"),
                title.alias("title"),
                F.lit("open").alias("state"),
                F.struct(author.alias("login")).alias("user"),
                F.struct(F.sha1(title).alias("sha"), F.lit("feature").alias("ref")).alias("head"),
                F.struct(F.lit("").alias("sha"), F.lit("main").alias("ref")).alias("base"),
                ts.alias("created_at"),
                ts.alias("updated_at"),
            ).alias("pull_request"),
            F.struct(name.alias("name"), repo.alias("full_name"), F.struct(owner.alias("login")).alias("owner")).alias(
                "repository"
            ),
        )
    )
