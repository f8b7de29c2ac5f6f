"""Review replies -> suggestions.

The strict part of reply parsing (T12: case-insensitive keys, duplicate keys,
no trailing text, NaN rejected, wrong value types fail the whole reply) runs in
a small UDF that takes some rows at a time: `json.loads` on the already extracted JSON
object (F8 is a JVM expression), emitting a canonical JSON list with lower-case
keys and string values, or null on failure. Everything else — fallbacks,
priority / type / impact parsing, defaults, ids, the explode — is JVM-side.

The reviewer itself is pluggable (X2): any `pd.Series[str] -> pd.Series[str]`
callable, run over prompt rows with `mapInArrow`, partitioned like the input.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens import schemas as S
from revlens.functions import replies as RF

ASKED_AT_ONCE = 100  # prompts a reviewer gets in one call

_FIELDS = ("type", "title", "description", "priority", "category", "suggestedcode", "impactscore", "tags")
_CANON = T.ArrayType(
    T.StructType(
        [T.StructField(f, T.StringType()) for f in _FIELDS[:-1]] + [T.StructField("tags", T.ArrayType(T.StringType()))]
    )
)


def _reject_constant(name):
    raise ValueError(name)


def _canonical(text: str | None) -> str | None:
    """One reply JSON object -> canonical suggestion list (JSON text) or None."""
    if text is None:
        return None
    try:
        doc = json.loads(text, parse_constant=_reject_constant)
        if not isinstance(doc, dict):
            return None
        top = {k.lower(): v for k, v in doc.items()}
        items = top.get("suggestions")
        if items is None:
            return "[]"
        if not isinstance(items, list):
            return None
        out = []
        for it in items:
            if it is None:
                continue
            if not isinstance(it, dict):
                return None
            low = {k.lower(): v for k, v in it.items()}
            row = {}
            for f in _FIELDS[:-1]:
                v = low.get(f)
                if v is None or isinstance(v, str):
                    row[f] = v
                elif f == "impactscore" and isinstance(v, (int, float)) and not isinstance(v, bool):
                    row[f] = str(int(v)) if float(v).is_integer() else str(v)  # T12: numbers accepted
                else:
                    return None
            tags = low.get("tags")
            if tags is not None and (not isinstance(tags, list) or any(t is not None and not isinstance(t, str) for t in tags)):
                return None
            row["tags"] = tags
            out.append(row)
        return json.dumps(out)
    except (ValueError, TypeError, RecursionError):
        return None


canonical_suggestions = F.udf(_canonical, T.StringType(), useArrow=False)


def parse_replies(
    replies: DataFrame, key: str, reply: str = "reply", default_type=0, file_label="mixed", fallback_limit: int | None = None
) -> DataFrame:
    """F9 + F10: one row per suggestion of each reply.

    * empty / null reply -> no rows
    * no JSON object in the text -> one Medium suggestion, impact 5, tag gpt-analysis
    * invalid JSON -> one Low suggestion, impact 3, tags gpt-analysis + parse-error
    * valid JSON -> its suggestions with defaults; `{"suggestions": null}` -> none
    `default_type` / `file_label` may be ints/strings or Columns (caller's values).
    The two fallbacks carry the whole reply text, or its first `fallback_limit`
    characters.
    """
    r = F.col(reply)
    dtype = F.lit(default_type) if isinstance(default_type, int) else default_type
    label = F.lit(file_label) if isinstance(file_label, str) else file_label
    obj = RF.extract_json(r)
    staged = replies.select(
        key,
        r.alias("_reply"),
        obj.alias("_obj"),
        dtype.alias("_dtype"),
        label.alias("_label"),
    ).withColumn("_canon", F.when(F.col("_obj").isNotNull(), canonical_suggestions(F.col("_obj"))))
    parsed = F.from_json(F.col("_canon"), _CANON)
    short = F.col("_reply") if fallback_limit is None else RF.truncate(F.col("_reply"), fallback_limit)

    def fallback(title: str, prio: int, impact: int, tags: list[str]) -> Column:
        return F.array(
            F.struct(
                F.col("_dtype").alias("type"),
                F.lit(title).alias("title"),
                short.alias("description"),
                F.lit(prio).alias("priority"),
                F.lit(RF.DEFAULT_CATEGORY).alias("category"),
                F.lit(None).cast("string").alias("suggested_code"),
                F.lit(impact).alias("impact_score"),
                F.array(*[F.lit(t) for t in tags]).alias("tags"),
            )
        )

    from_items = F.transform(
        parsed,
        lambda s: F.struct(
            RF.parse_type(s["type"], F.col("_dtype")).alias("type"),
            F.coalesce(s["title"], F.lit(RF.DEFAULT_TITLE)).alias("title"),
            F.coalesce(s["description"], F.lit(RF.DEFAULT_DESCRIPTION)).alias("description"),
            RF.parse_priority(s["priority"]).alias("priority"),
            F.coalesce(s["category"], F.lit(RF.DEFAULT_CATEGORY)).alias("category"),
            s["suggestedcode"].alias("suggested_code"),
            RF.parse_impact(s["impactscore"]).alias("impact_score"),
            F.coalesce(s["tags"], F.array().cast("array<string>")).alias("tags"),
        ),
    )
    lst = (
        F.when(F.col("_reply").isNull() | (F.col("_reply") == ""), F.array().cast(from_items_type()))
        .when(F.col("_obj").isNull(), fallback(RF.TEXT_TITLE, S.PRI_MEDIUM, 5, RF.TEXT_TAGS))
        .when(F.col("_canon").isNull(), fallback(RF.ERROR_TITLE, S.PRI_LOW, 3, RF.ERROR_TAGS))
        .otherwise(from_items)
    )
    ex = staged.select(key, "_label", F.posexplode(lst).alias("idx", "s"))
    return ex.select(
        key,
        "idx",
        F.sha2(F.concat_ws("#", F.col(key).cast("string"), F.col("idx").cast("string")), 256).alias("id"),
        F.col("s.type").cast("int").alias("type"),
        F.col("s.title").alias("title"),
        F.col("s.description").alias("description"),
        F.col("_label").alias("file_path"),
        F.col("s.priority").cast("int").alias("priority"),
        F.col("s.category").alias("category"),
        F.col("s.suggested_code").alias("suggested_code"),
        F.col("s.impact_score").cast("int").alias("impact_score"),
        F.col("s.tags").alias("tags"),
    )


def from_items_type() -> str:
    return (
        "array<struct<type:int,title:string,description:string,priority:int,category:string,"
        "suggested_code:string,impact_score:int,tags:array<string>>>"
    )


TASKS = {"summary": RF.SUMMARY_LIMIT, "issues": RF.ISSUES_LIMIT, "refactor": RF.REFACTOR_LIMIT, "security": RF.SECURITY_LIMIT}


def review_prompts(
    rows: DataFrame, key: str, text: str, title: str, file_name: str | None = None, tasks: Iterable[str] = tuple(TASKS)
) -> DataFrame:
    """F5 + F6: the prompts of the tasks (all four by default) for each row, in
    numbered parts: key, task, part, parts, truncated, prompt, and the title for
    fallbacks. Without `file_name` the refactoring task names the title."""
    build = {
        "summary": lambda p: RF.summary_prompt(p, F.col(title)),
        "issues": RF.issues_prompt,
        "refactor": lambda p: RF.refactor_prompt(p, F.col(file_name or title)),
        "security": RF.security_prompt,
    }

    def named(task: str, limit: int) -> Column:
        made = RF.prompts(text, build[task], limit)
        return F.transform(made, lambda p: F.struct(F.lit(task).alias("task"), p["part"], p["parts"], p["truncated"], p["prompt"]))

    asked = [named(task, TASKS[task]) for task in tasks]
    return rows.select(key, F.col(title).alias("title"), F.inline(F.concat(*asked))).toDF(key, "title", "task", "part", "parts", "truncated", "prompt")


def respond(
    prompts: DataFrame, responder: Callable[[pd.Series], pd.Series], prompt: str = "prompt", keep_prompt: bool = True
) -> DataFrame:
    """Run a reviewer over prompt rows (slices of Arrow batches via mapInArrow,
    so that few texts at a time are Python objects); adds `reply` and `failed`. Where a batch fails, its prompts are asked one by one,
    and those that fail again get no reply and failed = true: one pull request
    never fails the others. Without `keep_prompt` the prompts, most of the bytes,
    do not come back."""
    kept = [f for f in prompts.schema.fields if keep_prompt or f.name != prompt]
    schema = T.StructType(kept + [T.StructField("reply", T.StringType()), T.StructField("failed", T.BooleanType())])
    nth = prompts.columns.index(prompt)

    def alone(text: str) -> tuple[str | None, bool]:
        try:
            return responder(pd.Series([text])).iloc[0], False
        except Exception:  # noqa: BLE001 - whatever the reviewer raises concerns this prompt only
            return None, True

    def answered(part: pa.RecordBatch) -> pa.RecordBatch:
        out = pd.DataFrame({"asked": part.column(nth).to_pandas()})
        try:
            out["reply"], out["failed"] = responder(out["asked"]).astype(object), False
        except Exception:  # noqa: BLE001
            each = [alone(t) for t in out["asked"]]
            out["reply"], out["failed"] = pd.Series([r for r, _ in each], out.index, object), [f for _, f in each]
        reply = pa.Array.from_pandas(out["reply"], type=part.schema.field(nth).type)
        others = [part.column(i) for i in range(part.num_columns) if keep_prompt or i != nth]
        return pa.RecordBatch.from_arrays([*others, reply, pa.array(out["failed"], pa.bool_())], names=schema.names)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ASKED_AT_ONCE):
                yield answered(batch.slice(at, ASKED_AT_ONCE))
            del batch  # before the next one is read

    return prompts.mapInArrow(run, schema)


def summaries(replies: DataFrame, key: str) -> DataFrame:
    """F7 per key: the replies to its summary prompts in the order of the parts;
    one failed part makes the error text, none with text the empty one."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("part", "reply"))), lambda x: x["reply"])
    per = replies.groupBy(key).agg(F.first("title").alias("title"), F.bool_or("failed").alias("failed"), texts.alias("texts"))
    joined = F.array_join("texts", "\n")
    return per.select(key, RF.summary_text(F.when(joined != "", joined), "title", failed="failed").alias("summary"))


def with_review(analyses: DataFrame, replies: DataFrame, key: str = "id") -> DataFrame:
    """Each analysis with the summaries its reviews gave, a row each.
    `replies`: key, reply, failed. An analysis without a row there was not
    reviewed (no reviewer configured); a failed review and one without text have
    texts of their own."""
    r = replies.withColumnsRenamed({"reply": "_r", "failed": "_failed"}).withColumn("_asked", F.lit(True))
    j = analyses.join(r, key, "left")
    text = RF.summary_text(
        F.col("_r"), F.col("pr_title"), configured=F.coalesce("_asked", F.lit(False)), failed=F.coalesce("_failed", F.lit(False))
    )
    return j.withColumn("summary", text).drop("_r", "_failed", "_asked")
