"""K2-K6, S5 and S7 on keyed state and keyed tables."""

import os
import re
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from revlens import schemas as S
from revlens.operators import queue as Q
from revlens.operators import rules as R
from revlens.operators import scoring as SC
from revlens.operators import serving as SV
from revlens.operators import state as ST
from revlens.sources import tables as TB
from revlens.streaming import enrich as EN
from revlens.streaming import jobs as SJ
from revlens.streaming import lifecycle as LC
from revlens.streaming.metrics import RunningMetrics

T0 = datetime(2024, 1, 1)
JOB = "job_id string, seq long, ts timestamp, kind string, message string"


def events(spark, *rows):
    """(job, seq, kind[, hours after T0])."""
    made = [(r[0], r[1], T0 + (timedelta(hours=r[3]) if len(r) > 3 else timedelta(seconds=r[1])), r[2], f"m{r[1]}") for r in rows]
    return spark.createDataFrame(made, JOB)


def deliver(df, root):
    df.coalesce(1).write.mode("append").parquet(f"{root}/src")


# --- keyed tables ------------------------------------------------------------------------
def parquet_files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def analyses(spark, n, path, key="string"):
    rows = spark.range(n).select(F.col("id").cast(key).alias("id"), F.lit("o/a").alias("repo_name"), F.col("id").cast("int").alias("pr_number"), F.lit("t").alias("pr_title"), F.lit("u").alias("pr_author"))
    TB.store_keyed(ST.new_analysis_defaults(rows, F.lit("2023-12-31").cast("timestamp")), path)


def test_update_rewrites_the_touched_folders_only(spark):
    path = f"{SJ.scratch(spark, 'test-keyed')}/t"
    analyses(spark, 300, path)
    before = parquet_files(path)
    changes = spark.createDataFrame([("7", "new", None), ("9999", "nobody", 2)], "id string, pr_title string, status int")
    TB.update_touched(spark, path, S.ANALYSES, changes)
    after = parquet_files(path)
    gone = {os.path.basename(os.path.dirname(f)) for f in before if f not in after}
    folders = {f"bucket={b}" for b in TB.touched_buckets(changes)}
    assert gone and gone <= folders
    assert all(after[f] == before[f] for f in before if os.path.basename(os.path.dirname(f)) not in folders)
    rows = {r["id"]: r for r in TB.read_keyed(spark, path, S.ANALYSES).collect()}
    assert len(rows) == 300 and rows["7"]["pr_title"] == "new" and rows["7"]["status"] == 0 and rows["8"]["pr_title"] == "t"
    TB.update_touched(spark, path, S.ANALYSES, changes.limit(0))
    assert parquet_files(path) == after


def test_failed_update_leaves_the_old_rows(spark):
    path = f"{SJ.scratch(spark, 'test-keyed-fail')}/t"
    analyses(spark, 50, path)
    broken = F.udf(lambda v: 1 // 0, "string")
    changes = spark.createDataFrame([("7", "x")], "id string, pr_title string").withColumn("pr_title", broken("pr_title"))
    with pytest.raises(Exception, match="ZeroDivision|division"):
        TB.update_touched(spark, path, S.ANALYSES, changes)
    assert {r["pr_title"] for r in TB.read_keyed(spark, path, S.ANALYSES).collect()} == {"t"}


def test_reading_touched_folders_prunes_the_others(spark):
    path = f"{SJ.scratch(spark, 'test-keyed-prune')}/t"
    analyses(spark, 300, path)
    some = TB.read_keyed(spark, path, S.ANALYSES, [3])
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ = 3", plan)
    assert 0 < some.count() < 60


# --- K2: keyed state ----------------------------------------------------------------------
def test_a_batch_touches_its_own_jobs_only(spark):
    root = SJ.scratch(spark, "test-touch")
    deliver(events(spark, *[(f"j{i}", i, "enqueue") for i in range(40)]), root)
    LC.run_job_stream(spark, f"{root}/src", root)
    deliver(events(spark, *[(f"j{i}", 100 + i, "dequeue") for i in range(10)]), root)
    states = LC.run_job_stream(spark, f"{root}/src", root)
    assert {r["status"]: r["n"] for r in states.groupBy("status").agg(F.count("*").alias("n")).collect()} == {S.JOB_PENDING: 30, S.JOB_PROCESSING: 10}
    written = LC.effect_log(spark, root).groupBy("batch").count().collect() if "batch" in LC.effect_log(spark, root).columns else None
    assert written is None or sorted(r["count"] for r in written) == [10, 40]
    assert spark.read.parquet(f"{root}/effects/batch=1").count() == 10


def test_effective_events_equal_the_batch_operator(spark):
    kinds = ["enqueue", "dequeue", "dequeue", "fail", "complete", "enqueue", "complete", "dequeue", "complete", "fail", "enqueue", "other"]
    rows = [(f"j{j}", i * 7 + j, kinds[(i * (j + 2) + j) % len(kinds)]) for j in range(6) for i in range(30)]
    ev = events(spark, *rows)
    root = SJ.scratch(spark, "test-effects")
    got = SJ.feed(ev, f"{root}/src", "seq", 4, lambda: LC.run_job_stream(spark, f"{root}/src", root))
    known = ev.where(F.col("kind") != "other")
    cols = ["job_id", "status", "retry_count", "created_at", "failed_at", "next_attempt_at", "error_message"]
    assert sorted(got.select(cols).collect(), key=str) == sorted(Q.job_states(known).select(cols).collect(), key=str)
    cols = ["job_id", "seq", "ts", "kind", "analysis_status", "hub_event"]
    want = Q.effective_events(known).select(cols).collect()
    assert sorted(LC.status_events(LC.effect_log(spark, root)).select(cols).collect(), key=str) == sorted(want, key=str)


def test_events_without_a_job_time_or_known_kind_concern_no_job(spark):
    root = SJ.scratch(spark, "test-odd-events")
    odd = [(None, 1, T0, "enqueue", None), ("a", 2, None, "enqueue", None), ("b", 3, T0, "start", None), ("c", 4, T0, None, None), ("d", 5, T0, "dequeue", None), ("e", -9, T0, "enqueue", None)]
    deliver(spark.createDataFrame(odd, JOB), root)
    assert [(r["job_id"], r["status"]) for r in LC.run_job_stream(spark, f"{root}/src", root).collect()] == [("e", S.JOB_PENDING)]


def test_timers_report_due_retries_and_clear_old_jobs(spark):
    root = SJ.scratch(spark, "test-timers")
    run = lambda: {r["job_id"]: r["status"] for r in LC.run_job_stream(spark, f"{root}/src", root, retain_hours=24, retry_due=True).collect()}
    deliver(events(spark, ("old", 0, "enqueue", 0), ("old", 1, "dequeue", 0), ("old", 2, "complete", 0), ("try", 3, "enqueue", 0), ("try", 4, "dequeue", 1), ("try", 5, "fail", 1), ("wait", 6, "enqueue", 0)), root)
    assert run() == {"old": S.JOB_COMPLETED, "try": S.JOB_RETRYING, "wait": S.JOB_PENDING}
    deliver(events(spark, ("new", 9, "enqueue", 25.01)), root)
    assert run() == {"try": S.JOB_RETRYING, "wait": S.JOB_PENDING, "new": S.JOB_PENDING}
    due = LC.effect_log(spark, root).where(F.col("kind") == LC.RETRY_DUE).collect()
    assert [(r["job_id"], r["at"]) for r in due] == [("try", int(T0.timestamp() + 3600 + 5) * 1_000_000)] or [r["job_id"] for r in due] == ["try"]


# --- K5, S7 -------------------------------------------------------------------------------
def test_two_sinks_survive_a_crash_between_them(spark, monkeypatch):
    root = SJ.scratch(spark, "test-sinks")
    table = f"{root}/analyses"
    analyses(spark, 5, table)
    sink = LC.StatusSinks(spark, root, table, S.ANALYSES, F.col("job_id"))
    deliver(events(spark, ("1", 0, "enqueue"), ("1", 1, "dequeue"), ("1", 2, "complete"), ("2", 3, "enqueue"), ("2", 4, "dequeue"), ("2", 5, "fail"), ("9", 6, "enqueue"), ("9", 7, "dequeue")), root)
    whole = sink.write_hub

    def crash(*args):
        raise RuntimeError("between the sinks")

    monkeypatch.setattr(sink, "write_hub", crash)
    with pytest.raises(Exception, match="between the sinks"):
        LC.run_job_stream(spark, f"{root}/src", root, sink=sink)
    monkeypatch.setattr(sink, "write_hub", whole)
    LC.run_job_stream(spark, f"{root}/src", root, sink=sink)
    hub = sorted((r["event"], r["analysis_id"], r["seq"]) for r in LC.hub_log(spark, root).collect())
    assert hub == [("AnalysisCompleted", "1", 2), ("AnalysisUpdated", "1", 1), ("AnalysisUpdated", "2", 4)]
    status = {r["id"]: r["status"] for r in TB.read_keyed(spark, table, S.ANALYSES).collect()}
    assert status == {"0": 0, "1": S.ST_COMPLETED, "2": S.ST_FAILED, "3": 0, "4": 0}
    deliver(events(spark, ("2", 10, "enqueue")), root)  # a retry's enqueue leaves the analysis failed
    LC.run_job_stream(spark, f"{root}/src", root, sink=sink)
    assert TB.read_keyed(spark, table, S.ANALYSES).where("id = '2'").first()["status"] == S.ST_FAILED and LC.hub_log(spark, root).count() == 3


# --- K6 -----------------------------------------------------------------------------------
NEW = "analysis_id string, repo_name string, pr_number int, pr_title string, ts timestamp, seq long"


def counting(folder):
    def reviewer(prompts: pd.Series) -> pd.Series:
        with open(os.path.join(folder, f"{os.getpid()}-{len(os.listdir(folder))}-{id(prompts)}"), "w") as f:
            f.write("\x00".join(prompts))
        return prompts.map(lambda p: '{"suggestions": [{"priority": "high", "title": "x"}]}' if "JSON" in p else "fine")

    return reviewer


def asked(folder):
    return [p for f in os.listdir(folder) for p in open(os.path.join(folder, f)).read().split("\x00")]


def test_every_prompt_is_asked_once_and_outcomes_are_written_back(spark, tmp_path, monkeypatch):
    root, folder = SJ.scratch(spark, "test-enrich"), str(tmp_path)
    table = f"{root}/analyses"
    analyses(spark, 4, table)
    diffs = [("o/a", i, f"diff --git a/x.cs b/x.cs\n+var a = {i + 20};\n+f(1e400);", "not readable" if i == 2 else None) for i in range(6)]
    static = EN.store_diffs(spark.createDataFrame(diffs, "repo_name string, pr_number int, diff string, error string"), f"{root}/diffs")
    deliver(spark.createDataFrame([(str(i), "o/a", i, f"T{i}", T0, i) for i in range(6)] + [("1", "o/a", 1, "T1", T0, 9), (None, "o/a", 1, "T", T0, 10)], NEW), root)
    run = lambda: EN.run_enrich_stream(spark, f"{root}/src", root, static, counting(folder), analyses=table)
    real = EN.Enrichment.outcomes

    def crash(*args):
        raise RuntimeError("after the review")

    monkeypatch.setattr(EN.Enrichment, "outcomes", crash)
    with pytest.raises(Exception, match="after the review"):
        run()
    first = sorted(asked(folder))
    assert len(first) == 3 * len(EN.TASKS) == len(set(first)) + len(first) - len(set(first))  # analyses 0, 1 and 3, two tasks of one part
    monkeypatch.setattr(EN.Enrichment, "outcomes", real)
    out = {r["analysis_id"]: r for r in run().collect()}
    assert sorted(asked(folder)) == first  # the repeated batch asks nobody
    assert {k: (r["status"], r["error_message"]) for k, r in out.items()} == {
        "0": (2, None), "1": (2, None), "3": (2, None), "2": (3, "not readable"), "4": (3, Q.ORPHAN_MESSAGE), "5": (3, Q.ORPHAN_MESSAGE),
    }
    found = {r["analysis_id"]: r["finding_count"] for r in SC.finding_stats(R.analyze_diffs(spark.createDataFrame([(str(d[1]), d[2]) for d in diffs], "analysis_id string, diff string"))).collect()}
    rows = {r["id"]: r for r in TB.read_keyed(spark, table, S.ANALYSES).withColumn("n", F.json_array_length("findings_json")).withColumn("m", F.json_array_length("suggestions_json")).collect()}
    for k in ("0", "1", "3"):
        assert (rows[k]["status"], rows[k]["summary"], rows[k]["n"], rows[k]["m"]) == (S.ST_COMPLETED, "fine", found[k], 1)
        assert rows[k]["quality_score"] == out[k]["quality_score"] == int(out[k]["finding_score"] * 0.6 + 90 * 0.4) and rows[k]["processed_at"] == T0
    assert (rows["2"]["status"], rows["2"]["summary"], rows["2"]["findings_json"], rows["2"]["quality_score"]) == (S.ST_FAILED, "", "[]", 0)
    assert len(rows) == 4


# --- K1 with A7-A10 -----------------------------------------------------------------------
def hooks(spark, *rows):
    from revlens.sources.webhooks import encode_pr_event

    ev = spark.createDataFrame([(s, T0 + timedelta(seconds=s), a, repo, 1, f"t{s}", "u") for s, a, repo in rows], "seq long, ts timestamp, action string, repo_name string, pr_number int, pr_title string, pr_author string")
    raw = encode_pr_event(F.col("action"), F.col("repo_name"), F.col("pr_number"), F.col("pr_title"), F.col("pr_author"), F.col("ts"))
    return ev.select("seq", "ts", raw.alias("raw"))


def test_running_metrics_follow_every_batch_and_survive_crashes(spark, monkeypatch):
    root = SJ.scratch(spark, "test-k1-metrics")
    metrics = RunningMetrics(spark, root)
    assert tuple(metrics.current().first()) == (0,) * 8

    def batch(*rows):
        deliver(hooks(spark, *rows), root)
        return SJ.run_state_stream(spark, f"{root}/src", root)

    def same(state):
        assert metrics.current().collect() == SV.quality_metrics(state).collect()

    same(batch((0, "opened", "o/a"), (1, "opened", "o/b"), (2, "opened", "o/c")))
    step = SJ.StateStep(spark, root)
    scored = [("o/a", 1, 95, 0), ("o/b", 1, 75, 2), ("o/c", 1, 20, 1)]  # by another stream
    TB.update_touched(spark, step.table, S.ANALYSES, spark.createDataFrame(scored, "repo_name string, pr_number int, quality_score int, risk_level int"), ST.KEY)
    metrics.start(step.stored())
    metrics.change(step.stored().limit(0), step.stored().limit(0), 0)
    same(step.stored())
    same(batch((3, "closed", "o/b"), (4, "synchronize", "o/a"), (5, "opened", "o/d")))
    for where in ("replace_keys", "change"):
        real = getattr(TB, where) if where == "replace_keys" else SJ.RunningMetrics.change

        def crash(*args, **more):
            raise RuntimeError("crash")

        target = TB if where == "replace_keys" else SJ.RunningMetrics
        monkeypatch.setattr(target, where, crash)
        seq = 10 if where == "replace_keys" else 20
        with pytest.raises(Exception, match="crash"):
            batch((seq, "closed", "o/a"), (seq + 1, "opened", "o/a"), (seq + 2, "opened", f"o/{where}"))
        monkeypatch.setattr(target, where, real)
        same(SJ.run_state_stream(spark, f"{root}/src", root))
    want = ["o/a", "o/c", "o/change", "o/d", "o/replace_keys"]
    assert sorted(r["repo_name"] for r in step.stored().collect()) == want
    same(batch(*[(30 + i, "closed", r) for i, r in enumerate(want)]))
    assert step.stored().count() == 0


def test_a_batch_rewrites_the_folders_of_its_keys_only(spark):
    root = SJ.scratch(spark, "test-k1-folders")
    deliver(hooks(spark, *[(i, "opened", f"o/r{i}") for i in range(80)]), root)
    SJ.run_state_stream(spark, f"{root}/src", root)
    before = parquet_files(f"{root}/analyses")
    deliver(hooks(spark, (100, "closed", "o/r3")), root)
    assert SJ.run_state_stream(spark, f"{root}/src", root).count() == 79
    after = parquet_files(f"{root}/analyses")
    gone = {os.path.dirname(f) for f in before if f not in after}
    assert len(gone) == 1
