from datetime import datetime, timedelta

from pyspark.sql import functions as F

from revlens.operators import queue as Q
from revlens.operators import state as ST
from revlens.sources.webhooks import encode_pr_event
from revlens.streaming import jobs as SJ

T0 = datetime(2024, 1, 1)
JOB = "job_id string, seq long, ts timestamp, kind string, message string"


def test_state_stream_equals_batch_replay(spark):
    acts = ["opened", "synchronize", "closed", "reopened", "edited", "synchronize", "closed", "opened", "Opened"]
    rows = [(i, T0 + timedelta(seconds=i), acts[(i * 5) % len(acts)], f"o/r{i % 3}", i % 2 + 1, f"t{i}", "u") for i in range(60)]
    ev = spark.createDataFrame(
        rows, "seq long, ts timestamp, action string, repo_name string, pr_number int, pr_title string, pr_author string"
    )
    raw = ev.select("seq", "ts", encode_pr_event(F.col("action"), F.col("repo_name"), F.col("pr_number"), F.col("pr_title"), F.col("pr_author"), F.col("ts")).alias("raw"))
    # one payload without a pull_request key (PR 0) is dropped by K1
    raw = raw.unionByName(spark.createDataFrame([(60, T0, '{"action":"opened","repository":{"full_name":"o/r9"}}')], "seq long, ts timestamp, raw string"))
    root = SJ.scratch(spark, "test-k1")
    got = SJ.feed(raw, f"{root}/src", "seq", 3, lambda: SJ.run_state_stream(spark, f"{root}/src", root))
    want = ST.replay(ev)
    cols = ["id", "repo_name", "pr_number", "pr_title", "status", "created_at", "updated_at"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())


def test_job_stream_equals_batch_fold(spark):
    kinds = ["enqueue", "dequeue", "fail", "enqueue", "dequeue", "complete", "dequeue", "fail", "enqueue"]
    rows = []
    for j in range(4):
        for i, k in enumerate(kinds[j:] + kinds[:j]):
            seq = i * 4 + j
            rows.append((f"j{j}", seq, T0 + timedelta(seconds=seq), k, f"m{seq}" if k == "fail" else None))
    ev = spark.createDataFrame(rows, JOB)
    root = SJ.scratch(spark, "test-k2")
    got = SJ.feed(ev, f"{root}/src", "seq", 3, lambda: SJ.run_job_stream(spark, f"{root}/src", root))
    want = Q.job_states(ev)
    cols = ["job_id", "status", "retry_count", "created_at", "failed_at", "next_attempt_at", "error_message"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())


def test_state_stream_keeps_untouched_buckets(spark):
    # batch 1 touches only repo a, batch 2 only repo b, batch 3 updates repo a
    # again: if batch 2 had dropped a's bucket, batch 3 would create a new id.
    spec = [(0, "opened", "o/a"), (1, "synchronize", "o/a"), (10, "opened", "o/b"), (20, "synchronize", "o/a")]
    rows = [(s, T0 + timedelta(seconds=s), act, repo, 1, f"t{s}", "u") for s, act, repo in spec]
    ev = spark.createDataFrame(
        rows, "seq long, ts timestamp, action string, repo_name string, pr_number int, pr_title string, pr_author string"
    )
    raw = ev.select("seq", "ts", encode_pr_event(F.col("action"), F.col("repo_name"), F.col("pr_number"), F.col("pr_title"), F.col("pr_author"), F.col("ts")).alias("raw"))
    root = SJ.scratch(spark, "test-k1-buckets")
    for lo, hi in ((0, 5), (5, 15), (15, 30)):
        raw.filter(f"seq >= {lo} AND seq < {hi}").coalesce(1).write.mode("append").parquet(f"{root}/src")
    got = SJ.run_state_stream(spark, f"{root}/src", root)
    assert sorted((r["repo_name"], r["pr_title"]) for r in got.collect()) == [("o/a", "t20"), ("o/b", "t10")]
    want = ST.replay(ev)
    assert sorted(got.select("id").collect()) == sorted(want.select("id").collect())


def _raw(spark, events):
    ev = spark.createDataFrame(
        events, "seq long, ts timestamp, action string, repo_name string, pr_number int, pr_title string, pr_author string"
    )
    raw = encode_pr_event(F.col("action"), F.col("repo_name"), F.col("pr_number"), F.col("pr_title"), F.col("pr_author"), F.col("ts"))
    return ev.select("seq", "ts", raw.alias("raw"))


def test_state_stream_restart_with_other_parallelism_keeps_rows(spark):
    root = SJ.scratch(spark, "test-k1-restart")
    first = [(i, T0, "opened", f"o/r{i}", 1, f"t{i}", "u") for i in range(40)]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, rows in ((4, first), (6, [(40, T0, "synchronize", "o/r3", 1, "new", "u")]), (3, [(41, T0, "closed", "o/r5", 1, "", "u")])):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            _raw(spark, rows).repartition(partitions).write.mode("append").parquet(f"{root}/src")
            got = {r["repo_name"]: r["pr_title"] for r in SJ.run_state_stream(spark, f"{root}/src", root).collect()}
        again = SJ.run_state_stream(spark, f"{root}/src", root).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert got == {f"o/r{i}": f"t{i}" if i != 3 else "new" for i in range(40) if i != 5}
    assert again == 39


def test_state_stream_counts_what_it_leaves_out(spark):
    root = SJ.scratch(spark, "test-k1-counts")
    bad = [(7, T0, '{"action":"opened","repository":{"full_name":"o/r9"}}'), (8, T0, '{"action":"opened","pull_request":null}'), (9, T0, '{"act')]
    _raw(spark, [(1, T0, "opened", "o/a", 1, "t", "u")]).union(spark.createDataFrame(bad, "seq long, ts timestamp, raw string")).write.parquet(f"{root}/src")
    assert SJ.run_state_stream(spark, f"{root}/src", root).count() == 1
    (log,) = SJ.batch_log(spark, root).collect()
    assert (log["events"], log["malformed"], log["rejected"], log["without_target"]) == (4, 1, 1, 1)


def test_streams_without_files(spark):
    root = SJ.scratch(spark, "test-empty")
    spark.createDataFrame([], JOB).limit(0).write.parquet(f"{root}/src")
    assert SJ.run_job_stream(spark, f"{root}/src", root).count() == 0


def test_job_stream_takes_late_events_in_arrival_order(spark):
    at = lambda *kinds: [("j", s, T0 + timedelta(seconds=s), k, f"m{s}") for s, k in kinds]
    root = SJ.scratch(spark, "test-k2-late")
    for rows in (at((0, "enqueue"), (1, "dequeue"), (10, "complete")), at((5, "enqueue"))):
        spark.createDataFrame(rows, JOB).write.mode("append").parquet(f"{root}/src")
        got = SJ.run_job_stream(spark, f"{root}/src", root).first()
    assert got["status"] == 0 and got["created_at"] == T0 + timedelta(seconds=5)
    for rows, want in ((at((11, "dequeue")), (1, 0, None)), (at((12, "fail")), (4, 1, "m12")), (at((13, "enqueue"), (14, "dequeue"), (15, "fail")), (4, 2, "m15")), (at((16, "enqueue")), (0, 2, "m15")), (at((17, "dequeue"), (18, "fail")), (3, 3, "m18"))):
        spark.createDataFrame(rows, JOB).write.mode("append").parquet(f"{root}/src")
        got = SJ.run_job_stream(spark, f"{root}/src", root).first()
        assert (got["status"], got["retry_count"], got["error_message"]) == want


def test_job_stream_retention(spark):
    root = SJ.scratch(spark, "test-k4")
    day = timedelta(hours=25)
    for rows in ([("old", 0, T0, "enqueue", None), ("old", 1, T0, "dequeue", None), ("old", 2, T0, "complete", None), ("wait", 3, T0, "enqueue", None)], [("new", 9, T0 + day, "enqueue", None)]):
        spark.createDataFrame(rows, JOB).write.mode("append").parquet(f"{root}/src")
        got = SJ.run_job_stream(spark, f"{root}/src", root, retain_hours=24)
    assert sorted(r["job_id"] for r in got.collect()) == ["new", "wait"]


def test_enrich_stream_equals_batch(spark):
    import pandas as pd

    from revlens.operators import replies as RP
    from revlens.operators import rules as R
    from revlens.operators import scoring as SC

    diffs = spark.createDataFrame([("o/a", i, f"diff --git a/x.cs b/x.cs\n+var a = {i + 20};\n+f({i + 50}, 77);") for i in range(6)], "repo_name string, pr_number int, diff string")
    jobs = [(f"a{i}", "o/a", i, f"T{i}", T0, i) for i in range(8)]
    ev = spark.createDataFrame(jobs, "analysis_id string, repo_name string, pr_number int, pr_title string, ts timestamp, seq long")

    def reviewer(prompts: pd.Series) -> pd.Series:
        if prompts.str.contains("a = 23").any():
            raise RuntimeError("no answer")
        return prompts.map(lambda p: '{"suggestions": [{"priority": "high"}]}' if "JSON" in p else ("fine" if "a = 21" not in p else None))

    root = SJ.scratch(spark, "test-k6")
    static = SJ.store_diffs(diffs, f"{root}/diffs")
    got = {r["analysis_id"]: r for r in SJ.feed(ev, f"{root}/src", "seq", 3, lambda: SJ.run_enrich_stream(spark, f"{root}/src", root, static, reviewer)).collect()}
    found = R.analyze_diffs(diffs.select(F.concat(F.lit("a"), "pr_number").alias("analysis_id"), "diff"))
    batch = {r["analysis_id"]: r["finding_count"] for r in SC.finding_stats(found).collect()}
    assert {k: r["finding_count"] for k, r in got.items()} == {f"a{i}": batch.get(f"a{i}", 0) for i in range(8)}
    assert {r["status"] for r in got.values()} == {2} and got["a0"]["summary"] == "fine"
    assert got["a3"]["summary"] == f"PR Title: T3\nSummary: {RP.RF.SUMMARY_ERROR}" and got["a3"]["suggestion_score"] == 100
    assert got["a1"]["summary"] == RP.RF.SUMMARY_EMPTY and got["a0"]["suggestion_score"] == 90
    assert got["a0"]["quality_score"] == int(got["a0"]["finding_score"] * 0.6 + 90 * 0.4)


def test_enrich_stream_fails_what_the_rules_cannot_read(spark, monkeypatch):
    import json

    from test_diffs_rules import failing_positions

    from revlens import schemas as S
    from revlens.operators import rules as R
    from revlens.sources import tables as TB
    from revlens.streaming.metrics import RunningMetrics

    monkeypatch.setattr(R, "positions", failing_positions())
    head = "diff --git a/{0} b/{0}\n+".format
    texts = [head("a.cs") + "f(7); // unreadable\n" + head("b.cs") + "f(12);", head("a.cs") + "f(12);", head("a.cs") + "f(1e" + "9" * 19 + "m, 12);"]
    diffs = spark.createDataFrame([("o/a", i, t) for i, t in enumerate(texts)], "repo_name string, pr_number int, diff string")
    ev = spark.createDataFrame([(f"a{i}", "o/a", i, f"T{i}", T0, i) for i in range(3)], "analysis_id string, repo_name string, pr_number int, pr_title string, ts timestamp, seq long")
    root = SJ.scratch(spark, "test-k6-unread")
    static = SJ.store_diffs(diffs, f"{root}/diffs")
    table = f"{root}/analyses"
    made = ev.select(F.col("analysis_id").alias("id"), "repo_name", "pr_number", "pr_title", F.lit("").alias("pr_author"))
    TB.store_keyed(ST.new_analysis_defaults(made, F.lit(T0)), table)
    metrics = RunningMetrics(spark, root)
    metrics.start(TB.read_keyed(spark, table, S.ANALYSES))
    reviewer = lambda prompts: prompts.map(lambda p: '{"suggestions": [{"priority": "high"}]}' if "JSON" in p else "fine")
    run = lambda: SJ.run_enrich_stream(spark, f"{root}/src", root, static, reviewer, analyses=table, metrics=metrics)
    got = {r["analysis_id"]: r.asDict() for r in SJ.feed(ev, f"{root}/src", "seq", 1, run).collect()}
    unread = got["a0"]
    assert unread["status"] == 3 and unread["error_message"] == "a.cs: " + R.UNREAD_MESSAGE % "ValueError"
    assert {unread[c] for c in ("finding_count", "errors", "warnings", "finding_score", "risk_level", "quality_score", "processed_at")} == {None}
    assert (unread["suggestion_count"], unread["suggestion_score"], unread["summary"]) == (1, 90, "fine")
    assert [(f["FilePath"], f["RuleId"]) for f in json.loads(unread["findings_json"])] == [("a.cs", R.UNREAD_ID), ("b.cs", R.MAGIC_ID)]
    for k in ("a1", "a2"):
        assert (got[k]["status"], got[k]["error_message"], got[k]["finding_count"], got[k]["finding_score"]) == (2, None, 1, 99)
    stored = {r["id"]: r for r in TB.read_keyed(spark, table, S.ANALYSES).collect()}
    assert {k: (r["status"], r["quality_score"]) for k, r in stored.items()} == {"a0": (3, 0), "a1": (2, 95), "a2": (2, 95)}
    assert stored["a0"]["findings_json"] == unread["findings_json"] and stored["a0"]["summary"] == "fine"
    assert metrics.current().first()["high_quality"] == 2
