from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from revlens import schemas as S
from revlens.operators import queue as Q
from revlens.operators import state as ST
from revlens.operators.scan import running_max

T0 = datetime(2024, 1, 1)


def _jobs(spark, kinds, job="j"):
    rows = [(job, i, T0 + timedelta(seconds=i), k) for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, "job_id string, seq long, ts timestamp, kind string")


def _state(spark, kinds):
    r = Q.job_states(_jobs(spark, kinds)).collect()
    return r[0] if r else None


def test_job_fold(spark):
    assert _state(spark, ["enqueue", "dequeue", "complete"])["status"] == S.JOB_COMPLETED
    r = _state(spark, ["enqueue", "dequeue", "fail"])
    assert (r["status"], r["retry_count"]) == (S.JOB_RETRYING, 1)
    assert r["next_attempt_at"] == T0 + timedelta(seconds=7)
    r = _state(spark, ["enqueue", "dequeue", "fail"] * 3)
    assert (r["status"], r["retry_count"]) == (S.JOB_FAILED, 3)
    assert _state(spark, ["enqueue", "complete"])["status"] == S.JOB_PENDING
    assert _state(spark, ["complete", "dequeue"]) is None
    r = _state(spark, ["enqueue", "dequeue", "fail", "enqueue"])
    assert (r["status"], r["created_at"]) == (S.JOB_PENDING, T0 + timedelta(seconds=3))


def test_retention_and_health(spark):
    as_of = datetime(2024, 1, 2)
    rows = [
        ("old", S.JOB_COMPLETED, as_of - timedelta(hours=24, seconds=1)),
        ("edge", S.JOB_FAILED, as_of - timedelta(hours=24)),
        ("wait", S.JOB_PENDING, as_of - timedelta(days=3)),
    ]
    df = spark.createDataFrame(rows, "job_id string, status int, created_at timestamp")
    kept = sorted(r[0] for r in Q.retention(df, F.lit(as_of)).select("job_id").collect())
    assert kept == ["edge", "wait"]
    for n, healthy in ((49, True), (50, False)):
        ql = spark.createDataFrame([(n,)], "queue_length int")
        from revlens.operators import serving as SV

        assert SV.queue_status(ql).first()["is_healthy"] is healthy


def _events(spark, actions, repo="r", pr=1):
    rows = [(i, T0 + timedelta(seconds=i), a, repo, pr, f"t{i}", "u") for i, a in enumerate(actions)]
    return spark.createDataFrame(
        rows, "seq long, ts timestamp, action string, repo_name string, pr_number int, pr_title string, pr_author string"
    )


def test_replay(spark):
    r = ST.replay(_events(spark, ["opened"])).collect()
    assert len(r) == 1 and r[0]["status"] == 0 and r[0]["quality_score"] == 0 and r[0]["findings_json"] == "[]"
    r = ST.replay(_events(spark, ["opened", "synchronize"])).collect()
    assert len(r) == 1 and r[0]["pr_title"] == "t1" and r[0]["created_at"] == T0
    assert ST.replay(_events(spark, ["opened", "closed"])).count() == 0
    a = ST.replay(_events(spark, ["opened"])).first()["id"]
    b = ST.replay(_events(spark, ["opened", "closed", "reopened"])).first()["id"]
    assert a != b
    assert ST.replay(_events(spark, ["edited", "Opened"])).count() == 0
    rep = ST.closed_report(_events(spark, ["closed", "opened", "closed"])).orderBy("seq").collect()
    assert [x["outcome"] for x in rep] == ["no analysis found", "deleted"]


def test_batch_equals_incremental(spark):
    acts = ["opened", "synchronize", "closed", "reopened", "edited", "synchronize", "closed", "opened"]
    rows = []
    for i in range(64):
        rows.append((i, T0 + timedelta(seconds=i), acts[(i * 7) % len(acts)], f"r{i % 3}", i % 2 + 1, f"t{i}", "u"))
    ev = spark.createDataFrame(
        rows, "seq long, ts timestamp, action string, repo_name string, pr_number int, pr_title string, pr_author string"
    )
    full = ST.replay(ev)
    state = ST.replay(ev.filter("seq < 10"))
    for lo, hi in ((10, 30), (30, 31), (31, 64)):
        state = ST.apply_batch(state, ev.filter(f"seq >= {lo} AND seq < {hi}"))
        state = spark.createDataFrame(state.collect(), state.schema)
    cols = ["id", "repo_name", "pr_number", "pr_title", "created_at", "updated_at"]
    assert sorted(full.select(cols).collect()) == sorted(state.select(cols).collect())


def test_running_max_matches_window_on_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", i, i if i % 4 == 0 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    got = running_max(df, ["k"], "seq", {"m": F.col("v")}, span=7).select("seq", "m")
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("seq", F.max("v").over(w).alias("m"))
    assert sorted(got.collect()) == sorted(want.collect())
    got = running_max(df, ["k"], "seq", {"m": F.coalesce("v", F.lit(1))}, span=5, inclusive=False, how="sum")
    w2 = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("seq", F.sum(F.coalesce("v", F.lit(1))).over(w2).alias("m"))
    assert sorted(got.select("seq", "m").collect()) == sorted(want.collect())


def test_pack_and_read_round_trip(spark):
    from revlens.functions import jsonio as J

    f = spark.createDataFrame(
        [("a", "f1", "CV0002", "t", "m", 0, "x.cs", 3, 1, "", "CodeQuality", None, None)],
        "analysis_id string, id string, rule_id string, title string, message string, severity int, file_path string,"
        " line_number int, column_number int, code_snippet string, category string, description string, suggested_fix string",
    )
    packed = J.pack_findings(f).first()["findings_json"]
    assert packed.startswith('[{"Id":"f1","RuleId":"CV0002"') and '"SuggestedFix":null' in packed
    df = spark.createDataFrame([(packed,), ("not json",), ("",)], "j string")
    got = [r[0] for r in df.select(F.size(J.read_findings("j"))).collect()]
    assert got == [1, 0, 0]


def test_retry_leaves_the_analysis_failed(spark):
    ev = _jobs(spark, ["enqueue", "dequeue", "fail", "enqueue"])
    eff = Q.effective_events(ev).withColumn("analysis_id", F.lit("a"))
    assert [(r["kind"], r["analysis_status"]) for r in eff.orderBy("seq").collect()] == [("enqueue", S.ST_PENDING), ("dequeue", S.ST_IN_PROGRESS), ("fail", S.ST_FAILED), ("enqueue", None)]
    a = spark.createDataFrame([("a", 0, T0), ("b", 0, T0)], "id string, status int, updated_at timestamp")
    got = {r["id"]: (r["status"], r["updated_at"]) for r in Q.apply_status_events(a, eff).collect()}
    assert got == {"a": (S.ST_FAILED, T0 + timedelta(seconds=2)), "b": (0, T0)}


def test_orphans_fail_one_attempt(spark):
    rows = [("p", S.JOB_PENDING, 0, "x"), ("r", S.JOB_PROCESSING, 0, "x"), ("f", S.JOB_PROCESSING, 2, "x"), ("c", S.JOB_COMPLETED, 1, "x"), ("k", S.JOB_PROCESSING, 0, "a")]
    jobs = spark.createDataFrame(rows, "job_id string, status int, retry_count int, analysis_id string").withColumn("error_message", F.lit(None).cast("string"))
    known = spark.createDataFrame([("a",)], "id string")
    got = {r["job_id"]: (r["status"], r["retry_count"], r["error_message"]) for r in Q.attach_analysis(jobs, known).collect()}
    assert got == {
        "p": (S.JOB_PENDING, 0, None), "r": (S.JOB_RETRYING, 1, Q.ORPHAN_MESSAGE), "f": (S.JOB_FAILED, 3, Q.ORPHAN_MESSAGE),
        "c": (S.JOB_COMPLETED, 1, None), "k": (S.JOB_PROCESSING, 0, None),
    }


def test_no_hub_events_for_orphans(spark):
    from revlens.operators.notifications import notification_log

    hooks = _events(spark, ["opened", "closed", "closed"])
    jobs = Q.effective_events(_jobs(spark, ["enqueue", "dequeue", "complete"])).withColumn("analysis_id", F.lit("gone"))
    got = notification_log(hooks, jobs, spark.createDataFrame([("a",)], "id string")).collect()
    assert sorted((r["event"], r["seq"], r["title"]) for r in got) == [("NewPullRequest", 0, "t0"), ("PullRequestClosed", 1, "t1")]


def test_notifications_are_rows(spark):
    a = spark.createDataFrame([("1",), ("2",)], "id string")
    n = spark.createDataFrame([("x", "1", "m", 0, True, T0), ("y", "1", "m", 1, False, T0)], "id string, analysis_id string, message string, type int, is_read boolean, created_at timestamp")
    got = sorted((r["id"], r["notification_id"] or "") for r in ST.with_notifications(a, n).collect())
    assert got == [("1", "x"), ("1", "y"), ("2", "")]


def test_stored_json_names_in_any_case(spark):
    from revlens.functions import jsonio as J

    texts = ['[{"id":"a","SEVERITY":2,"lineNumber":3},null]', "[{'Id':'a'}]", '[{"Id":"x","id":"y"}]', '[{"Id":"cut', None, "{}", "[]"]
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    got = [[(f["Id"], f["Severity"], f["LineNumber"]) for f in r[0]] for r in df.select(J.read_findings("j")).collect()]
    assert got == [[("a", 2, 3)], [], [("y", None, None)], [], [], [], []]
    tags = spark.createDataFrame([('[{"tags":["a"," "],"Priority":1}]',)], "j string").select(J.read_suggestions("j")[0]).first()[0]
    assert tags["Tags"] == ["a", " "] and tags["Priority"] == 1


def test_stored_json_of_wrong_form_gives_nothing(spark):
    from revlens.functions import jsonio as J

    none = ['[{"Id":"a"} ] ]', '[{"Id":"a"}] x', '[{"Severity":"Error"}]', '[{"LineNumber":"7"}]', '[{"LineNumber":7.0}]', '[{"LineNumber":99999999999}]', '[{"Id":5}]', '[{"Id":{"x":1}}]',
            '{"Id":"a"}', "[1]", '[[{"Id":"a"}]]', '[{"Id":"a"},]', "[NaN]", "null", '[{"Id":"a"}],"c":2', '[{"Id":"a"}],0],[1', "["]
    some = {'[{"Message":"say \\"id\\": 5, \\"Id\\" : x","severity":2}]': [(None, 'say "id": 5, "Id" : x', 2)], '[{"id":"a","ID":"c","Other":5}]': [("c", None, None)], " [ ] ": []}
    df = spark.createDataFrame([(t,) for t in [*none, *some]], "j string")
    got = {r["j"]: [(f["Id"], f["Message"], f["Severity"]) for f in r[1]] for r in df.select("j", J.read_findings("j")).collect()}
    assert got == {**dict.fromkeys(none, []), **some}


def test_closed_report_knows_stored_analyses(spark):
    ev = _events(spark, ["closed", "opened", "closed", "closed"])
    key = ev.first()
    prior = spark.createDataFrame([("stored", key["repo_name"], key["pr_number"])], "id string, repo_name string, pr_number int")
    got = sorted((r["seq"], r["outcome"], r["analysis_id"]) for r in ST.closed_report(ev, prior=prior).collect())
    assert [g[:2] for g in got] == [(0, ST.DELETED), (2, ST.DELETED), (3, ST.NOT_FOUND)] and got[0][2] == "stored" and got[1][2] not in (None, "stored")
    assert [r["outcome"] for r in ST.closed_report(ev, prior=prior.limit(0)).orderBy("seq").collect()] == [ST.NOT_FOUND, ST.DELETED, ST.NOT_FOUND]
