"""Work that must not grow faster than the input: few texts at a time in Python,
stored JSON read once, no frame per job in the job stream."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from revlens import schemas as S
from revlens.functions import jsonio as J
from revlens.operators import replies as RP
from revlens.operators import rules as R
from revlens.streaming import enrich as EN
from revlens.streaming import jobs as SJ
from revlens.streaming import lifecycle as LC


def test_reviewer_gets_few_prompts_at_a_time(spark):
    count = lambda prompts: pd.Series([str(len(prompts))] * len(prompts), prompts.index)
    df = spark.range(0, 950, 1, 1).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    got = RP.respond(df, count).collect()
    assert sorted((r["id"], r["prompt"]) for r in got) == sorted((i, f"p{i}") for i in range(950))
    assert max(int(r["reply"]) for r in got) <= RP.ASKED_AT_ONCE and not any(r["failed"] for r in got)


def test_prompts_need_not_come_back_with_the_replies(spark):
    df = spark.createDataFrame([(1, "p1", "t"), (2, None, None)], "id int, prompt string, title string")
    got = RP.respond(df, lambda p: p.fillna("none").str.upper(), keep_prompt=False)
    assert got.columns == ["id", "title", "reply", "failed"]
    assert sorted(map(tuple, got.collect())) == [(1, "t", "P1", False), (2, None, "NONE", False)]


def test_rules_scan_each_text_once(spark, tmp_path):
    rows = [("a", 0, "x.cs", "f(7);\n"), ("b", 0, "y.cs", None), ("c", 0, "z.cs", "int x;\n")]
    spark.createDataFrame(rows, "analysis_id string, file_idx int, file_path string, content string").write.parquet(f"{tmp_path}/files")
    found = R.run_rules(spark.read.parquet(f"{tmp_path}/files"))
    assert found._jdf.queryExecution().executedPlan().toString().count("BatchEvalPython") == 1
    assert [(r["analysis_id"], r["line_number"], r["column_number"]) for r in found.collect()] == [("a", 1, 3)]


def test_a_batch_reads_the_diffs_between_its_numbers(spark):
    root = SJ.scratch(spark, "test-span")
    rows = [("o/a", i, f"d{i}", "bad" if i == 21 else None) for i in range(40)] + [("o/a", 20, "again", None), (None, 20, "no key", None), ("o/a", None, "no key", None)]
    static = EN.store_diffs(spark.createDataFrame(rows, "repo_name string, pr_number int, diff string, error string"), f"{root}/diffs")
    step = EN.Enrichment(spark, root, static, None)
    t0 = datetime(2024, 1, 1)
    jobs = [("a", "o/a", 20, "T", t0), ("b", "o/a", 21, "T", t0), ("c", "o/b", 20, "T", t0), ("d", "o/a", None, "T", t0), ("e", None, 20, "T", t0)]
    work = step.work(spark.createDataFrame(jobs, EN.NEW_JOBS))
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(work._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(pr_number,20)" in plan and "LessThanOrEqual(pr_number,21)" in plan
    got = sorted((r["analysis_id"], r["diff"], r["diff_missing"], r["failure"]) for r in work.collect())
    assert [g[:3] for g in got] == [("a", "again", False), ("a", "d20", False), ("b", "d21", False), ("c", "", True), ("d", "", True), ("e", "", True)]
    assert [g[3] for g in got] == [None, None, "bad", None, None, None]
    only_null = step.work(spark.createDataFrame(jobs[3:4], EN.NEW_JOBS)).collect()
    assert [(r["analysis_id"], r["diff_missing"]) for r in only_null] == [("d", True)]


def test_texts_go_to_python_a_few_rows_at_a_time(spark):
    files = spark.createDataFrame([("a", 0, "x.cs", "f(7);\n"), ("b", 0, "y.cs", None)], "analysis_id string, file_idx int, file_path string, content string")
    found = R.magic_numbers(files, limit=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert [(r["analysis_id"], r["line_number"], r["column_number"]) for r in found.collect()] == [("a", 1, 3)]
    replies = spark.createDataFrame([("a", '{"suggestions": [{"title": "t"}]}')], "k string, reply string")
    parsed = RP.parse_replies(replies, "k")
    assert "ArrowEvalPython" not in parsed._jdf.queryExecution().executedPlan().toString()
    assert [r["title"] for r in parsed.collect()] == ["t"]


def test_detail_lists_are_read_once(spark, tmp_path):
    from revlens.plans import catalog

    at = datetime(2024, 1, 1)
    tables = {
        "orders": ([(1, 1, "F", 1.0, at, "1-URGENT"), (2, 1, "O", 1.0, at, "5-LOW")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "customer": ([(1, "c")], "c_custkey long, c_name string"),
        "lineitem": (
            [(1, 10 + n, 5, n, 3.0 + n, "R", "O") for n in (1, 2)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, l_returnflag string, l_linestatus string",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for query, want in (("detail_findings", ["1-1-11-5", "1-2-12-5"]), ("detail_suggestions", ["1-1-11", "1-2-12"])):
        out = catalog.QUERIES[query](spark, str(tmp_path))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if "Filter" in x and "from_json" in x]
        assert sorted(r["id"] for r in out.collect()) == want


def test_own_texts_are_read_as_others_are(spark):
    item = {k: None for k, _ in J.FINDING_KEYS} | {"Id": 'a "id": b', "Title": "é\\\n", "Severity": 1}
    import json

    own = json.dumps([item], separators=(",", ":"), ensure_ascii=False)
    spaced, lower = json.dumps([item]), own.replace('"Severity"', '"severity"')
    texts = [own, spaced, lower, "[]", "[null]", own + "x", own.replace(":1", ':"x"'), None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, js string")
    got = {r["i"]: [(f["Id"], f["Title"], f["Severity"]) for f in r["f"]] for r in df.select("i", J.read_findings("js").alias("f")).collect()}
    one = [(item["Id"], item["Title"], 1)]
    assert got == {0: one, 1: one, 2: one, 3: [], 4: [], 5: [], 6: [], 7: []}
    plan = df.select(J.read_findings("js").alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json(ArrayType" in plan  # our own texts are read as they stand


class _Job:
    def __init__(self, value=None):
        self.value = value

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def _fold(old, events):
    step = LC.JobLifecycle()
    step.job, step.handle = _Job(old), None
    out = step.handleInputRows(("j",), iter([Row(seq=s, at=at, code=c, message=m) for s, at, c, m in events]), None)
    return [(r.seq, r.kind, r.first) for r in out], step.job.value


def test_job_stream_folds_plain_rows():
    E, D, C, X = LC.ENQUEUE, LC.DEQUEUE, LC.COMPLETE, LC.FAIL
    assert _fold(None, [(1, 10, D, None), (2, 20, X, "m")]) == ([], None)
    got, value = _fold(None, [(None, 50, X, "late"), (3, 30, D, None), (2, 20, E, None), (1, 10, X, "no")])
    assert got == [(2, "enqueue", True), (3, "dequeue", False), (None, "fail", False)]
    assert value == (S.JOB_RETRYING, 1, 20, 50, "late")
    got, value = _fold(value, [(4, 60, E, None), (5, 70, E, None), (6, 80, D, None), (7, 90, D, None), (8, 95, C, None), (9, 99, X, "x")])
    assert got == [(4, "enqueue", False), (5, "enqueue", False), (6, "dequeue", False), (8, "complete", False)]
    assert value == (S.JOB_COMPLETED, 1, 70, None, "late")
    assert _fold((S.JOB_PROCESSING, 2, 5, None, None), [(1, 6, X, None)])[1] == (S.JOB_FAILED, 3, 5, 6, None)


def test_job_stream_keeps_every_job(spark):
    from revlens.streaming import jobs as SJ

    t0 = datetime(2024, 1, 1)
    rows = [(f"j{i % 40}", i, t0 + timedelta(seconds=i), LC.KINDS[i // 40 % 4], f"m{i}") for i in range(400)]
    root = SJ.scratch(spark, "test-many-jobs")
    out = SJ.feed(spark.createDataFrame(rows, LC.JOB_EVENT_SCHEMA), f"{root}/src", "seq", 2, lambda: SJ.run_job_stream(spark, f"{root}/src", root))
    assert out.count() == 40
