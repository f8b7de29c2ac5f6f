"""Plan properties of the registered queries (planning only, no execution)."""

import __spark_entry__ as E

SMALL = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_no_cross_products(spark):
    for name, fn in E.queries().items():
        if name.startswith(("stream_", "op", "pipeline")):
            continue  # these run jobs when called; the streams are compared with their batch twins
        plan = _plan(fn(spark, SMALL))
        for op in FORBIDDEN:
            assert op not in plan, f"{name} plans a {op}"


def test_scoring_scan_is_pruned(spark):
    plan = _plan(E.queries()["analysis_scores"](spark, SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_diff_work_needs_no_exchange(spark):
    for name in ("diff_files", "added_lines", "async_void", "magic_numbers", "long_methods"):
        assert "Exchange" not in E.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString(), name


def test_diff_findings_exchanges(spark):
    plan = E.queries()["diff_findings"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4 and "Window" not in plan


def test_lookup_pushes_its_key(spark):
    for name, column in (("get_by_id", "o_orderkey"), ("first_match", "o_orderkey")):
        plan = E.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION" not in plan, name
    assert "EqualTo(o_orderkey," in E.queries()["get_by_id"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def _scans(spark, name, table):
    plan = E.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    return plan.count(f"{table}.parquet") or plan.count("Relation [" + {"lineitem": "l_orderkey", "orders": "o_orderkey", "events": "event_id"}[table])


def test_sources_are_read_once_per_use(spark):
    for name in ("count_rows", "analysis_scores", "finding_counts"):
        assert _scans(spark, name, "lineitem") == 2 and _scans(spark, name, "orders") == 1, name
    assert _scans(spark, "upsert_state", "events") <= 8 and _scans(spark, "closed_report", "events") <= 2


def test_stream_steps_have_no_cross_products(spark):
    from revlens import schemas as S
    from revlens.operators import queue as Q
    from revlens.operators import state as ST
    from revlens.plans import proxies as P

    JOB_STATE = "job_id string, status int, retry_count int, created_at timestamp, failed_at timestamp, next_attempt_at timestamp, error_message string"  # noqa: N806
    jobs = Q.job_states(P.job_events(spark, SMALL), spark.createDataFrame([], JOB_STATE))
    state = ST.apply_batch(spark.createDataFrame([], S.ANALYSES), P.webhook_rows(spark, SMALL))
    for df in (jobs, state):
        assert not any(op in _plan(df) for op in FORBIDDEN)
