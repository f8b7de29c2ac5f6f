from pyspark.sql import functions as F

from revlens.functions import replies as RF
from revlens.operators import replies as RP


def test_priority_type_impact(spark):
    rows = [("CRITICAL", "Best_Practice", "7"), ("urgent", "other", "0"), (None, "", "11")]
    df = spark.createDataFrame(rows, "p string, t string, i string")
    got = df.select(
        RF.parse_priority("p").alias("p"), RF.parse_type("t", 1).alias("t"), RF.parse_impact("i").alias("i")
    ).collect()
    assert [tuple(r) for r in got] == [(3, 5, 7), (1, 1, 1), (1, 1, 10)]
    imp = ["-3", "7.5", "", None, "99999999999", " 7 ", "+7"]
    df = spark.createDataFrame([(x,) for x in imp], "i string")
    assert [r[0] for r in df.select(RF.parse_impact("i")).collect()] == [1, 5, 5, 5, 5, 7, 7]


def _parse(spark, replies):
    df = spark.createDataFrame(list(enumerate(replies)), "k long, reply string")
    out = RP.parse_replies(df, "k", "reply", default_type=0, file_label="mixed").collect()
    by = {}
    for r in out:
        by.setdefault(r["k"], []).append(r)
    return by


def test_reply_fallbacks(spark):
    long_text = "x" * 600
    replies = [
        "",
        "looks fine",
        "text } then {",
        'Sure: {"suggestions":[{"title":"x"}]} bye',
        '{"SUGGESTIONS":[]}',
        "{}",
        '{"suggestions":null}',
        "{bad}",
        '{"a":1} x {"b":2}',
        long_text,
        '{"suggestions":[{"impactScore":7,"priority":"high","tags":["a"]}]}',
    ]
    by = _parse(spark, replies)
    assert 0 not in by and 4 not in by and 5 not in by and 6 not in by
    r = by[1][0]
    assert (r["priority"], r["impact_score"], r["tags"], r["title"]) == (1, 5, ["gpt-analysis"], "GPT Analysis")
    assert by[2][0]["title"] == "GPT Analysis"
    r = by[3][0]
    assert (r["title"], r["description"], r["category"], r["priority"], r["impact_score"]) == (
        "x", "No description", "code_quality", 1, 5,
    )
    for k in (7, 8):
        r = by[k][0]
        assert (r["priority"], r["impact_score"], r["tags"]) == (0, 3, ["gpt-analysis", "parse-error"])
    assert by[9][0]["description"] == long_text
    r = by[10][0]
    assert (r["impact_score"], r["priority"], r["tags"]) == (7, 2, ["a"])


def test_extract_json(spark):
    df = spark.createDataFrame([("a {x} b {y} c",), ("} {",), ("none",)], "t string")
    got = [r[0] for r in df.select(RF.extract_json("t")).collect()]
    assert got == ["{x} b {y}", None, None]


def test_summary_fallbacks(spark):
    df = spark.createDataFrame([("T", None)], "t string, r string")
    r = df.select(
        RF.summary_text(F.col("r"), F.col("t"), configured=False).alias("a"),
        RF.summary_text(F.col("r"), F.col("t"), failed=F.lit(True)).alias("b"),
        RF.summary_text(F.col("r"), F.col("t")).alias("c"),
    ).first()
    assert r["a"] == "PR Title: T\nSummary: OpenAI integration is not configured."
    assert r["b"] == "PR Title: T\nSummary: An error occurred during automated analysis."
    assert r["c"] == "Summary could not be generated."


def test_fallback_limit_is_a_parameter(spark):
    df = spark.createDataFrame([(1, "y" * 600)], "reply_id int, reply string")
    assert len(RP.parse_replies(df, "reply_id", fallback_limit=RF.FALLBACK_LIMIT).first()["description"]) == 500


def test_prompt_parts_cover_the_text(spark):
    texts = ["", None, "a" * 7, "b" * 8, "".join(chr(0x1F600 + i % 50) for i in range(25))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", F.inline(RF.prompts("t", lambda p: F.concat(F.lit(">"), p), 8))).collect()
    for i, t in enumerate(texts):
        parts = sorted((r["part"], r["parts"], r["prompt"][1:]) for r in got if r["i"] == i)
        assert "".join(p for _, _, p in parts) == (t or "") and [n for n, _, _ in parts] == list(range(1, parts[0][1] + 1))
    cut = df.select("i", F.inline(RF.prompts("t", RF.issues_prompt, 8, first_only=True))).collect()
    assert [r["truncated"] for r in sorted(cut)] == [False, False, False, False, True]


def test_reviewer_failures_stay_alone(spark):
    import pandas as pd

    def reviewer(prompts: pd.Series) -> pd.Series:
        if prompts.str.contains("bad").any():
            raise RuntimeError("no answer")
        return prompts.str.upper()

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", "b", "bad2"])], "i int, prompt string").coalesce(1)
    got = {r["i"]: (r["reply"], r["failed"]) for r in RP.respond(df, reviewer).collect()}
    assert got == {0: ("A", False), 1: (None, True), 2: ("B", False), 3: (None, True)}


def test_review_fallbacks(spark):
    a = spark.createDataFrame([(str(i), f"T{i}") for i in range(4)], "id string, pr_title string")
    r = spark.createDataFrame([("0", "ok", False), ("1", None, False), ("2", None, True), ("0", "again", False)], "id string, reply string, failed boolean")
    got = sorted((x["id"], x["summary"]) for x in RP.with_review(a, r).collect())
    assert got == [("0", "again"), ("0", "ok"), ("1", RF.SUMMARY_EMPTY), ("2", f"PR Title: T2\nSummary: {RF.SUMMARY_ERROR}"), ("3", f"PR Title: T3\nSummary: {RF.SUMMARY_UNCONFIGURED}")]
