from pyspark.sql import functions as F

from revlens.operators import scoring as SC
from revlens.operators import serving as SV


def _risk(spark, e, w):
    df = spark.createDataFrame([(e, w)], "e int, w int")
    return df.select(SC.risk_level(F.col("e"), F.col("w")).alias("r")).first()["r"]


def test_risk_boundaries(spark):
    cases = {(5, 0): 2, (4, 10): 2, (1, 10): 2, (4, 9): 1, (1, 0): 1, (0, 15): 1, (0, 14): 0, (0, 5): 0, (0, 0): 0}
    for (e, w), want in cases.items():
        assert _risk(spark, e, w) == want, (e, w)


def _scores(spark, findings, suggestions):
    a = spark.createDataFrame([("a",)], "id string")
    f = spark.createDataFrame([("a", s) for s in findings], "analysis_id string, severity int")
    s = spark.createDataFrame([("a", p) for p in suggestions], "analysis_id string, priority int")
    return SC.score_analyses(a, f, s).first()


def test_finding_and_suggestion_scores(spark):
    r = _scores(spark, [2] * 3 + [1] * 2 + [0] * 4, [3, 3, 2, 1, 0])
    assert r["finding_score"] == 56
    assert r["suggestion_score"] == 53
    assert r["quality_score"] == 54
    assert _scores(spark, [], [])["quality_score"] == 100
    assert _scores(spark, [2] * 10, [])["finding_score"] == 0
    assert _scores(spark, [2] * 11, [])["finding_score"] == 0
    assert _scores(spark, [], [3] * 7)["suggestion_score"] == 0


def test_quality_score_is_double_truncation(spark):
    df = spark.createDataFrame([(6, 1), (0, 0), (100, 100)], "r int, g int")
    got = [x["q"] for x in df.select(SC.quality_score(F.col("r"), F.col("g")).alias("q")).collect()]
    assert got == [3, 0, 100]


def test_metrics_half_even_and_empty(spark):
    df = spark.createDataFrame([(90, 0), (89, 0), (70, 1), (69, 2)], "quality_score int, risk_level int")
    m = SV.quality_metrics(df).first()
    assert (m["high_quality"], m["medium_quality"], m["low_quality"], m["average_score"]) == (1, 2, 1, 80)
    assert (m["low_risk"], m["medium_risk"], m["high_risk"]) == (2, 1, 1)
    two = spark.createDataFrame([(2, 0), (3, 0)], "quality_score int, risk_level int")
    assert SV.quality_metrics(two).first()["average_score"] == 2
    empty = spark.createDataFrame([], "quality_score int, risk_level int")
    assert list(SV.quality_metrics(empty).first()) == [0] * 8


def test_scores_stay_in_range_and_fall(spark):
    prev = 101
    for n in range(0, 25, 3):
        q = _scores(spark, [1] * n, [])["quality_score"]
        assert 0 <= q <= 100 and q <= prev
        prev = q
