from datetime import datetime, timedelta

from pyspark.sql import functions as F

from revlens.functions import html as H
from revlens.functions import labels as L


def _one(spark, col, value):
    return spark.createDataFrame([(value,)], "t string").select(col(F.col("t"))).first()[0]


def test_numbered_to_html(spark):
    f = H.numbered_to_html
    assert _one(spark, f, "1. A: b") == "<ol><li><strong>A</strong><br/>b</li></ol>"
    assert _one(spark, f, "2) c") == "<ol><li>c</li></ol>"
    assert _one(spark, f, "1. : x") == "<ol><li>: x</li></ol>"
    assert _one(spark, f, "1. " + "a" * 120 + ": x") == "<ol><li>" + "a" * 120 + ": x</li></ol>"
    assert _one(spark, f, "1. a\n\n2. b") == "<ol><li>a</li></ol><ol><li>b</li></ol>"
    assert _one(spark, f, "x <ul> y") == "x <ul> y"
    assert _one(spark, f, "1. <b>x</b>\n<b>p</b>") == "<ol><li>&lt;b&gt;x&lt;/b&gt;</li></ol><p><b>p</b></p>"
    assert _one(spark, f, "1. café") == "<ol><li>caf&#233;</li></ol>"
    assert _one(spark, f, "1. ok 😀") == "<ol><li>ok &#128512;</li></ol>"
    assert _one(spark, f, "   ") == ""


def test_sanitize(spark):
    f = H.sanitize_html
    assert _one(spark, f, "a<script>x</p></script>b") == "ab"
    assert _one(spark, f, '<p class="a" onclick="x">t</p>') == "<p>t</p>"
    assert _one(spark, f, "<iframe src=1>y</iframe>") == "y"
    assert _one(spark, f, "<H2 id=z>") == "<H2>"
    assert _one(spark, f, "<body><b>k</b><br/></body>") == "<b>k</b><br/>"
    prose = "<p>The only = sign stays; once = 3 and one=two</p>"
    assert _one(spark, f, prose) == prose
    assert _one(spark, f, "<b/style=color:red>x</b>") == "<b>x</b>"
    assert _one(spark, f, '<a title="x>y" href=javascript:z>t</a>') == "t"
    assert _one(spark, f, "a < b <i>c</i> <!-- <b>d</b> --> <img src=x onerror=e") == "a &lt; b <i>c</i>  &lt;img src=x onerror=e"
    assert _one(spark, f, "x<SCRIPT src='>'>alert('</p>')</Script >y<script>open") == "xy"
    assert _one(spark, f, "<pre\nclass=a>k</pre><br /><blockquote>q</blockquote><!DOCTYPE html>") == "<pre>k</pre><br/>q"
    long = "<p " + "a=1 " * 20_000 + ">" + "word " * 20_000 + "</p>"
    assert _one(spark, f, long) == "<p>" + "word " * 20_000 + "</p>"
    s = "<div><p onclick='x'>t</p><style>a</style></div>"
    once = _one(spark, f, s)
    assert _one(spark, f, once) == once


def test_labels(spark):
    df = spark.createDataFrame([(s,) for s in (80, 79, 60, 59, 40, 39)], "s int")
    assert [r[0] for r in df.select(L.quality_band("s")).collect()] == ["excellent", "good", "good", "fair", "fair", "poor"]
    t = spark.createDataFrame([("a" * 60,), ("a" * 61,), ("",)], "t string")
    assert [r[0] for r in t.select(L.display_title("t")).collect()] == ["a" * 60, "a" * 60 + "...", "Untitled Pull Request"]
    now = datetime(2024, 1, 10)
    ages = [timedelta(days=7), timedelta(days=6, hours=23), timedelta(hours=23, minutes=59), timedelta(minutes=59), timedelta(seconds=59)]
    df = spark.createDataFrame([(now - a, now) for a in ages], "ts timestamp, now timestamp")
    got = [r[0] for r in df.select(L.relative_age(F.col("ts"), F.col("now"))).collect()]
    assert got == ["1 week(s) ago", "6 day(s) ago", "23 hour(s) ago", "59 minute(s) ago", "Just now"]
    q = spark.createDataFrame([(0,), (1,), (5,)], "n int")
    assert [r[0] for r in q.select(L.queue_caption("n")).collect()] == ["Queue is empty", "1 analysis waiting", "5 analyses waiting"]
