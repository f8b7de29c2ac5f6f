"""Property checks (hypothesis) on small random inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from revlens.functions import html as H
from revlens.operators.scan import running_max

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(
    keys=st.lists(st.sampled_from(["hot", "hot", "hot", "a", "b"]), min_size=1, max_size=40),
    span=st.integers(min_value=1, max_value=9),
    inclusive=st.booleans(),
)
def test_scan_equals_window(spark, keys, span, inclusive):
    rows = [(k, i * 3 + 1, (i * 7) % 11 if i % 3 else None) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    got = running_max(df, ["k"], "seq", {"m": F.col("v"), "s": F.col("v")}, inclusive=inclusive, span=span,
                      how={"m": "max", "s": "sum"}).select("seq", "m", "s")
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = df.select("seq", F.max("v").over(w).alias("m"), F.sum("v").over(w).alias("s"))
    assert sorted(got.collect()) == sorted(want.collect())


TAGS = ["<p>", "</p>", "<b class='x'>", "<script>x</script>", "<div onclick=\"y\">", "</div>", "<br/>", "<iframe>",
        "<H2 id=z>", "text", " onload=go ", "<a href='javascript:void(0)'>", "</a>", "&", "<pre>", "<body>"]


@SETTINGS
@given(parts=st.lists(st.sampled_from(TAGS), min_size=0, max_size=12))
def test_sanitizer_idempotent(spark, parts):
    html = "".join(parts)
    df = spark.createDataFrame([(html,)], "h string")
    once = df.select(H.sanitize_html("h").alias("h")).first()["h"]
    twice = spark.createDataFrame([(once,)], "h string").select(H.sanitize_html("h")).first()[0]
    assert once == twice
    assert "<script" not in once.lower() and "onclick" not in once.lower()
