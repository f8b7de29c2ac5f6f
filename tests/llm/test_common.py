"""Word splitting and the key bitmap."""

import re

from pyspark.sql import functions as F

from revlens.llm import common


def test_words():
    for text in ["a\x0bb\x0cc d\t\r\ne", "\x1c a\x85b", "é ü", "", None, " x"]:
        assert common.words(text) == [w.encode() for w in re.findall(common.WORD_PATTERN, text or "")]
    assert common.alnum_words("MIT-Lic'é 9_z") == ["mit".encode(), b"lic", "é".encode(), b"9", b"z"]


def test_bitmap_never_misses_a_key(spark):
    keys = spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("k"))
    rows = spark.range(3000).select("id", F.col("id").cast("string").alias("k"))
    hinted = common.with_hint(rows, common.key_bitmap(keys, "k"), "k", "may")
    got = {r["id"] for r in hinted.where("may").collect()}
    assert hinted.count() == 3000 and set(range(0, 3000, 3)) <= got and len(got) < 1010
    none = common.with_hint(rows, common.key_bitmap(keys.limit(0), "k"), "k", "may")
    assert none.where("may").count() == 0
