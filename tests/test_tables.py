from datetime import datetime

import pytest
from pyspark.sql import functions as F

from revlens import schemas as S
from revlens.sources import tables as TB
from revlens.streaming.jobs import scratch


def test_insert_read_replace(spark):
    path = scratch(spark, "test-table")
    a = spark.createDataFrame([("1", "r", 1, "t", 0), ("2", "r", 2, "u", 0)], "id string, repo_name string, pr_number int, pr_title string, status int")
    TB.insert_rows(TB.conform(a, S.ANALYSES), path)
    TB.insert_rows(TB.conform(a.limit(0), S.ANALYSES), path)
    back = TB.read_table(spark, path, "analyses")
    assert back.schema == S.ANALYSES and back.count() == 2
    changes = spark.createDataFrame([("2", "r", 2, "u2", 2), ("3", "r", 3, "v", 0)], "id string, repo_name string, pr_number int, pr_title string, status int")
    out = TB.replace_rows(back, TB.conform(changes, S.ANALYSES), "id")
    got = sorted((r["id"], r["pr_title"], r["status"]) for r in out.collect())
    assert got == [("1", "t", 0), ("2", "u2", 2)]  # an update adds no row
    at = F.lit("2024-05-01 00:00:00").cast("timestamp")
    stamped = TB.replace_rows(back, TB.conform(changes, S.ANALYSES), "id", now=at)
    assert {r["id"]: r["updated_at"] for r in stamped.collect()} == {"1": None, "2": datetime(2024, 5, 1)}


def test_read_refuses_a_table_without_its_columns(spark):
    path = scratch(spark, "test-table-missing")
    spark.createDataFrame([("1", "r")], "id string, repo_name string").write.parquet(path)
    with pytest.raises(ValueError):
        TB.read_table(spark, path, "analyses")
    assert TB.read_table(spark, path, "analyses", allow_missing=True).first()["pr_title"] is None
