"""A7-A10 kept up to date: the dashboard numbers as a running total.

Every batch that changes analyses gives the old and the new rows of the changed
keys. Their sums of `PARTS` are taken out of and put into the total (a retraction
and an insertion), so only changed rows are read. Batch b writes total b from total
b - 1, under its own number: a repeated batch writes the same row again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens import schemas as S
from revlens.operators.serving import HIGH_QUALITY_MIN, MEDIUM_QUALITY_MIN

START = -1  # the total before the first batch


def _parts() -> dict[str, Column]:
    q, r = F.col("quality_score"), F.col("risk_level")
    ones = {
        "total": F.lit(True),
        "high_quality": q >= HIGH_QUALITY_MIN,
        "medium_quality": (q >= MEDIUM_QUALITY_MIN) & (q < HIGH_QUALITY_MIN),
        "low_quality": q < MEDIUM_QUALITY_MIN,
        "high_risk": r == S.RISK_HIGH,
        "medium_risk": r == S.RISK_MEDIUM,
        "low_risk": r == S.RISK_LOW,
        "scored": q.isNotNull(),
    }
    return {k: F.coalesce(c.cast("long"), F.lit(0)) for k, c in ones.items()} | {"score_sum": F.coalesce(q.cast("long"), F.lit(0))}


PARTS = ("total", "high_quality", "medium_quality", "low_quality", "high_risk", "medium_risk", "low_risk", "scored", "score_sum")


def sums(rows: DataFrame) -> DataFrame:
    """One row: the sums of the parts; zeros without rows."""
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in _parts().items()])


class RunningMetrics:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.path = spark, f"{root}/metrics"
        self.schema = ", ".join(f"{p} long" for p in PARTS)

    def _write(self, total: DataFrame, batch_id: int) -> None:
        total.select(*PARTS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def start(self, rows: DataFrame) -> None:
        """The total of a table that is not empty when the stream begins."""
        self._write(sums(rows), START)

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(f"{self.schema}, batch long").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{self.schema}, batch long")

    def _total(self, before: int | None = None) -> DataFrame:
        """The latest total, or that of the last batch before the given one."""
        log = self._log() if before is None else self._log().where(F.col("batch") < before)
        last = log.agg(F.max("batch")).first()[0]
        if last is None:
            return sums(self.spark.createDataFrame([], "quality_score int, risk_level int"))
        return log.where(F.col("batch") == last).select(*PARTS)

    def change(self, old: DataFrame, new: DataFrame, batch_id: int) -> None:
        """Replace the old rows (with quality_score and risk_level) by the new ones."""
        out = sums(old).select(*[(-F.col(p)).alias(p) for p in PARTS])
        moved = self._total(batch_id).unionByName(out).unionByName(sums(new))
        row = moved.agg(*[F.sum(p).alias(p) for p in PARTS]).first()  # one row of numbers
        self._write(self.spark.range(1).select(*[F.lit(row[p]).cast("long").alias(p) for p in PARTS]), batch_id)

    def current(self) -> DataFrame:
        """A7 from the total, as `serving.quality_metrics` gives it."""
        average = F.when(F.col("scored") > 0, F.bround(F.col("score_sum") / F.col("scored"), 0)).otherwise(0.0)
        shown = ("total", "high_quality", "medium_quality", "low_quality", "average_score", "high_risk", "medium_risk", "low_risk")
        return self._total().withColumn("average_score", average).select(*[F.col(c).cast("int").alias(c) for c in shown])
