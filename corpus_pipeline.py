"""A training corpus from raw documents: five stages over the operators in
revlens.llm, each stored as Parquet and read again before the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of documents.

1. quality classifier: documents that it rejects go
2. n-gram Jaccard join: one document of each near-duplicate group stays
3. benchmark decontamination: documents that hold a test item go
4. mixing sources to target weights: documents come as often as the mix takes them
5. token ids: packed fixed-length sequences, one row each

Defined results: repeated rows collapse in stage 2; null and empty texts are
judged as empty texts by stage 1 and carry no words in stage 4, which leaves
them out; extra columns of any name pass through stages 1 to 4; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revlens.llm import decontaminate, mixing, ngram_join, packing, quality_ranker
from revlens.llm.common import read
from revlens.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels", "doc_id", "quality")
    return quality_ranker.accepted(docs, quality_ranker.train(docs, labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.sequences(packing.write_packed(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", packing_stage),
]

#: SQL can express neither the learned classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, out: str | None = None) -> DataFrame:
    """The rows of the packed corpus. Its id matrices are stored as Parquet under
    `out`, or in a new folder of the shared scratch."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
    return packing.sequences(packing.write_packed(docs, path=out))
