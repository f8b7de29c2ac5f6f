"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revlens.llm import (
    decontaminate,
    hard_negatives,
    license_scan,
    mixing,
    ngram_join,
    packing,
    ppm,
    quality_ranker,
    quality_rules,
    turn_repair,
    url_lists,
    warc,
    wrapper,
)
from revlens.llm.common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "quality")
    return quality_rules.quality_rules(documents, quality_rules.train(documents, labels))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents", "doc_id", "text"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "quality")
    return quality_ranker.classify(documents, quality_ranker.train(documents, labels))


def op4_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = packing.write_packed(read(spark, sf_dir, "documents", "doc_id", "text"))
    return packing.sequences(blocks)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.write_and_read(read(spark, sf_dir, "pages", "page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join.join_documents(read(spark, sf_dir, "documents", "doc_id", "text"))
    return joined.select("doc_id", "class_id", "n_links", "n_copies")


def op10_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    return url_lists.judge(url_lists.dated_captures(pages), url_lists.dated_entries(pages))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repaired(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scan": op2_license_scan,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_token_packing": op4_token_packing,
    "op5_decontamination": op5_decontamination,
    "op6_warc": op6_warc,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_source_mixing": op8_source_mixing,
    "op9_ngram_join": op9_ngram_join,
    "op10_url_lists": op10_url_lists,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_turn_repair": op12_turn_repair,
    "op13_html_extraction": op13_html_extraction,
}

ORACLE: dict[str, str] = {
    "op6_warc": warc.WARC_SQL,
    "op8_source_mixing": mixing.MIX_SQL,
    "op10_url_lists": url_lists.JUDGE_SQL,
    "op11_hard_negatives": hard_negatives.NEGATIVES_SQL,
    "op12_turn_repair": turn_repair.REPAIR_SQL,
    "op13_html_extraction": wrapper.EXTRACT_SQL,
}
