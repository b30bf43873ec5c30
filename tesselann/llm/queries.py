"""The queries of the ten operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bottomk, decontaminate, hilbert, licenses, packing, pages, privacy, simhash, subword


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=3, width=3)


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shards(table(spark, sf_dir, "documents"), 24)


def op3_information_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.spans(table(spark, sf_dir, "documents"))


def op4_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return subword.scored(docs, subword.quality(docs, table(spark, sf_dir, "labels")), cut=0.3)


def op5_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_simhash_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return subword.scored(docs, subword.toxicity(docs, table(spark, sf_dir, "labels")), cut=0.5)


def op8_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_boosted_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op10_bottomk_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bottomk.edited(table(spark, sf_dir, "documents"))
    prints = {"fingerprint": bottomk.hexed(rows["sketch"]), "edited_fingerprint": bottomk.hexed(rows["edited_sketch"])}
    return rows.withColumns(prints).drop("sketch", "edited_sketch")


QUERIES = {f.__name__: f for f in (op1_simhash_near_dup, op2_hilbert_shards, op3_information_privacy, op4_subword_quality, op5_min_bin_slack, op6_simhash_decontaminate, op7_subword_toxicity, op8_license_index, op9_boosted_main_text, op10_bottomk_fingerprint)}
