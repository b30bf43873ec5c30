"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data, packing.

Each stage works on all that the one before kept, written as Parquet and read again. The last returns packed pieces, the
others rows with the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tesselann.llm import copies, decontaminate, packing, privacy, subword
from tesselann.llm.queries import table
from tesselann.llm.shared import shared_dir

#: Training and linking are no SQL.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores below one half. Equal texts go or stay together; null and empty texts score 0 and
    stay; without labels of both classes nothing is known, and all rows stay."""
    return subword.below(docs, subword.toxicity(docs, table(spark, sf_dir, "labels")), cut=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 0.8 of their five-word shingles the row with the smallest doc_id. Texts without
    words, null or not, are one group; equal rows count once; rows without doc_id stay."""
    return copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark passage; null and empty texts hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data and what discloses it redacted; a null text stays null."""
    return privacy.sanitised(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences; a null text has its end token alone."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}_{name}")
        docs = spark.read.parquet(f"{top}/{k}_{name}")
    return docs
