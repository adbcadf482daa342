"""A corpus pipeline of five training-data operators over the ``documents`` table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again before the next
stage, so that a lost executor never costs more than the stage at hand. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, common, decontamination, jaccard_join, pii, quality_qda
from tessera.llm.queries import register, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of the learning folds; documents that score under 0.5 go."""
    common.ship(spark)
    model = quality_qda.fit(quality_qda.feature_rows(docs, ["doc_id"]), common.table(spark, sf_dir, "labels"))
    return quality_qda.keep_rows(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: the least doc_id."""
    common.ship(spark)
    return jaccard_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    common.ship(spark)
    return decontamination.remove_documents(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced; ``n_chars`` follows the text."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, with digests of the ids and of the text decoded from them."""
    common.ship(spark)
    return bpe.encode(docs, vocabulary("byte_bpe_50k.json"), [c for c in docs.columns if c != "text"])


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("PII", personal_data),
    ("BPE encoding and decoding", tokens),
]

#: The stages learn a model, follow links and run tokenizer code; tests hold the result against brute force.
ORACLE_SQL = None


@register("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each one's rows are written to the shared checkpoint folder and read again."""
    folder = f"{common.ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
