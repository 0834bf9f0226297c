"""From raw documents to packed training sequences, stage by stage.

Each stage gets what its predecessor kept, read again from Parquet, and its decisions take effect: toxic
documents go, documents of low quality go, repeated lines are taken out of the texts, of each group of
near-duplicates one document stays, and what is left is packed. The classifiers are fitted on the labelled
documents among those that the stage got. A line that is taken out changes ``n_chars`` with the text.

All columns of ``documents`` pass through but for the last stage, which returns the pieces and their places.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from linkfold.llm import line_dedup, minhash, packing, quality, toxicity
from linkfold.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("predicted = 0").select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter("predicted = 1").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(docs, line_dedup.ALL_LINES)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.distinct_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_digest(
        docs,
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        {"<|endoftext|>": 50256},
        end_id=2,
        capacity=1024,
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", keep_quality),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_documents),
    ("best_fit_packing", pack_sequences),
]

#: Trained models and hashes have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
