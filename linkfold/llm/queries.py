"""The operators' queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from linkfold.llm import bpe, chat, decontamination, filter_audit, line_dedup, minhash, oracles, packing, quality, rules
from linkfold.llm import token_counts, topk, toxicity, whitening
from linkfold.llm.common import fold, table, written


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~held)
    out = toxicity.score(docs, toxicity.fit(docs, labels), keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~held)
    out = quality.score(docs, quality.fit(docs, labels), keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.filter_verdicts(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.windows(told.unionByName(more)))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "embeddings")
    vectors = written(topk.whole_vectors(raw, "vec_id", "embedding", 256.0), "vectors")
    return topk.search(vectors, vectors.filter("id % 50 = 0"), k=5)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048, keep=["doc_id"])


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        {"<|endoftext|>": 50256},
        end_id=2,
        capacity=1024,
    )


def op9_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), line_dedup.ALL_LINES)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", scale=64.0, shift=1_000_000, components=16)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("letter")


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_quality,
        op3_quality_rules,
        op4_byte_bpe,
        op5_chat_format,
        op6_exact_topk,
        op7_token_counts,
        op8_best_fit_packing,
        op9_minmax_near_dedup,
        op10_line_dedup,
        op11_whitening,
        op12_decontamination,
        op13_filter_audit,
    )
}
#: Trained models, tokenizers' ids, packing, edit similarity and eigenvectors have no SQL; tests hold them against plain versions.
ORACLES: dict[str, str] = {
    "op3_quality_rules": oracles.OP3,
    "op5_chat_format": oracles.OP5,
    "op6_exact_topk": oracles.OP6,
    "op9_minmax_near_dedup": oracles.OP9,
    "op12_decontamination": oracles.OP12,
    "op13_filter_audit": oracles.OP13,
}
