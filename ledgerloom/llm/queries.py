"""The queries of this subpackage: one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bloomlm, bpe, langid, media, oracles, packing, pii, quality, recipes, rules, search, simhash, urltree

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), JSON, RANKS)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(table(spark, sf_dir, "documents")))


def op5_bloom_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, words = bloomlm.train(docs.where(~langid.held_out(mod=7, rest=2)))
    scored = bloomlm.score(docs, model, words)
    return scored.select("doc_id", langid.held_out(mod=7, rest=2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), RANKS), RANKS)
    return both.select("doc_id", "n_tokens", F.sha2("decimal", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~langid.held_out(mod=4, rest=2)))
    scored = quality.score(docs, model)
    return scored.select("doc_id", langid.held_out(mod=4, rest=2).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.classify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.to_media(table(spark, sf_dir, "documents")))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op11_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, documents = search.build(table(spark, sf_dir, "documents"))
    return search.search(index, documents, table(spark, sf_dir, "benchmark"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_duplicates(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filters": oracles.op2(), "op8_quality_rules": oracles.OP8, "op11_block_max_search": oracles.OP11, "op12_exact_dedup": oracles.OP12,
        "op13_filter_audit": oracles.OP13,
    }
