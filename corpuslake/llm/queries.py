"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table


def _classified(spark: SparkSession, sf_dir: str, label: str, settings, folds: int, out: int) -> DataFrame:
    from .compression import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), folds) != out).select("doc_id", F.col(label).alias("y"))
    scored = score(docs, train(docs, labels, settings))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), folds) == out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .compression import TOXICITY

    return _classified(spark, sf_dir, "toxic", TOXICITY, 5, 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .compression import QUALITY

    return _classified(spark, sf_dir, "quality", QUALITY, 3, 1)


def op3_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codec import read, write
    from .tokens import tokenizer_path

    return read(write(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2))


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree import score

    out = crc_mod(F.col("doc_id"), 7) == 2
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~out)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    from .tokens import tokenizer_path

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(pii.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import search

    return search(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import removed

    return removed(table(spark, sf_dir, "documents"), size=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import matches

    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import join

    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_token_codec": op3_token_codec,
    "op4_suffix_tree": op4_suffix_tree,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_pii": op6_pii,
    "op7_topk": op7_topk,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}
