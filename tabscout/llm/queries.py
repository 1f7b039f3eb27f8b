"""The queries opN_<name>: each applies one operator of this folder to its whole table."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabscout.llm import decontaminate, golay, katz, linecrf, linejoin, mixing, negatives, oracles, partitions, randomness, repair, tokencount, toxicity, wavelet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {
    "op1_mixing": oracles.MIXING,
    "op3_line_join": oracles.LINE_JOIN,
    "op5_decontamination": oracles.DECONTAMINATION,
    "op11_viterbi_repair": oracles.REPAIR,
    "op12_threshold_negatives": oracles.NEGATIVES,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return katz.score_documents(table(spark, sf_dir, "documents"), held_out)


@query
def op3_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linejoin.report(table(spark, sf_dir, "documents"))


@query
def op3_line_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linejoin.line_links(table(spark, sf_dir, "documents"))


@query
def op4_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.binary_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op7_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return randomness.report(table(spark, sf_dir, "documents"))


@query
def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = linecrf.with_scores(docs, table(spark, sf_dir, "labels"), ~fold)
    return scored.select(
        "doc_id", fold.alias("held_out"), F.col("_score").alias("score"),
        F.when(F.col("_score") >= linecrf.THRESHOLD, 1).otherwise(0).alias("predicted"))


@query
def op9_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op11_viterbi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(table(spark, sf_dir, "conversations"))


@query
def op12_threshold_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.prepared(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, relabel))


@query
def op13_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~fold)
    return toxicity.with_scores(docs, model, "score").select(
        "doc_id", fold.alias("held_out"), "score", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"))
