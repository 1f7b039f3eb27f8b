"""Query sets: (queries(query_id, query), qrels(query_id, table_id))."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabscout.sources.files import jsonl_records

QuerySet = tuple[DataFrame, DataFrame]


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with their place in the file as query id."""
    return spark.read.parquet(path).select("*", F.col("_metadata.row_index").alias("query_id"))


def _simple(df: DataFrame, text: str) -> QuerySet:
    return df.select("query_id", F.col(text).alias("query")), df.select("query_id", "table_id")


def read_statements(spark: SparkSession, path: str) -> QuerySet:
    """Labelled statements: JSONL with statement and table_id."""
    lines = jsonl_records(spark, path).select(
        F.col("idx").alias("query_id"), F.from_json("record", "statement string, table_id string").alias("r")
    )
    return _simple(lines.select("query_id", "r.*"), "statement")


def read_query_parquet(spark: SparkSession, path: str) -> QuerySet:
    return _simple(_numbered(spark, path), "query")


def gold_tables(df: DataFrame) -> DataFrame:
    """qrels from (query_id, db_id, gold_tables): tables as ``db::table``, each once."""
    return df.select("query_id", "db_id", F.explode("gold_tables").alias("_t")).select(
        "query_id", F.concat_ws("::", "db_id", "_t").alias("table_id")
    ).distinct()


def read_schema_queries(spark: SparkSession, path: str) -> QuerySet:
    """Enriched questions: Parquet with question, db_id and gold_tables."""
    df = _numbered(spark, path)
    return df.select("query_id", F.col("question").alias("query")), gold_tables(df)


def read_benchmark_queries(spark: SparkSession, path: str) -> QuerySet:
    """JSONL with query_id, query, relevant_tables and benchmark."""
    df = spark.read.schema("query_id string, query string, relevant_tables array<string>, benchmark string").json(path)
    qrels = df.select("query_id", F.explode("relevant_tables").alias("table_id")).distinct()
    return df.select("query_id", "query", "benchmark"), qrels
