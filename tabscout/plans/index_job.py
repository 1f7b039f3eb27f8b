"""From table documents to a stored vector collection and its run record."""
from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabscout.functions import views
from tabscout.functions.hashing import point_id
from tabscout.functions.vectors import hash_encode
from tabscout.operators import runs
from tabscout.session import written
from tabscout.sources.store import last_by_id, overwrite_collections, read_vectors

ROW_LIMIT = 3


def valid(table: str = "table") -> Column:
    """Documents with a non-empty header and at least one row are indexed, others skipped."""
    return F.coalesce((F.size(table) > 1) & (F.size(F.get(table, 0)) > 0), F.lit(False))


def points(
    documents: DataFrame, dataset: str, model: str, encoder: Callable[[Column], Column] = hash_encode,
    order: str | None = None, simple: bool = False,
) -> DataFrame:
    """VECTOR_SCHEMA rows of documents(database_name, table_id, table); one point per table.

    ``num_rows`` counts all rows of the table, whatever the text shows of it. ``simple`` takes the
    spaced view of the first five rows, as decoder models are given.
    """
    if simple:
        text = views.simple_view("table_id", F.get("table", 0), F.slice("table", 2, 5))
    else:
        text = views.document_view("table_id", F.get("table", 0), F.slice("table", 2, ROW_LIMIT))
    made = documents.filter(valid()).select(
        point_id(F.col("database_name"), F.col("table_id")).alias("point_id"),
        F.lit(dataset).alias("dataset"), F.lit(model).alias("model"), F.col("database_name").alias("db_name"),
        F.col("table_id").alias("table_name"), F.get("table", 0).alias("schema"),
        (F.size("table") - 1).cast("bigint").alias("num_rows"), F.col("database_name").alias("source_collection"),
        encoder(text).cast("array<float>").alias("embedding"),
        *([F.col(order).alias("_order")] if order else []),
    )
    return last_by_id(made, "_order") if order else made


def layout_of(documents: DataFrame) -> str:
    """How a collection holds its tables: "table" (one document with all rows), "long" (one document
    per row) or "sniffed" (one document whose fields have to be looked for)."""
    if "table" in documents.columns:
        return "table"
    return "long" if {"table_name", "line", "cells"} <= set(documents.columns) else "sniffed"


def _encoded(texts: DataFrame, dataset: str, model: str, encoder) -> DataFrame:
    """VECTOR_SCHEMA rows of texts(database_name, table_name, schema, num_rows, text)."""
    return texts.select(
        point_id(F.col("database_name"), F.col("table_name")).alias("point_id"), F.lit(dataset).alias("dataset"),
        F.lit(model).alias("model"), F.col("database_name").alias("db_name"), "table_name", "schema",
        F.col("num_rows").cast("bigint").alias("num_rows"), F.col("database_name").alias("source_collection"),
        encoder(F.col("text")).cast("array<float>").alias("embedding"),
    )


def long_points(documents: DataFrame, database: str, dataset: str, model: str, encoder=hash_encode) -> DataFrame:
    """Points of documents(table_name, line, cells), one per row of a table; the text shows the first rows."""
    place = F.row_number().over(Window.partitionBy("table_name").orderBy("line"))
    first = documents.withColumn("_n", place).where(F.col("_n") <= ROW_LIMIT).drop("_n")
    sizes = documents.groupBy("table_name").agg(F.count(F.lit(1)).alias("num_rows"))
    shown = views.long_documents(first).join(sizes, "table_name")
    return _encoded(shown.select(
        F.lit(database).alias("database_name"), "table_name", F.col("columns").alias("schema"), "num_rows",
        views.document_view("table_name", "columns", "rows").alias("text")), dataset, model, encoder)


def sniffed_points(documents: DataFrame, dataset: str, model: str, encoder=hash_encode) -> DataFrame:
    """Points of documents(database_name, table_name, column_names, header, rows, row_data, fields)."""
    text = views.sniffed_view("table_name", "column_names", "header", "rows", "row_data", "fields", ROW_LIMIT)
    names = F.transform("column_names", lambda p: F.get(p, F.size(p) - 1))
    return _encoded(documents.select(
        "database_name", "table_name", F.coalesce(names, F.col("header"), F.map_keys("fields")).alias("schema"),
        F.size(F.coalesce("rows", "row_data", F.array().cast("array<array<string>>"))).alias("num_rows"),
        text.alias("text")), dataset, model, encoder)


def any_points(documents: DataFrame, database: str, dataset: str, model: str, encoder=hash_encode) -> DataFrame:
    """Points of a collection in whatever layout it is."""
    layout = layout_of(documents)
    if layout == "long":
        return long_points(documents, database, dataset, model, encoder)
    return (points if layout == "table" else sniffed_points)(documents, dataset, model, encoder)


def run_record(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Counts and sizes of a finished index: one row per dataset and model."""
    tables = documents.agg(F.count_if(~valid()).alias("skipped_tables")).scalar()
    return (
        stored.groupBy("dataset", "model").agg(
            F.count(F.lit(1)).alias("embeddings_count"), F.max(F.size("embedding")).alias("embedding_dimension"),
            F.sum(4 * F.size("embedding")).cast("bigint").alias("embeddings_size_bytes"),
        )
        .withColumn("collection", F.concat_ws("_", "dataset", "model"))
        .withColumn("processed_tables", F.col("embeddings_count")).withColumn("skipped_tables", tables)
        .withColumn("embeddings_size_mb", F.round(F.col("embeddings_size_bytes") / runs.MB, 4))
    )


def stored_bytes(spark, path: str) -> int:
    """Size of all files below a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def build_index(documents: DataFrame, dataset: str, model: str, path: str, encoder=hash_encode, model_path: str | None = None) -> DataFrame:
    """Write the collection and return its finished run record, timed by the job itself.

    Encoding ends when the points are stored once in the shared folder; indexing lays them out as the
    collection.
    """
    spark = documents.sparkSession
    stamp = lambda at: time.strftime("%Y-%m-%d %H:%M:%S", time.localtime(at))
    started = time.time()
    made = written(points(documents, dataset, model, encoder), "points")
    encoded = time.time()
    overwrite_collections(made, path)
    ended = time.time()
    stored = read_vectors(spark, path).filter((F.col("dataset") == dataset) & (F.col("model") == model))
    folder = f"{path}/dataset={dataset}/model={model}"
    size = stored_bytes(spark, folder) if not stored.isEmpty() else 0
    known = {
        "encoding_inference_time_seconds": round(encoded - started, 2), "indexing_time_seconds": round(ended - encoded, 2),
        "total_time_seconds": round(ended - started, 2), "index_size_bytes": size, "index_size_mb": round(size / runs.MB, 4),
        "timestamp_start": stamp(started), "timestamp_end": stamp(ended), "model_path": model_path or "unknown",
        "gpu_available": False, "device": "CPU",
    }
    record = run_record(documents, stored)
    for name, value in known.items():
        record = record.withColumn(name, F.lit(value))
    return runs.finalise(record)
