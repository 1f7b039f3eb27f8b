"""Datasets by name: which reader loads them, and a summary of what was loaded."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabscout.sources import archive, folders, tables
from tabscout.sources.files import json_records, jsonl_records

Reader = Callable[[SparkSession, str, str], DataFrame]


def _tables_json(spark, path, db):
    read = jsonl_records if path.endswith(".jsonl") else json_records
    return tables.normalise_tables(read(spark, path), db)


READERS: dict[str, Reader] = {
    "folders": lambda spark, path, db: folders.read_folders(spark, path),
    "folder_rows": lambda spark, path, db: folders.csv_rows(spark, path),
    "tables_json": _tables_json,
    "jsonl_tables": lambda spark, path, db: tables.normalise_tables(jsonl_records(spark, path), db),
    "schema_json": lambda spark, path, db: tables.schema_documents(tables.read_schema_json(spark, path)),
    "corpus_parquet": lambda spark, path, db: tables.read_corpus_splits(spark, path),
    "validation_parquet": lambda spark, path, db: tables.read_validation(spark, path),
    "archive_tables_json": lambda spark, path, db: tables.identify_tables(
        archive.read_archive_format(spark, path, "tables_json"), db
    ),
    "archive_folder_csv": lambda spark, path, db: archive.read_archive_format(spark, path, "folder_csv").withColumn(
        "collection", archive.collection_of()
    ),
    "archive_folder_json": lambda spark, path, db: archive.read_archive_format(spark, path, "folder_json"),
    "archive_corpus_parquet": lambda spark, path, db: archive.read_archive_format(spark, path, "corpus_parquet").withColumn(
        "collection", archive.collection_of()
    ),
}


@dataclass(frozen=True)
class Dataset:
    name: str
    path: str
    format: str

    @property
    def database(self) -> str:
        return self.name.replace("-", "_")


def load(spark: SparkSession, dataset: Dataset) -> DataFrame:
    if dataset.format not in READERS:
        raise ValueError(f"unknown format {dataset.format!r}; known: {sorted(READERS)}")
    return READERS[dataset.format](spark, dataset.path, dataset.database)


def load_summary(spark: SparkSession, datasets: list[Dataset]) -> DataFrame:
    """(dataset, documents) of a list of datasets, as one plan."""
    out = None
    for d in datasets:
        n = load(spark, d).agg(F.count(F.lit(1)).alias("documents")).select(F.lit(d.name).alias("dataset"), "documents")
        out = n if out is None else out.unionByName(n)
    return out
