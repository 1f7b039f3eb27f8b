"""Run records: efficiency, classes, roll-ups, pivots, what is loaded and what is missing."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

MB = 1024 * 1024


def _div(a, b, digits: int) -> Column:
    """Rounded quotient, null instead of an error where the divisor is 0."""
    return F.round(F.try_divide(a, b), digits)


def finalise(runs: DataFrame) -> DataFrame:
    """Throughput, time per embedding and storage per thousand; null without embeddings or time."""
    n, t = F.col("embeddings_count"), F.col("total_time_seconds")
    done = n > 0
    return (
        runs.withColumn("throughput_embeddings_per_sec", F.when(done & (t > 0), _div(n, t, 2)))
        .withColumn("avg_time_per_embedding_ms", F.when(done, _div(t * 1000, n, 2)))
        .withColumn("storage_per_1k_embeddings_mb", F.when(done, _div(F.col("embeddings_size_mb") * 1000, n, 4)))
    )


def efficiency(runs: DataFrame) -> DataFrame:
    """Encoding, indexing and overall rates; the total here is encoding plus indexing time."""
    n, mb = F.col("embeddings_count"), F.col("embeddings_size_mb")
    enc, idx = F.col("encoding_inference_time_seconds"), F.col("indexing_time_seconds")
    total = F.col("encode_and_index_seconds")
    return (
        runs.withColumn("encoding_throughput_per_sec", _div(n, enc, 2))
        .withColumn("avg_encoding_time_ms", _div(enc * 1000, n, 2))
        .withColumn("indexing_throughput_per_sec", _div(n, idx, 2))
        .withColumn("avg_indexing_time_ms", _div(idx * 1000, n, 2))
        .withColumn("encode_and_index_seconds", F.round(enc + idx, 2))
        .withColumn("overall_throughput_per_sec", _div(n, total, 2))
        .withColumn("avg_total_time_ms", _div(total * 1000, n, 2))
        .withColumn("storage_per_1k_embeddings_mb", F.round(F.try_divide(mb, n) * 1000, 4))
        .withColumn("storage_per_embedding_kb", _div(mb * 1024, n, 4))
        .withColumn("bytes_per_dimension", _div(mb * MB, n * F.col("embedding_dimension"), 4))
    )


def efficiency_summary(detail: DataFrame) -> DataFrame:
    avg = lambda c, d: F.round(F.avg(c), d)
    return detail.agg(
        F.count(F.lit(1)).alias("runs"), F.sum("embeddings_count").alias("embeddings"),
        avg("encoding_throughput_per_sec", 4).alias("avg_encoding_throughput"),
        F.max("encoding_throughput_per_sec").alias("max_encoding_throughput"),
        avg("overall_throughput_per_sec", 4).alias("avg_overall_throughput"),
        avg("storage_per_1k_embeddings_mb", 4).alias("avg_storage_per_1k_mb"),
        avg("avg_encoding_time_ms", 4).alias("avg_encoding_time_ms"),
    )


def classify(runs: DataFrame) -> DataFrame:
    """Model type, size and speed classes; 'unsupervised' is looked for before 'supervised'."""
    model, size = F.col("model"), F.col("processed_tables")
    speed = F.col("throughput_embeddings_per_sec")
    kind = F.lit("other")
    for word in reversed(["baseline", "unsupervised", "supervised", "hybrid"]):
        kind = F.when(model.contains(word), word).otherwise(kind)
    return (
        runs.withColumn("model_type", kind)
        .withColumn("dataset_size", F.when(size < 1000, "small").when(size < 10000, "medium")
                    .when(size < 50000, "large").otherwise("xlarge"))
        .withColumn("performance", F.when(speed < 5, "slow").when(speed < 15, "medium").otherwise("fast"))
    )


def rollup(runs: DataFrame) -> DataFrame:
    """Totals over all runs and by dataset, model and model type in one pass.

    Tables are summed over all runs but taken as the maximum of a dataset, whose models all read
    the same tables.
    """
    sets = F.create_map(
        F.lit("all"), F.lit(""), F.lit("dataset"), F.col("dataset"), F.lit("model"), F.col("model"),
        F.lit("model_type"), F.col("model_type"),
    )
    long = runs.select("*", F.explode(sets).alias("level", "name"))
    return long.groupBy("level", "name").agg(
        F.count(F.lit(1)).alias("combinations"),
        F.sum("embeddings_count").alias("total_embeddings"),
        F.when(F.col("level") == "dataset", F.max("processed_tables"))
        .otherwise(F.sum("processed_tables")).alias("total_tables"),
        F.round(F.avg("throughput_embeddings_per_sec"), 4).alias("avg_throughput"),
        F.round(F.avg("encoding_inference_time_seconds"), 4).alias("avg_encoding_time"),
        F.round(F.avg("indexing_time_seconds"), 4).alias("avg_indexing_time"),
        F.round(F.sum("embeddings_size_mb"), 4).alias("total_storage_mb"),
    )


def model_averages(runs: DataFrame) -> DataFrame:
    """Per model: run averages, unweighted and weighted by embeddings, and the datasets it ran on."""
    n, speed = F.col("embeddings_count"), F.col("throughput_embeddings_per_sec")
    return runs.groupBy("model").agg(
        F.countDistinct("dataset").alias("datasets"),
        F.sum(n).alias("total_embeddings"),
        F.round(F.avg(speed), 4).alias("avg_throughput"),
        F.round(F.try_divide(F.sum(speed * n), F.sum(n)), 4).alias("weighted_throughput"),
        F.round(F.avg("avg_time_per_embedding_ms"), 4).alias("avg_time_ms"),
        F.round(F.avg("storage_per_1k_embeddings_mb"), 4).alias("avg_storage"),
    )


# name in a nested summary -> column of the run record (fixed values)
NESTED = {
    "throughput": "throughput_embeddings_per_sec", "storage_efficiency": "storage_per_1k_embeddings_mb",
    "encoding_time": "encoding_inference_time_seconds", "total_time": "total_time_seconds", "embeddings": "embeddings_count",
}


def nested(runs: DataFrame) -> DataFrame:
    """(level, name, entries): for every dataset its models, for every model its datasets, in one pass.

    ``entries`` maps the other name to the five measures of the latest run of both.
    """
    latest = latest_runs(runs)
    measures = F.struct(*[F.col(column).alias(name) for name, column in NESTED.items()]).alias("measures")
    sides = latest.select("dataset", "model", measures)
    grouped = sides.groupingSets([["dataset"], ["model"]], "dataset", "model").agg(
        F.grouping("dataset").alias("_of_model"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "measures")))).alias("_models"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("dataset", "measures")))).alias("_datasets"))
    by_model = F.col("_of_model") == 1
    return grouped.select(
        F.when(by_model, "model").otherwise("dataset").alias("level"), F.coalesce("dataset", "model").alias("name"),
        F.when(by_model, F.col("_datasets")).otherwise(F.col("_models")).alias("entries"))


def latest_runs(runs: DataFrame, keys: Sequence[str] = ("dataset", "model"), at: str = "timestamp_end") -> DataFrame:
    """The last run of each combination, found by aggregation (nothing is sorted)."""
    rest = [c for c in runs.columns if c not in keys]
    last = F.max_by(F.struct(*rest), at)
    return runs.groupBy(*keys).agg(last.alias("_r")).select(*keys, "_r.*")


def pivot(runs: DataFrame, measure: str, models: Sequence[str]) -> DataFrame:
    """Dataset by model, the last run winning; missing combinations are null."""
    return runs.groupBy("dataset").pivot("model", list(models)).agg(F.max_by(measure, "timestamp_end"))


def progress_matrix(inventory: DataFrame, models: Sequence[str]) -> DataFrame:
    """Embeddings per dataset and model, 0 where missing; test collections are left out."""
    kept = inventory.filter(~F.lower("dataset").contains("test"))
    return kept.groupBy("dataset").pivot("model", list(models)).agg(F.sum("embeddings")).fillna(0, list(models))


def completion(inventory: DataFrame, n_models: int) -> DataFrame:
    """Collections made out of datasets x models, in percent."""
    kept = inventory.filter(~F.lower("dataset").contains("test"))
    return kept.agg(
        F.count(F.lit(1)).alias("completed"), (F.countDistinct("dataset") * n_models).alias("expected")
    ).withColumn("percent", _div(100.0 * F.col("completed"), F.col("expected"), 1))


def pending(datasets: DataFrame, models: Sequence[str], done: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Every dataset x model with its status: to run, already completed, or its model skipped."""
    grid = datasets.select("dataset").distinct().withColumn("model", F.explode(F.array(*map(F.lit, models))))
    finished = done.select("dataset", "model").distinct().withColumn("_done", F.lit(True))
    return grid.join(finished, ["dataset", "model"], "left").select(
        "dataset", "model",
        F.when(F.col("model").isin(list(skip)), "skipped model").when(F.col("_done"), "already completed")
        .otherwise("to run").alias("status"),
    )


def inventory(collections: DataFrame) -> DataFrame:
    """collections(collection, embeddings, dimension) with dataset and model read from the name."""
    name = F.col("collection")
    head = F.substring_index(name, "_", 1)
    rest = F.when(name.contains("_"), F.substring(name, F.length(head) + 2, F.length(name))).otherwise("unknown")
    is_test = F.lower(name).contains("test")
    return collections.withColumn("dataset", F.when(is_test, "test").otherwise(head)).withColumn(
        "model", F.when(is_test, name).otherwise(rest)
    )


def inventory_totals(inv: DataFrame) -> DataFrame:
    return inv.agg(
        F.count(F.lit(1)).alias("collections"), F.sum("embeddings").alias("embeddings"),
        F.countDistinct("dataset").alias("datasets"), F.countDistinct("model").alias("models"),
    )


SYSTEM_DATABASES = ("admin", "config", "local")  # fixed values


def load_status(expected: DataFrame, documents: DataFrame) -> DataFrame:
    """Per expected dataset: collections, documents, loaded or not.

    ``documents(dataset, collection, n)`` may hold several rows per collection.
    """
    found = documents.filter(~F.col("dataset").isin(*SYSTEM_DATABASES)).groupBy("dataset").agg(
        F.countDistinct("collection").alias("collections"), F.sum("n").alias("documents")
    )
    return expected.select("dataset").join(found, "dataset", "left").select(
        "dataset", F.coalesce("collections", F.lit(0)).alias("collections"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        (F.coalesce("documents", F.lit(0)) > 0).alias("loaded"),
    )


def is_table_document(table: str = "table") -> Column:
    """A document that carries a whole table: a non-empty list of rows."""
    return F.coalesce((F.size(table) > 0) & F.get(table, 0).isNotNull(), F.lit(False))


def layout_profile(documents: DataFrame, collection: str, table: str = "table") -> DataFrame:
    """Per collection: documents, widest header, and whether all documents carry a table."""
    return documents.groupBy(collection).agg(
        F.count(F.lit(1)).alias("documents"),
        F.max(F.size(F.get(table, 0))).alias("widest"),
        F.count_if(is_table_document(table)).alias("table_documents"),
        F.when(F.bool_and(is_table_document(table)), "table per document").otherwise("flat").alias("layout"),
    )


def reconcile(source: DataFrame, index: DataFrame) -> DataFrame:
    """source(dataset) and index(dataset), one row per table or vector: counts side by side."""
    a = source.groupBy("dataset").agg(F.count(F.lit(1)).alias("tables"))
    b = index.groupBy("dataset").agg(F.count(F.lit(1)).alias("vectors"))
    both = a.join(b, "dataset", "full_outer")
    t, v = F.coalesce("tables", F.lit(0)), F.coalesce("vectors", F.lit(0))
    return both.select("dataset", t.alias("tables"), v.alias("vectors"), (t == v).alias("matches"))
