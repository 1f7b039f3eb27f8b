"""Registered queries: run records, pivots, inventories and reconciliation."""
from __future__ import annotations

from pyspark.sql import functions as F

from tabscout.operators import runs
from tabscout.plans.corpora import DOCUMENTS_SQL, document_corpus
from tabscout.plans.registry import query, table

# event type -> model of the derived run records
MODELS = {
    "view": "baseline_sbert", "click": "supervised_v1", "purchase": "supervised_v2",
    "signup": "unsupervised_v6", "error": "hybrid_v7",
}
ALL_MODELS = sorted([*MODELS.values(), "baseline_mpnet"])  # the last was never run

# Runs: a dataset is five users in turn, a model an event type, a run ten days
RUNS_SQL = f"""
base AS (
  SELECT 'ds' || (user_id % 5) AS dataset,
    CASE event_type {' '.join(f"WHEN '{e}' THEN '{m}'" for e, m in MODELS.items())} END AS model,
    (dayofmonth(ts) - 1) // 10 AS part, value::DECIMAL(18,2) AS v, regexp_extract(props, '[0-9]+')::BIGINT AS k, ts FROM events),
summed AS (
  SELECT dataset, model, dataset || '_' || model AS collection, sum(v)::DOUBLE AS encoding_inference_time_seconds,
    sum(k)::DOUBLE / 100 AS indexing_time_seconds, count(*) AS embeddings_count, sum(k)::BIGINT AS processed_tables,
    count(CASE WHEN k < 5 THEN 1 END) AS skipped_tables, 64 AS embedding_dimension, count(*) * 256 AS embeddings_size_bytes,
    count(*) * 256 / (1024 * 1024) AS embeddings_size_mb, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS timestamp_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS timestamp_end
  FROM base GROUP BY dataset, model, part),
timed AS (SELECT *, (encoding_inference_time_seconds + indexing_time_seconds) * 1.25 AS total_time_seconds FROM summed),
runs AS (
  SELECT *, CASE WHEN embeddings_count > 0 AND total_time_seconds > 0 THEN round(embeddings_count / nullif(total_time_seconds, 0), 2) END AS throughput_embeddings_per_sec,
    round(total_time_seconds * 1000 / nullif(embeddings_count, 0), 2) AS avg_time_per_embedding_ms,
    round(embeddings_size_mb * 1000 / nullif(embeddings_count, 0), 4) AS storage_per_1k_embeddings_mb FROM timed)
"""
_RUN_COLUMNS = (
    "dataset, model, collection, encoding_inference_time_seconds, indexing_time_seconds, embeddings_count, processed_tables, "
    "skipped_tables, embeddings_size_bytes, timestamp_start, timestamp_end, total_time_seconds, "
    "throughput_embeddings_per_sec, avg_time_per_embedding_ms, storage_per_1k_embeddings_mb"
)


def _stamp(ts):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def run_records(spark, sf_dir):
    """Finished run records, several per dataset and model."""
    events = table(spark, sf_dir, "events")
    model = F.coalesce(*[F.when(F.col("event_type") == e, m) for e, m in MODELS.items()])
    base = events.select(
        F.concat(F.lit("ds"), (F.col("user_id") % 5).cast("string")).alias("dataset"), model.alias("model"),
        F.floor((F.dayofmonth("ts") - 1) / 10).alias("part"), F.col("value").cast("decimal(18,2)").alias("v"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"), "ts",
    )
    n = F.count(F.lit(1))
    summed = base.groupBy("dataset", "model", "part").agg(
        F.sum("v").cast("double").alias("encoding_inference_time_seconds"),
        (F.sum("k").cast("double") / 100).alias("indexing_time_seconds"),
        n.alias("embeddings_count"), F.sum("k").alias("processed_tables"),
        F.count(F.when(F.col("k") < 5, 1)).alias("skipped_tables"), (n * 256).alias("embeddings_size_bytes"),
        _stamp(F.min("ts")).alias("timestamp_start"), _stamp(F.max("ts")).alias("timestamp_end"),
    )
    timed = (
        summed.withColumn("collection", F.concat_ws("_", "dataset", "model"))
        .withColumn("embedding_dimension", F.lit(64))
        .withColumn("embeddings_size_mb", F.col("embeddings_size_bytes") / runs.MB)
        .withColumn("total_time_seconds", (F.col("encoding_inference_time_seconds") + F.col("indexing_time_seconds")) * 1.25)
    )
    return runs.finalise(timed).drop("part")


@query("run_efficiency", f"WITH {RUNS_SQL} SELECT {_RUN_COLUMNS} FROM runs")
def run_efficiency(spark, sf_dir):
    return run_records(spark, sf_dir).select(*_RUN_COLUMNS.split(", "))


_DETAIL_SQL = f"""{RUNS_SQL}, t AS (
  SELECT *, embeddings_count AS n, encoding_inference_time_seconds AS enc, indexing_time_seconds AS idx, embeddings_size_mb AS mb,
    round(encoding_inference_time_seconds + indexing_time_seconds, 2) AS encode_and_index_seconds FROM runs),
detail AS (
  SELECT dataset, model, timestamp_end, embeddings_count, round(n / nullif(enc, 0), 2) AS encoding_throughput_per_sec, round(enc * 1000 / n, 2) AS avg_encoding_time_ms,
    round(n / nullif(idx, 0), 2) AS indexing_throughput_per_sec, round(idx * 1000 / n, 2) AS avg_indexing_time_ms, encode_and_index_seconds,
    round(n / nullif(encode_and_index_seconds, 0), 2) AS overall_throughput_per_sec, round(encode_and_index_seconds * 1000 / n, 2) AS avg_total_time_ms,
    round(mb / n * 1000, 4) AS storage_per_1k_embeddings_mb, round(mb * 1024 / n, 4) AS storage_per_embedding_kb,
    round(mb * 1048576 / (n * embedding_dimension), 4) AS bytes_per_dimension FROM t)
"""
_DETAIL = [
    "dataset", "model", "timestamp_end", "embeddings_count", "encoding_throughput_per_sec", "avg_encoding_time_ms", "indexing_throughput_per_sec",
    "avg_indexing_time_ms", "encode_and_index_seconds", "overall_throughput_per_sec", "avg_total_time_ms",
    "storage_per_1k_embeddings_mb", "storage_per_embedding_kb", "bytes_per_dimension",
]


@query("run_efficiency_detail", f"WITH {_DETAIL_SQL} SELECT * FROM detail")
def run_efficiency_detail(spark, sf_dir):
    return runs.efficiency(run_records(spark, sf_dir)).select(*_DETAIL)


@query("run_efficiency_summary", f"""WITH {_DETAIL_SQL}
SELECT count(*) AS runs, sum(embeddings_count)::BIGINT AS embeddings, round(avg(encoding_throughput_per_sec), 4) AS avg_encoding_throughput,
  max(encoding_throughput_per_sec) AS max_encoding_throughput, round(avg(overall_throughput_per_sec), 4) AS avg_overall_throughput,
  round(avg(storage_per_1k_embeddings_mb), 4) AS avg_storage_per_1k_mb, round(avg(avg_encoding_time_ms), 4) AS avg_encoding_time_ms FROM detail""")
def run_efficiency_summary(spark, sf_dir):
    return runs.efficiency_summary(runs.efficiency(run_records(spark, sf_dir)))


_CLASSIFIED_SQL = f"""{RUNS_SQL}, classified AS (
  SELECT *, CASE WHEN contains(model, 'baseline') THEN 'baseline' WHEN contains(model, 'unsupervised') THEN 'unsupervised'
      WHEN contains(model, 'supervised') THEN 'supervised' WHEN contains(model, 'hybrid') THEN 'hybrid' ELSE 'other' END AS model_type,
    CASE WHEN processed_tables < 1000 THEN 'small' WHEN processed_tables < 10000 THEN 'medium' WHEN processed_tables < 50000 THEN 'large' ELSE 'xlarge' END AS dataset_size,
    CASE WHEN throughput_embeddings_per_sec < 5 THEN 'slow' WHEN throughput_embeddings_per_sec < 15 THEN 'medium' ELSE 'fast' END AS performance
  FROM runs)
"""


@query("run_classification", f"WITH {_CLASSIFIED_SQL} SELECT {_RUN_COLUMNS}, model_type, dataset_size, performance FROM classified")
def run_classification(spark, sf_dir):
    return runs.classify(run_records(spark, sf_dir)).select(
        *_RUN_COLUMNS.split(", "), "model_type", "dataset_size", "performance"
    )


@query("run_rollup", f"""WITH {_CLASSIFIED_SQL}, long AS (
  SELECT *, 'all' AS level, '' AS name FROM classified UNION ALL SELECT *, 'dataset', dataset FROM classified
  UNION ALL SELECT *, 'model', model FROM classified UNION ALL SELECT *, 'model_type', model_type FROM classified)
SELECT level, name, count(*) AS combinations, sum(embeddings_count)::BIGINT AS total_embeddings,
  CASE level WHEN 'dataset' THEN max(processed_tables) ELSE sum(processed_tables) END::BIGINT AS total_tables,
  round(avg(throughput_embeddings_per_sec), 4) AS avg_throughput, round(avg(encoding_inference_time_seconds), 4) AS avg_encoding_time,
  round(avg(indexing_time_seconds), 4) AS avg_indexing_time, round(sum(embeddings_size_mb), 4) AS total_storage_mb
FROM long GROUP BY level, name""")
def run_rollup(spark, sf_dir):
    return runs.rollup(runs.classify(run_records(spark, sf_dir)))


@query("model_averages", f"""WITH {RUNS_SQL}
SELECT model, count(DISTINCT dataset) AS datasets, sum(embeddings_count)::BIGINT AS total_embeddings,
  round(avg(throughput_embeddings_per_sec), 4) AS avg_throughput,
  round(sum(throughput_embeddings_per_sec * embeddings_count) / sum(embeddings_count), 4) AS weighted_throughput,
  round(avg(avg_time_per_embedding_ms), 4) AS avg_time_ms, round(avg(storage_per_1k_embeddings_mb), 4) AS avg_storage FROM runs GROUP BY model""")
def model_averages(spark, sf_dir):
    return runs.model_averages(run_records(spark, sf_dir))


_LATEST_SQL = f"""{RUNS_SQL}, latest AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY dataset, model ORDER BY timestamp_end DESC) = 1)
"""


def _register_nested(name: str, outer: str, inner: str) -> None:
    measures = ", ".join(f"{column} AS {shown}" for shown, column in runs.NESTED.items())

    @query(name, f"WITH {_LATEST_SQL} SELECT {outer}, {inner}, {measures} FROM latest")
    def run(spark, sf_dir):
        found = runs.nested(run_records(spark, sf_dir)).where(F.col("level") == outer)
        return found.select(F.col("name").alias(outer), F.explode("entries").alias(inner, "m")).select(outer, inner, "m.*")


_register_nested("runs_by_dataset", "dataset", "model")
_register_nested("runs_by_model", "model", "dataset")

_PIVOTS = {
    "pivot_throughput": "throughput_embeddings_per_sec",
    "pivot_encoding_time": "encoding_inference_time_seconds",
    "pivot_avg_time": "avg_time_per_embedding_ms",
    "pivot_index_size_mb": "embeddings_size_mb",
    "pivot_dimension": "embedding_dimension",
}


def _register_pivot(name: str, measure: str) -> None:
    cells = ", ".join(f"max(CASE WHEN model = '{m}' THEN {measure} END) AS {m}" for m in ALL_MODELS)

    @query(name, f"WITH {_LATEST_SQL} SELECT dataset, {cells} FROM latest GROUP BY 1")
    def run(spark, sf_dir):
        return runs.pivot(run_records(spark, sf_dir), measure, ALL_MODELS)


for _name, _measure in _PIVOTS.items():
    _register_pivot(_name, _measure)

_INVENTORY_SQL = f"""{RUNS_SQL},
named AS (SELECT collection, embeddings_count AS n FROM runs UNION ALL SELECT 'speed_Test', 1 FROM runs),
collections AS (SELECT collection, sum(n)::BIGINT AS embeddings, 64 AS dimension FROM named GROUP BY 1),
inventory AS (
  SELECT *, CASE WHEN contains(lower(collection), 'test') THEN 'test' ELSE split_part(collection, '_', 1) END AS dataset,
    CASE WHEN contains(lower(collection), 'test') THEN collection ELSE substr(collection, strpos(collection, '_') + 1) END AS model FROM collections)
"""


def _inventory(spark, sf_dir):
    records = run_records(spark, sf_dir)
    named = records.select("collection", F.col("embeddings_count").alias("n")).unionByName(
        records.select(F.lit("speed_Test").alias("collection"), F.lit(1).cast("bigint").alias("n"))
    )
    collections = named.groupBy("collection").agg(F.sum("n").alias("embeddings")).withColumn("dimension", F.lit(64))
    return runs.inventory(collections)


@query("collection_inventory", f"WITH {_INVENTORY_SQL} SELECT * FROM inventory")
def collection_inventory(spark, sf_dir):
    return _inventory(spark, sf_dir)


@query("collection_totals", f"""WITH {_INVENTORY_SQL} SELECT count(*) AS collections, sum(embeddings)::BIGINT AS embeddings,
  count(DISTINCT dataset) AS datasets, count(DISTINCT model) AS models FROM inventory""")
def collection_totals(spark, sf_dir):
    return runs.inventory_totals(_inventory(spark, sf_dir))


@query("progress_matrix", f"""WITH {_INVENTORY_SQL} SELECT dataset,
  {', '.join(f"coalesce(sum(CASE WHEN model = '{m}' THEN embeddings END), 0)::BIGINT AS {m}" for m in ALL_MODELS)}
FROM inventory WHERE dataset <> 'test' GROUP BY 1""")
def progress_matrix(spark, sf_dir):
    return runs.progress_matrix(_inventory(spark, sf_dir), ALL_MODELS)


@query("progress_completion", f"""WITH {_INVENTORY_SQL} SELECT count(*) AS completed, count(DISTINCT dataset) * {len(ALL_MODELS)} AS expected,
  round(100.0::DOUBLE * count(*) / (count(DISTINCT dataset) * {len(ALL_MODELS)}), 1) AS percent FROM inventory WHERE dataset <> 'test'""")
def progress_completion(spark, sf_dir):
    return runs.completion(_inventory(spark, sf_dir), len(ALL_MODELS))


@query("pending_runs", f"""WITH {RUNS_SQL}, m(model) AS (VALUES {', '.join(f"('{m}')" for m in ALL_MODELS)}),
grid AS (SELECT dataset, m.model FROM (SELECT DISTINCT 'ds' || (user_id % 5) AS dataset FROM events), m)
SELECT dataset, model, CASE WHEN model = 'supervised_v2' THEN 'skipped model'
  WHEN (dataset, model) IN (SELECT (dataset, model) FROM runs) THEN 'already completed' ELSE 'to run' END AS status FROM grid""")
def pending_runs(spark, sf_dir):
    datasets = table(spark, sf_dir, "events").select(
        F.concat(F.lit("ds"), (F.col("user_id") % 5).cast("string")).alias("dataset")
    )
    return runs.pending(datasets, ALL_MODELS, run_records(spark, sf_dir), skip=["supervised_v2"])


@query("load_status", """WITH found AS (
  SELECT n_name AS dataset, count(DISTINCT c_custkey) AS collections, count(*) AS documents
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1),
expected AS (SELECT n_name AS dataset FROM nation UNION SELECT r_name FROM region)
SELECT dataset, coalesce(collections, 0) AS collections, coalesce(documents, 0) AS documents, coalesce(documents, 0) > 0 AS loaded
FROM expected LEFT JOIN found USING (dataset)""")
def load_status(spark, sf_dir):
    """Nations and regions are expected as datasets; a customer's orders are one collection."""
    per_customer = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    nations = table(spark, sf_dir, "nation")
    documents = (
        table(spark, sf_dir, "customer").join(per_customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("dataset"), F.col("c_custkey").alias("collection"), "n")
    )
    expected = nations.select(F.col("n_name").alias("dataset")).unionByName(
        table(spark, sf_dir, "region").select(F.col("r_name").alias("dataset"))
    ).distinct()
    return runs.load_status(expected, documents)


@query("layout_profile", f"""WITH {DOCUMENTS_SQL}, mixed AS (
  SELECT lang AS collection, CASE WHEN lang = 'de' AND length(text) < 500 THEN NULL ELSE string_split(text, chr(10)) END AS lines FROM documents)
SELECT collection, count(*) AS documents, max(len(string_split(lines[1], ' ')))::INTEGER AS widest, count(lines) AS table_documents,
  CASE WHEN bool_and(lines IS NOT NULL) THEN 'table per document' ELSE 'flat' END AS layout FROM mixed GROUP BY 1""")
def layout_profile(spark, sf_dir):
    """Short German documents carry no table, so their collection counts as flat."""
    docs = document_corpus(spark, sf_dir)
    bare = (F.col("lang") == "de") & (F.length("text") < 500)
    mixed = docs.select(F.col("lang").alias("collection"), F.when(~bare, F.col("table")).alias("table"))
    return runs.layout_profile(mixed, "collection")


_RECONCILE_SQL = f"""WITH {DOCUMENTS_SQL},
a AS (SELECT database_name AS dataset, count(*) AS tables FROM docs GROUP BY 1),
b AS (SELECT database_name AS dataset, count(*) AS vectors FROM docs WHERE len("table") > 1 GROUP BY 1)
SELECT dataset, coalesce(tables, 0) AS tables, coalesce(vectors, 0) AS vectors, coalesce(tables, 0) = coalesce(vectors, 0) AS matches
FROM a FULL JOIN b USING (dataset)"""


@query("reconcile_counts", _RECONCILE_SQL)
def reconcile_counts(spark, sf_dir):
    """Documents of one line have no rows and were skipped by the index, so their sources differ."""
    docs = document_corpus(spark, sf_dir).withColumnRenamed("database_name", "dataset")
    return runs.reconcile(docs, docs.filter(F.size("table") > 1))
