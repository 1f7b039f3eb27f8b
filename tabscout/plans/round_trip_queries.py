"""Registered queries: what writers leave on disk, read back, and index jobs over every layout."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from tabscout.functions.vectors import hash_encode
from tabscout.plans import file_fixtures, index_job, pending_runs
from tabscout.plans.corpora import CORPUS_SQL, DOCUMENTS_SQL, ROW_LIMIT, SQL_VALUES, document_corpus, first_lines
from tabscout.plans.registry import query, table
from tabscout.plans.run_queries import RUNS_SQL, run_records
from tabscout.plans.vector_queries import sql_encode
from tabscout.plans.view_queries import line_documents, sniffed_documents
from tabscout.session import scratch_path
from tabscout.sources import queries as query_sets, registry, run_files, tables

# --- run files --------------------------------------------------------------------------------

_KEPT = (
    "dataset, model, collection, encoding_inference_time_seconds, indexing_time_seconds, embeddings_count, processed_tables, "
    "skipped_tables, embedding_dimension, embeddings_size_bytes, embeddings_size_mb, timestamp_start, timestamp_end, total_time_seconds, "
    "throughput_embeddings_per_sec, avg_time_per_embedding_ms, storage_per_1k_embeddings_mb"
)


@query("run_files", f"WITH {RUNS_SQL} SELECT {_KEPT} FROM runs")
def run_json(spark, sf_dir):
    """One JSON file per run, beside a summary that readers leave out."""
    path = scratch_path(spark, "runs")
    run_files.write_run_json(run_records(spark, sf_dir), path)
    return run_files.read_run_metrics(spark, path).select(*_KEPT.split(", "))


@query("run_report_file", f"""WITH {RUNS_SQL}
SELECT dataset, model, embeddings_count::VARCHAR AS embeddings_count, timestamp_end, NULL::VARCHAR AS gpu_available, NULL::VARCHAR AS model_path FROM runs""")
def run_report_file(spark, sf_dir):
    """The full report as CSV; columns that no run has stay empty."""
    path = scratch_path(spark, "report")
    run_files.write_report(run_records(spark, sf_dir), path)
    written = spark.read.option("header", "true").csv(path)
    assert written.columns == run_files.REPORT_COLUMNS
    return written.select("dataset", "model", "embeddings_count", "timestamp_end", "gpu_available", "model_path")


@query("epoch_log_files", """SELECT 'user' || user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts)::INTEGER AS epoch,
  value + 0.0 AS val_loss FROM events""")
def epoch_log_files(spark, sf_dir):
    """Epoch logs, a folder of CSV per run."""
    epoch = F.row_number().over(Window.partitionBy("user_id").orderBy("ts"))
    log = table(spark, sf_dir, "events").select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("run"), epoch.alias("epoch"), (F.col("value") + F.lit(0.0)).alias("val_loss"))
    path = scratch_path(spark, "epochs")
    run_files.write_epoch_log(log, path)
    return run_files.read_epoch_log(spark, path).select("run", "epoch", "val_loss")


# --- query sets -------------------------------------------------------------------------------

def _both(asked, relevant):
    """The texts of the queries and the relevant tables, as one list of values."""
    return asked.select(F.lit("query").alias("kind"), F.col("query").alias("value")).unionByName(
        relevant.select(F.lit("table").alias("kind"), F.col("table_id").alias("value")))


@query("statement_files", """SELECT 'query' AS kind, 'says ' || n_chars AS value FROM documents
UNION ALL SELECT 'table', source || '_' || doc_id FROM documents""")
def statement_files(spark, sf_dir):
    """Labelled statements as JSONL."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("says "), F.col("n_chars").cast("string")).alias("statement"),
        F.concat_ws("_", "source", "doc_id").alias("table_id"))
    path = scratch_path(spark, "statements")
    docs.write.json(path)
    return _both(*query_sets.read_statements(spark, path))


@query("query_files", """SELECT 'query' AS kind, 'item ' || item_id AS value FROM benchmark
UNION ALL SELECT 'table', 'bench_' || item_id FROM benchmark""")
def query_files(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("query"),
        F.concat(F.lit("bench_"), F.col("item_id").cast("string")).alias("table_id"))
    path = scratch_path(spark, "queries")
    items.write.parquet(path)
    return _both(*query_sets.read_query_parquet(spark, path))


@query("schema_question_files", """SELECT 'query' AS kind, 'about ' || item_id AS value FROM benchmark
UNION ALL SELECT 'table', 'db' || item_id % 7 || '::' || t FROM (SELECT item_id, unnest(['a', 'b' || item_id % 3]) AS t FROM benchmark)""")
def schema_question_files(spark, sf_dir):
    """Enriched questions with their gold tables."""
    key = F.col("item_id")
    items = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("about "), key.cast("string")).alias("question"), F.concat(F.lit("db"), (key % 7).cast("string")).alias("db_id"),
        F.array(F.lit("a"), F.concat(F.lit("b"), (key % 3).cast("string")), F.lit("a")).alias("gold_tables"))
    path = scratch_path(spark, "questions")
    items.write.parquet(path)
    return _both(*query_sets.read_schema_queries(spark, path))


@query("benchmark_query_files", """SELECT 'q' || item_id AS query_id, 'item ' || item_id AS query, 'made' AS benchmark, t AS table_id
FROM (SELECT item_id, unnest(['x' || item_id, 'y']) AS t FROM benchmark)""")
def benchmark_query_files(spark, sf_dir):
    key = F.col("item_id").cast("string")
    path = scratch_path(spark, "benchmark")
    table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("q"), key).alias("query_id"), F.concat(F.lit("item "), key).alias("query"),
        F.array(F.concat(F.lit("x"), key), F.lit("y"), F.lit("y")).alias("relevant_tables"), F.lit("made").alias("benchmark"),
    ).write.json(path)
    asked, relevant = query_sets.read_benchmark_queries(spark, path)
    return asked.join(relevant, "query_id").select("query_id", "query", "benchmark", "table_id")


# --- corpora ----------------------------------------------------------------------------------

@query("validation_files", f"""WITH {DOCUMENTS_SQL}
SELECT 'set_v1_validation' AS collection, table_id, array_to_string("table"[1], ' ') AS header FROM docs""")
def validation_files(spark, sf_dir):
    """A validation.parquet in each of several folders; bytes come back as text."""
    root = scratch_path(spark, "validation")
    docs = document_corpus(spark, sf_dir).select("table_id", F.encode(F.array_join(F.get("table", 0), " "), "UTF-8").alias("header"))
    staged = f"{root}/staged"
    docs.write.parquet(staged)
    jvm = spark.sparkContext._jvm
    at = lambda name: jvm.org.apache.hadoop.fs.Path(name)
    fs = at(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [f.getPath() for f in fs.listStatus(at(staged)) if f.getPath().getName().endswith(".parquet")]
    for n, part in enumerate(parts):
        fs.mkdirs(at(f"{root}/sets/set-v1.{n}"))
        fs.rename(part, at(f"{root}/sets/set-v1.{n}/validation.parquet"))
    name = F.regexp_replace("collection", "_[0-9]+_validation$", "_validation")
    return tables.read_validation(spark, f"{root}/sets").select(name.alias("collection"), "table_id", "header")


@query("schema_databases", "SELECT 'db' || user_id AS db_id, count(*)::INTEGER AS n_tables FROM events GROUP BY user_id")
def schema_databases(spark, sf_dir):
    """Schema entries as JSON, one row per database."""
    path = scratch_path(spark, "schemas")
    table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.col("ts").cast("string"))).alias("table_names")).select(
        F.concat(F.lit("db"), F.col("user_id").cast("string")).alias("db_id"), "table_names",
    ).write.option("maxRecordsPerFile", 1).json(path)
    return tables.read_schema_json(spark, path).select("db_id", F.size("table_names").alias("n_tables"))


@query("load_summary", f"""WITH {CORPUS_SQL}
SELECT 'json' AS dataset, (SELECT count(*) FROM corpus WHERE len(rows) > 0) AS documents
UNION ALL SELECT 'archives', (SELECT count(*) FROM corpus)""")
def load_summary(spark, sf_dir):
    """Documents per dataset, each through the reader its format names."""
    return registry.load_summary(spark, [
        registry.Dataset("json", file_fixtures.jsonl_tables(spark, sf_dir), "jsonl_tables"),
        registry.Dataset("archives", file_fixtures.archived_tables(spark, sf_dir), "archive_tables_json"),
    ])


# --- index jobs -------------------------------------------------------------------------------

def _cells(points):
    cell = lambda i: F.round(F.get("embedding", i).cast("double"), 5) + F.lit(0.0)
    return points.select("point_id", "db_name", "table_name", "num_rows", cell(0).alias("e1"), cell(63).alias("e64"))


def _points_sql(shown: str) -> str:
    """SQL of points from a CTE ``shown``(db_name, table_name, num_rows, txt)."""
    return f"""{shown}, {sql_encode('shown', 'table_name', 'txt', 'vec')}
SELECT md5(db_name || '_' || table_name) AS point_id, db_name, table_name, num_rows, round(embedding[1]::FLOAT::DOUBLE, 5) + 0.0 AS e1,
  round(embedding[64]::FLOAT::DOUBLE, 5) + 0.0 AS e64 FROM shown JOIN vec USING (table_name)"""


@query("index_job_simple", _points_sql(f"""WITH {DOCUMENTS_SQL}, shown AS (
  SELECT database_name AS db_name, table_id AS table_name, (len("table") - 1)::BIGINT AS num_rows,
    '[TABLE] ' || table_id || ' [SCHEMA] ' || array_to_string("table"[1], ', ') || ' [ROWS] '
    || {SQL_VALUES.format(rows='"table"[2:6]', cell=' | ', row=' ')} AS txt FROM docs WHERE len("table") > 1)"""))
def index_job_simple(spark, sf_dir):
    return _cells(index_job.points(document_corpus(spark, sf_dir), "documents", "hashed", simple=True))


@query("index_job_long", _points_sql(f"""WITH {CORPUS_SQL}, sizes AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
shown AS (
  SELECT 'lines' AS db_name, 'order_' || l_orderkey AS table_name, any_value(n) AS num_rows,
    '[TABLE]order_' || l_orderkey || ' [SCHEMA]l_returnflag,l_linestatus,l_partkey [ROWS]'
    || array_to_string(list(l_returnflag || ',' || l_linestatus || ',' || l_partkey ORDER BY line), '|') AS txt
  FROM ordered_lines JOIN sizes USING (l_orderkey) WHERE line <= {ROW_LIMIT} GROUP BY l_orderkey)"""))
def index_job_long(spark, sf_dir):
    """One document per row of a table."""
    lines = line_documents(first_lines(spark, sf_dir, 1 << 30))
    return _cells(index_job.any_points(lines, "lines", "lines", "hashed"))


@query("index_job_sniffed", _points_sql(f"""WITH {CORPUS_SQL}, t AS (
  SELECT *, CASE columns[3] WHEN 'l_tax' THEN 'P' ELSE columns[4] END AS layout FROM corpus),
u AS (SELECT *, CASE WHEN len(rows) = 0 OR layout = 'P' THEN '' ELSE {SQL_VALUES.format(rows='rows', cell=',', row='|')} END AS body,
      database_name || ',' || num_rows_total || ',' || filepath AS own FROM t),
shown AS (
  SELECT database_name AS db_name, table_name, (CASE WHEN layout = 'P' THEN 0 ELSE len(rows) END)::BIGINT AS num_rows,
    '[TABLE]' || table_name || ' [SCHEMA]' || CASE WHEN layout = 'P' THEN 'table_id,database,num_rows,file' ELSE array_to_string(columns, ',') END
    || ' [ROWS]' || CASE WHEN body = '' THEN own ELSE body END AS txt FROM u)"""))
def index_job_sniffed(spark, sf_dir):
    """Documents of mixed layouts in one collection."""
    return _cells(index_job.any_points(sniffed_documents(spark, sf_dir), "", "orders", "hashed"))


@query("run_totals_file", f"""WITH {RUNS_SQL}
SELECT dataset, model, sum(embeddings_count)::BIGINT AS embeddings, count(*) AS runs FROM runs GROUP BY dataset, model""")
def run_totals_file(spark, sf_dir):
    """Totals per dataset and model, from run files instead of a table."""
    path = scratch_path(spark, "runs")
    run_files.write_run_json(run_records(spark, sf_dir), path)
    return run_files.read_run_metrics(spark, path).groupBy("dataset", "model").agg(
        F.sum("embeddings_count").alias("embeddings"), F.count(F.lit(1)).alias("runs"))


# --- pending combinations ---------------------------------------------------------------------

_DIMENSIONS = {"hashed": 64, "hashed_half": 32}
_COMBOS_SQL = f"""WITH {DOCUMENTS_SQL}, grid AS (
  SELECT d.dataset, m.model, m.dim FROM (SELECT DISTINCT 'docs-' || lang AS dataset FROM docs) d,
    (VALUES {', '.join(f"('{m}', {d})" for m, d in _DIMENSIONS.items())}, ('broken', 0), ('left_out', 0)) m(model, dim)),
combos AS (
  SELECT g.dataset, g.model, CASE g.model WHEN 'left_out' THEN 'skipped model' WHEN 'broken' THEN 'failed' ELSE 'done' END AS state,
    CASE g.model WHEN 'left_out' THEN 0 WHEN 'broken' THEN 2 ELSE 1 END AS attempts,
    CASE WHEN dim > 0 THEN count(CASE WHEN len("table") > 1 THEN 1 END) END AS embeddings_count,
    CASE WHEN dim > 0 THEN count(CASE WHEN len("table") <= 1 THEN 1 END) END AS skipped_tables,
    CASE WHEN dim > 0 THEN dim END AS embedding_dimension
  FROM grid g JOIN docs ON g.dataset = 'docs-' || lang GROUP BY g.dataset, g.model, dim)
"""


def _combinations(spark, sf_dir):
    """Two jobs over all languages and models; one model always fails, one is skipped."""
    docs = document_corpus(spark, sf_dir)
    languages = sorted(r.lang for r in docs.select("lang").distinct().collect())  # a handful of languages
    sets = {f"docs-{lang}": docs.where(F.col("lang") == lang) for lang in languages}
    models = {name: (lambda text, d=dim: hash_encode(text, d)) for name, dim in _DIMENSIONS.items()}
    models["broken"] = lambda text: F.array(F.raise_error(F.concat(F.lit("no encoder for "), F.left(text, F.lit(1)))).cast("float"))
    models["left_out"] = hash_encode
    ledger, path = scratch_path(spark, "ledger"), scratch_path(spark, "vectors")
    for job in ("first", "second"):
        pending_runs.run_pending(spark, ledger, sets, models, path, skip=["left_out"], job=job)
    return pending_runs.combinations(spark, ledger, list(sets), list(models), ["left_out"])


@query("pending_combinations", _COMBOS_SQL + "SELECT * FROM combos")
def pending_combinations(spark, sf_dir):
    """The state of every combination after two jobs: the second one only tries again what failed."""
    return _combinations(spark, sf_dir).drop("reason")


@query("pipeline_summary", _COMBOS_SQL + """
SELECT count(*) AS total_combinations, count(*) FILTER (state = 'done') AS completed, count(*) FILTER (state <> 'done') AS failed,
  sum(embeddings_count)::BIGINT AS embeddings FROM combos WHERE state <> 'skipped model'""")
def pipeline_summary(spark, sf_dir):
    """The summary of all combinations, written as a file and read back."""
    path = scratch_path(spark, "summary")
    pending_runs.write_summary(_combinations(spark, sf_dir), path)
    return spark.read.json(path).select("total_combinations", "completed", "failed", "embeddings")
