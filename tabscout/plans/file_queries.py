"""Registered queries: readers, writers, the index job and the stream.

Files are first written from the given tables to the shared folder, then read back.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from tabscout.functions import views
from tabscout.functions.hashing import h
from tabscout.plans import file_fixtures, index_job
from tabscout.plans.corpora import CORPUS_SQL, DOCUMENTS_SQL, SQL_VALUES, document_corpus, order_corpus
from tabscout.plans.registry import query, sql_h, table
from tabscout.plans.vector_queries import sql_encode
from tabscout.session import scratch_path, written
from tabscout.sources import archive, files, folders, queries as query_sets, store, tables, upserts
from tabscout.streaming.vectors import ingest_vectors

_NATION_SQL = f"""
heads AS (SELECT *, min(c_custkey) OVER (PARTITION BY database_name) AS first_key FROM (
  SELECT n_name || '_' || c_custkey // {file_fixtures.DATABASE_TABLES} AS database_name, c_custkey, c_mktsegment
  FROM customer JOIN nation ON n_nationkey = c_nationkey)),
placed AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders),
stats AS (
  SELECT o_custkey, count(*) AS n, list([o_orderkey::VARCHAR, o_orderstatus, o_totalprice::DECIMAL(18,2)::VARCHAR, o_orderpriority]
    ORDER BY place) FILTER (WHERE place <= 3) AS rows FROM placed GROUP BY 1)
"""


@query("corpus_databases", f"WITH {_NATION_SQL} SELECT DISTINCT database_name FROM heads")
def corpus_databases(spark, sf_dir):
    return folders.databases(spark, file_fixtures.nation_folders(spark, sf_dir))


@query("corpus_tables", f"""WITH {_NATION_SQL}, t AS (
  SELECT database_name, 'Customer ' || c_custkey AS table_name, coalesce(rows, []) AS rows, 'customer_' || c_custkey || '.csv' AS filepath,
    CASE WHEN c_mktsegment = 'BUILDING' THEN len(coalesce(rows, [])) ELSE coalesce(n, 0) END::BIGINT AS num_rows_total,
    'Customer ' || first_key AS reference_table FROM heads LEFT JOIN stats ON o_custkey = c_custkey)
SELECT database_name, table_name, '[DB]' || database_name || ' [TABLE]' || table_name || ' [SCHEMA]o_orderkey,o_orderstatus,o_totalprice,o_orderpriority [ROWS]'
  || {SQL_VALUES.format(rows='rows', cell=',', row='|')} AS text, filepath, num_rows_total, reference_table, 'bigint,string,decimal,string' AS datatypes FROM t""")
def corpus_tables(spark, sf_dir):
    corpus = folders.read_folders(spark, file_fixtures.nation_folders(spark, sf_dir))
    return corpus.select(
        "database_name", "table_name", views.serialize("full").alias("text"), "filepath", "num_rows_total",
        F.get("foreign_keys", 0)["reference_table"].alias("reference_table"),
        F.array_join("column_datatypes", ",").alias("datatypes"),
    )


@query("folder_collections", f"""WITH {_NATION_SQL}
SELECT database_name || '__customer_' || c_custkey AS collection, place - 1 AS row_idx, o_orderkey::VARCHAR AS o_orderkey,
  o_totalprice::DECIMAL(18,2)::VARCHAR AS o_totalprice FROM placed JOIN heads ON o_custkey = c_custkey""")
def folder_collections(spark, sf_dir):
    """Every row of every CSV, long form."""
    return folders.csv_rows(spark, file_fixtures.nation_folders(spark, sf_dir)).select(
        "collection", "row_idx", F.col("cells")["o_orderkey"].alias("o_orderkey"), F.col("cells")["o_totalprice"].alias("o_totalprice")
    )


@query("fk_catalogue", f"""WITH {_NATION_SQL}
SELECT database_name AS database, '_customer_' || c_custkey AS source_table, '_customer_' || first_key AS destination_table,
  'o_orderkey' AS foreign_key FROM heads""")
def fk_catalogue(spark, sf_dir):
    return folders.fk_catalogue(spark, file_fixtures.nation_folders(spark, sf_dir))


@query("table_catalogue", f"""WITH {_NATION_SQL}
SELECT database_name AS database, '_customer_' || c_custkey AS "table" FROM heads""")
def table_catalogue(spark, sf_dir):
    return folders.table_catalogue(spark, file_fixtures.nation_folders(spark, sf_dir))


_JSON_TABLES_SQL = f"""WITH {CORPUS_SQL}, t AS (
  SELECT table_name AS table_id, array_to_string(columns, ',') AS header, columns[-1] = 'l_linestatus' AS short, rows FROM corpus WHERE len(rows) > 0)
"""


def _tables_out(normalised):
    return normalised.select(
        "table_id", "collection", F.array_join("header", ",").alias("header"),
        F.array_join(F.transform("rows", lambda r: F.array_join(r, ",", "null")), "|").alias("rows"),
    )


_JSON_OUT_SQL = """SELECT table_id, 'json_db_' || table_id AS collection, header,
  array_to_string(list_transform(rows, lambda r: CASE WHEN short THEN array_to_string(r[1:-2], ',') || ',null' ELSE array_to_string(r, ',') END), '|') AS rows FROM t"""


@query("tables_json_normalised", _JSON_TABLES_SQL + _JSON_OUT_SQL)
def tables_json_normalised(spark, sf_dir):
    records = files.jsonl_records(spark, file_fixtures.jsonl_tables(spark, sf_dir))
    return _tables_out(tables.normalise_tables(records, "json-db"))


@query("archive_tables", _JSON_TABLES_SQL + _JSON_OUT_SQL)
def archive_tables(spark, sf_dir):
    records = archive.read_archive_format(spark, file_fixtures.archived_tables(spark, sf_dir), "tables_json")
    return _tables_out(tables.normalise_tables(records, "json-db"))


@query("tables_json_with_ids", f"""WITH {CORPUS_SQL}, placed AS (
  SELECT table_name, columns[-1] = 'l_returnflag' AS own,
    {sql_h('table_name', "'archive'")} % (SELECT (count(*) + {file_fixtures.ARCHIVE_RECORDS - 1}) // {file_fixtures.ARCHIVE_RECORDS} FROM orders) AS archive FROM corpus),
numbered AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY table_name) - 1 AS place FROM placed)
SELECT 'part-' || archive || '.tar.gz' AS archive, table_name AS name, CASE WHEN own THEN table_name ELSE 'db_table_' || place END AS table_id
FROM numbered""")
def tables_json_with_ids(spark, sf_dir):
    """Ids by the place in the archive where a record has none, beside the record's own name."""
    records = archive.read_archive_format(spark, file_fixtures.archived_tables(spark, sf_dir), "tables_json")
    name = F.coalesce(*[F.get_json_object("record", f"$.{key}") for key in ("table_id", "id", "name")])
    return tables.identify_tables(records, "db").select(
        F.regexp_extract("archive", "([^/]+)$", 1).alias("archive"), name.alias("name"), "table_id")


_SPLITS = ("train", "validation", "test")


@query("corpus_splits", f"""WITH {DOCUMENTS_SQL}
SELECT 'corpus_' || ['train', 'validation', 'test'][1 + {sql_h('table_id')} % 3] AS collection, table_id,
  array_to_string("table"[1], ' ') AS header, len("table")::INTEGER AS n_rows FROM docs""")
def corpus_splits(spark, sf_dir):
    root = scratch_path(spark, "splits")
    docs = document_corpus(spark, sf_dir).select("table_id", "table", (h(F.col("table_id")) % 3).alias("part"))
    for i, split in enumerate(_SPLITS):
        docs.filter(F.col("part") == i).drop("part").write.parquet(f"{root}/corpus/{split}.parquet")
    return tables.read_corpus_splits(spark, root).select(
        "collection", "table_id", F.array_join(F.get("table", 0), " ").alias("header"), F.size("table").alias("n_rows")
    )


@query("schema_explode", """WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
SELECT 'db' || doc_id AS database_id, 'db' || doc_id || '::line' || i AS table_id, 'Line ' || i AS table_name,
  array_to_string(list_filter(string_split(line, ' '), lambda w: w <> ''), ',') AS header,
  len(list_filter(string_split(line, ' '), lambda w: w <> ''))::INTEGER AS n_columns FROM lines WHERE trim(line) <> ''""")
def schema_explode(spark, sf_dir):
    """Schema entries: each document a database, each line a table, each word a column."""
    lines = F.split("text", "\n", -1)
    pairs = F.flatten(F.transform(lines, lambda s, i: F.transform(
        F.filter(F.split(s, " ", -1), lambda w: w != ""), lambda w: F.array(i.cast("string"), w)
    )))
    entries = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("db"), F.col("doc_id").cast("string")).alias("db_id"),
        F.transform(lines, lambda s, i: F.concat(F.lit("Line "), i.cast("string"))).alias("table_names"),
        F.transform(lines, lambda s, i: F.concat(F.lit("line"), i.cast("string"))).alias("table_names_original"),
        F.array().cast("array<array<string>>").alias("column_names"),
        F.concat(F.array(F.array(F.lit("-1"), F.lit("*"))), pairs).alias("column_names_original"),
        F.array().cast("array<string>").alias("column_types"), F.array().cast("array<string>").alias("primary_keys"),
        F.array().cast("array<array<int>>").alias("foreign_keys"),
    )
    return tables.schema_documents(entries).select(
        "database_id", "table_id", "table_name", F.array_join(F.get("table", 0), ",").alias("header"),
        F.size(F.get("table", 0)).alias("n_columns"),
    )


@query("qrels_explode", f"""WITH {CORPUS_SQL}
SELECT DISTINCT table_name AS query_id, database_name || '::' || t AS table_id FROM (SELECT database_name, table_name, unnest(fks) AS t FROM corpus)""")
def qrels_explode(spark, sf_dir):
    enriched = order_corpus(spark, sf_dir).select(
        F.col("table_name").alias("query_id"), F.col("database_name").alias("db_id"),
        F.transform("foreign_keys", lambda k: k["reference_table"]).alias("gold_tables"),
    )
    return query_sets.gold_tables(enriched)


# --- vectors ----------------------------------------------------------------------------------

_POINTS_SQL = f"""{DOCUMENTS_SQL},
kept AS (SELECT *, '[TABLE]' || table_id || ' [SCHEMA]' || array_to_string("table"[1], ',') || ' [ROWS]' || {SQL_VALUES.format(rows='"table"[2:4]', cell=',', row='|')} AS shown
  FROM docs WHERE len("table") > 1),
{sql_encode('kept', 'table_id', 'shown', 'vec')},
points AS (SELECT md5(database_name || '_' || table_id) AS point_id, database_name AS db_name, table_id AS table_name,
  (len("table") - 1)::BIGINT AS num_rows, round(embedding[1]::FLOAT::DOUBLE, 5) + 0.0 AS e1, round(embedding[64]::FLOAT::DOUBLE, 5) + 0.0 AS e64
  FROM kept JOIN vec USING (table_id))
"""
_POINT_COLUMNS = ["point_id", "db_name", "table_name", "num_rows"]


def _shown(points):
    cell = lambda i: F.round(F.get("embedding", i).cast("double"), 5) + F.lit(0.0)
    return points.select(*_POINT_COLUMNS, cell(0).alias("e1"), cell(63).alias("e64"))


@query("index_job", f"WITH {_POINTS_SQL} SELECT point_id, db_name, table_name, num_rows, e1, e64 FROM points")
def index_points(spark, sf_dir):
    """Documents with rows, serialized, encoded, written as a collection and read back."""
    path = scratch_path(spark, "vectors")
    made = index_job.points(document_corpus(spark, sf_dir), "documents", "hashed")
    store.overwrite_collections(made, path)
    return _shown(store.read_vectors(spark, path))


@query("index_run_record", f"""WITH {_POINTS_SQL}
SELECT 'documents' AS dataset, 'hashed' AS model, count(*) AS embeddings_count, 64 AS embedding_dimension,
  (SELECT count(*) FROM docs) - count(*) AS skipped_tables, count(*) * 256 AS embeddings_size_bytes,
  round(count(*) * 256 / 1048576, 4) AS embeddings_size_mb FROM points""")
def index_run_record(spark, sf_dir):
    docs = document_corpus(spark, sf_dir)
    record = index_job.build_index(docs, "documents", "hashed", scratch_path(spark, "vectors"))
    return record.select(
        "dataset", "model", "embeddings_count", "embedding_dimension", "skipped_tables", "embeddings_size_bytes", "embeddings_size_mb"
    )


@query("vector_upsert", f"WITH {_POINTS_SQL} SELECT point_id, db_name, table_name, num_rows + 1000 AS num_rows, e1, e64 FROM points")
def vector_upsert(spark, sf_dir):
    """Each point is given twice; the later one, with another number of rows, wins."""
    made = index_job.points(document_corpus(spark, sf_dir), "documents", "hashed")
    twice = made.withColumn("seq", F.lit(1)).unionByName(
        made.withColumn("num_rows", F.col("num_rows") + 1000).withColumn("seq", F.lit(2))
    )
    path = scratch_path(spark, "vectors")
    store.write_vectors(twice, path, "seq")
    return _shown(store.read_vectors(spark, path))


@query("incremental_upsert", f"WITH {_POINTS_SQL} SELECT point_id, db_name, table_name, num_rows, e1, e64 FROM points")
def incremental_upsert(spark, sf_dir):
    """English documents first, then all of them: stored ids are skipped."""
    docs = document_corpus(spark, sf_dir)
    path = scratch_path(spark, "vectors")
    for batch in (docs.filter(F.col("lang") == "en"), docs):
        store.append_new(index_job.points(batch, "documents", "hashed"), path)
    return _shown(store.read_vectors(spark, path))


@query("bucketed_upsert", f"WITH {_POINTS_SQL} SELECT point_id, db_name, table_name, num_rows, e1, e64 FROM points")
def bucketed_upsert(spark, sf_dir):
    """Two overlapping appends, the second one committed while the first is still being written."""
    docs = document_corpus(spark, sf_dir)
    path = scratch_path(spark, "vectors")
    made = written(index_job.points(docs, "documents", "hashed"), "points")
    english = made.join(docs.where("lang = 'en'").select(F.col("table_id").alias("table_name")), "table_name", "left_semi")
    upserts.append(made, path, before_commit=lambda: upserts.append(english, path))
    return _shown(upserts.read(spark, path))


@query("stream_upsert", f"WITH {_POINTS_SQL} SELECT point_id, db_name, table_name, num_rows, e1, e64 FROM points")
def stream_upsert(spark, sf_dir):
    """The same through a file stream, run twice over overlapping files."""
    docs = document_corpus(spark, sf_dir)
    incoming, path, progress = (scratch_path(spark, n) for n in ("incoming", "vectors", "progress"))
    for batch in (docs.filter(F.col("lang") == "en"), docs):
        index_job.points(batch, "documents", "hashed").write.mode("append").parquet(incoming)
        ingest_vectors(spark, incoming, path, progress).awaitTermination()
    return _shown(store.read_vectors(spark, path))
