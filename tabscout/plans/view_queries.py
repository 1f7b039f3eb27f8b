"""Registered queries: table views, names and ids."""
from __future__ import annotations

from pyspark.sql import functions as F

from tabscout.functions import hashing, names, views
from tabscout.plans.corpora import (
    CORPUS_SQL, DOCUMENTS_SQL, ROW_LIMIT, SQL_FULL, SQL_KEYVALUE, SQL_ROW, SQL_SCHEMA,
    SQL_SIMPLE, SQL_VALUES, document_corpus, first_lines, order_corpus,
)
from tabscout.plans.registry import query, table

_ID = ("database_name", "table_name")


def _view_sql(text: str) -> str:
    return f"WITH {CORPUS_SQL} SELECT database_name, table_name, {text} AS text FROM corpus"


def _register_view(name: str, view: str, sql: str) -> None:
    @query(name, _view_sql(sql))
    def run(spark, sf_dir):
        return order_corpus(spark, sf_dir).select(*_ID, views.serialize(view).alias("text"))


_register_view("view_schema", "schema", SQL_SCHEMA)
_register_view("view_row", "row", SQL_ROW)
_register_view("view_full", "full", SQL_FULL)
_register_view("view_simple", "simple", SQL_SIMPLE)


@query("view_keyvalue", f"""WITH {CORPUS_SQL}, t AS (SELECT *, {SQL_KEYVALUE} AS text FROM corpus)
SELECT database_name, table_name, text, left(text, 1000) AS preview FROM t""")
def view_keyvalue(spark, sf_dir):
    text = views.serialize("keyvalue")
    return order_corpus(spark, sf_dir).select(
        *_ID, text.alias("text"), F.left(text, F.lit(1000)).alias("preview")
    )


@query("view_fanout", f"""WITH {CORPUS_SQL}
SELECT database_name, table_name, 'full' AS view, {SQL_FULL} AS text FROM corpus
UNION ALL SELECT database_name, table_name, 'schema', {SQL_SCHEMA} FROM corpus""")
def view_fanout(spark, sf_dir):
    return views.fan_out(order_corpus(spark, sf_dir), ["full", "schema"])


@query("view_combined_doc", f"""WITH {DOCUMENTS_SQL}
SELECT database_name, table_id, '[TABLE]' || table_id || ' [SCHEMA]' || array_to_string("table"[1], ',')
  || ' [ROWS]' || {SQL_VALUES.format(rows='"table"[2:4]', cell=',', row='|')} AS text FROM docs""")
def view_combined_doc(spark, sf_dir):
    text = views.document_view("table_id", F.get("table", 0), F.slice("table", 2, ROW_LIMIT))
    return document_corpus(spark, sf_dir).select("database_name", "table_id", text.alias("text"))


@query("view_combined_long", f"""WITH {CORPUS_SQL}, long AS (
  SELECT 'order_' || l_orderkey AS table_name,
         array_to_string(list('l_returnflag,l_linestatus,l_partkey' ORDER BY line)[1:1], '') AS header,
         array_to_string(list(l_returnflag || ',' || l_linestatus || ',' || l_partkey ORDER BY line), '|') AS body
  FROM ordered_lines WHERE line <= {ROW_LIMIT} GROUP BY l_orderkey)
SELECT table_name, '[TABLE]' || table_name || ' [SCHEMA]' || header || ' [ROWS]' || body AS text FROM long""")
def view_combined_long(spark, sf_dir):
    """One document per row: the schema is the first document's keys, the rows the first documents."""
    return views.long_documents(line_documents(first_lines(spark, sf_dir))).select(
        "table_name", views.document_view("table_name", "columns", "rows").alias("text")
    )


def line_documents(lines):
    return lines.select(
        F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")).alias("table_name"), "line",
        F.create_map(*[
            x for c in ("l_returnflag", "l_linestatus", "l_partkey")
            for x in (F.lit(c), F.col(c).cast("string"))
        ]).alias("cells"),
    )


@query("view_combined_sniffed", f"""WITH {CORPUS_SQL}, t AS (
  SELECT *, left(datatype_text, 0) || CASE columns[3] WHEN 'l_tax' THEN 'P' ELSE columns[4] END AS layout
  FROM (SELECT *, array_to_string(column_datatypes, ',') AS datatype_text FROM corpus)),
u AS (SELECT *, CASE WHEN len(rows) = 0 OR layout = 'P' THEN '' ELSE {SQL_VALUES.format(rows='rows', cell=',', row='|')} END AS body,
      database_name || ',' || num_rows_total || ',' || filepath AS own FROM t)
SELECT database_name, table_name,
  '[TABLE]' || table_name || ' [SCHEMA]' || CASE WHEN layout = 'P' THEN 'table_id,database,num_rows,file'
     ELSE array_to_string(columns, ',') END
  || ' [ROWS]' || CASE WHEN body = '' THEN own ELSE body END AS text
FROM u""")
def view_combined_sniffed(spark, sf_dir):
    return sniffed_documents(spark, sf_dir).select(
        *_ID,
        views.sniffed_view("table_name", "column_names", "header", "rows", "row_data", "fields").alias("text"),
    )


def sniffed_documents(spark, sf_dir):
    """Three layouts in one collection: name pairs + rows, header + row_data, bare document."""
    corpus = order_corpus(spark, sf_dir)
    layout = F.col("columns")[F.size("columns") - 1]
    pairs = F.transform("columns", lambda c, i: F.array(i.cast("string"), c))
    fields = F.map_from_arrays(
        F.array(*[F.lit(x) for x in ("table_id", "database", "num_rows", "file")]),
        F.array("table_name", "database_name", F.col("num_rows_total").cast("string"), "filepath"),
    )
    return corpus.select(
        *_ID,
        F.when(layout == "l_returnflag", pairs).alias("column_names"),
        F.when(layout == "l_linestatus", F.col("columns")).alias("header"),
        F.when(layout == "l_returnflag", F.col("rows")).alias("rows"),
        F.when(layout == "l_linestatus", F.col("rows")).alias("row_data"),
        fields.alias("fields"),
    )


@query("point_ids", f"""WITH {CORPUS_SQL}
SELECT database_name, table_name, md5(database_name || '_' || table_name) AS point_id FROM corpus""")
def point_ids(spark, sf_dir):
    return order_corpus(spark, sf_dir).select(
        *_ID, hashing.point_id(F.col("database_name"), F.col("table_name")).alias("point_id")
    )


@query("content_ids", f"""WITH {CORPUS_SQL}
SELECT database_name, table_name,
  (('0x' || substr(md5(database_name || '::' || table_name || '::' || {SQL_FULL}), 1, 16))::UBIGINT)::VARCHAR AS content_id
FROM corpus""")
def content_ids(spark, sf_dir):
    return order_corpus(spark, sf_dir).select(
        *_ID,
        hashing.content_id(F.col("database_name"), F.col("table_name"), views.serialize("full")).alias("content_id"),
    )


_SQL_KEY = "lower(replace(replace(trim({x}), ',', ''), ' ', '_'))"


@query("normalised_names", f"""WITH k AS (SELECT p_partkey, p_name, p_type,
  {_SQL_KEY.format(x="p_name || ', ' || p_type || ' '")} AS plain FROM part)
SELECT p_partkey, CASE WHEN starts_with(plain, '_') THEN plain ELSE '_' || plain END AS table_key,
  replace(lower(trim(' ' || p_type)), ' ', '_') AS fk_key,
  translate(p_name || '_' || p_type || '-v1.0', '-.', '__') AS collection FROM k""")
def normalised_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        names.table_key(F.concat("p_name", F.lit(", "), "p_type", F.lit(" "))).alias("table_key"),
        names.fk_key(F.concat(F.lit(" "), "p_type")).alias("fk_key"),
        names.collection_name(F.col("p_name"), F.concat("p_type", F.lit("-v1.0"))).alias("collection"),
    )


@query("nonempty_tables", f"""WITH {CORPUS_SQL}
SELECT database_name, table_name, num_rows_total FROM corpus WHERE len(rows) > 0""")
def nonempty_tables(spark, sf_dir):
    return order_corpus(spark, sf_dir).filter(F.size("rows") > 0).select(*_ID, "num_rows_total")
