"""Corpora derived from the given tables.

Order corpus: each customer is a database, each order a table, its lines the rows. The order's
status decides which line columns the table has. Every table refers to the first order of its
database (so that one references itself), urgent ones to the last order too; references of
low-priority tables dangle.

Document corpus: each source is a database, each document a table, its text lines the rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabscout.plans.registry import table
from tabscout.session import written

ROW_LIMIT = 3

# order status -> (column, datatype) of the derived tables
LAYOUTS = {
    "F": [("l_linenumber", "int"), ("l_partkey", "bigint"), ("l_quantity", "decimal"), ("l_returnflag", "string")],
    "O": [("l_linenumber", "int"), ("l_suppkey", "bigint"), ("l_quantity", "decimal"), ("l_linestatus", "string")],
    "P": [("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_tax", "decimal")],
}
_DECIMALS = {"l_quantity", "l_tax"}
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def _text(column: str) -> Column:
    c = F.col(column)
    return (c.cast("decimal(18,2)") if column in _DECIMALS else c).cast("string")


def _by_status(status: Column, value) -> Column:
    out = None
    for key, layout in LAYOUTS.items():
        v = F.array(*[value(c, t) for c, t in layout])
        out = F.when(status == key, v) if out is None else out.when(status == key, v)
    return out


def first_lines(spark: SparkSession, sf_dir: str, row_limit: int = ROW_LIMIT) -> DataFrame:
    """The first lines of each order; the limit is applied before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)
    return (
        table(spark, sf_dir, "lineitem").withColumn("line", F.row_number().over(w))
        .filter(F.col("line") <= row_limit)
    )


def order_corpus(spark: SparkSession, sf_dir: str, row_limit: int = ROW_LIMIT) -> DataFrame:
    """CORPUS_SCHEMA rows, one per order."""
    used = sorted({c for layout in LAYOUTS.values() for c, _ in layout})
    rows = (
        first_lines(spark, sf_dir, row_limit).groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list(F.struct("line", *[_text(c).alias(c) for c in used]))).alias("lines"))
    )
    totals = (
        table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("total"))
    )
    orders = table(spark, sf_dir, "orders")
    when_placed = F.struct("o_orderdate", "o_orderkey")
    ends = orders.groupBy("o_custkey").agg(
        F.min_by("o_orderkey", when_placed).alias("first_order"),
        F.max_by("o_orderkey", when_placed).alias("last_order"),
    )
    status = F.col("o_orderstatus")

    def edge(target: Column) -> Column:
        dangling = F.col("o_orderpriority") == "5-LOW"
        return F.struct(
            F.lit("l_partkey").alias("column"), F.lit("P1").alias("property_id"),
            F.when(dangling, F.lit("order_missing"))
            .otherwise(F.concat(F.lit("order_"), target.cast("string"))).alias("reference_table"),
        )

    first, last = edge(F.col("first_order")), edge(F.col("last_order"))
    cells = F.transform(
        F.coalesce("lines", F.array()),
        lambda r: F.when(status == "F", F.array(*[r[c] for c, _ in LAYOUTS["F"]]))
        .when(status == "O", F.array(*[r[c] for c, _ in LAYOUTS["O"]]))
        .otherwise(F.array(*[r[c] for c, _ in LAYOUTS["P"]])),
    )
    return (
        orders.join(ends, "o_custkey")
        .join(rows, F.col("o_orderkey") == rows["l_orderkey"], "left").drop("l_orderkey")
        .join(totals, F.col("o_orderkey") == totals["l_orderkey"], "left")
        .select(
            F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("database_name"),
            F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("table_name"),
            _by_status(status, lambda c, t: F.lit(c)).alias("columns"),
            _by_status(status, lambda c, t: F.lit(t)).alias("column_datatypes"),
            cells.alias("rows"),
            F.when(F.col("o_orderpriority") == "1-URGENT", F.array(first, last))
            .otherwise(F.array(first)).alias("foreign_keys"),
            F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("filepath"),
            F.coalesce("total", F.lit(0)).cast("bigint").alias("num_rows_total"),
        )
    )


def stored_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order corpus as a written table, for jobs that read it more than once."""
    return written(order_corpus(spark, sf_dir), "corpus")


def _sql_cells(layout) -> str:
    return "[" + ", ".join(
        f"{c}::DECIMAL(18,2)::VARCHAR" if c in _DECIMALS else f"{c}::VARCHAR" for c, _ in layout
    ) + "]"


def _sql_names(pos: int) -> str:
    return " ".join(
        f"WHEN '{s}' THEN [{', '.join(repr(x[pos]) for x in layout)}]" for s, layout in LAYOUTS.items()
    )


# CTEs "corpus" (as order_corpus; rows as a list of lists) for the SQL checks
CORPUS_SQL = f"""
ordered_lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)}) AS line
  FROM lineitem),
ends AS (
  SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order,
         arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order
  FROM orders GROUP BY o_custkey),
line_rows AS (
  SELECT o_orderkey,
         list(CASE o_orderstatus {' '.join(f"WHEN '{s}' THEN {_sql_cells(layout)}" for s, layout in LAYOUTS.items())} END
              ORDER BY line) AS rows
  FROM ordered_lines JOIN orders ON l_orderkey = o_orderkey WHERE line <= {ROW_LIMIT} GROUP BY o_orderkey),
totals AS (SELECT l_orderkey, count(*) AS total FROM lineitem GROUP BY l_orderkey),
corpus AS (
  SELECT 'cust_' || o_custkey AS database_name, 'order_' || o.o_orderkey AS table_name,
         CASE o_orderstatus {_sql_names(0)} END AS columns,
         CASE o_orderstatus {_sql_names(1)} END AS column_datatypes,
         coalesce(rows, []) AS rows,
         list_transform(
           CASE WHEN o_orderpriority = '1-URGENT' THEN [first_order, last_order] ELSE [first_order] END,
           lambda k: CASE WHEN o_orderpriority = '5-LOW' THEN 'order_missing' ELSE 'order_' || k END) AS fks,
         'order_' || o.o_orderkey || '.csv' AS filepath,
         coalesce(total, 0)::BIGINT AS num_rows_total
  FROM orders o JOIN ends USING (o_custkey)
  LEFT JOIN line_rows r ON r.o_orderkey = o.o_orderkey
  LEFT JOIN totals t ON t.l_orderkey = o.o_orderkey)
"""


def document_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table documents: (database_name, table_id, table array<array<string>>), first row the header."""
    lines = F.transform(F.split("text", "\n", -1), lambda s: F.split(s, " ", -1))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("database_name"), F.col("doc_id").cast("string").alias("table_id"),
        lines.alias("table"), "lang", "text",
    )


DOCUMENTS_SQL = """
docs AS (
  SELECT source AS database_name, doc_id::VARCHAR AS table_id, lang, text,
         list_transform(string_split(text, chr(10)), lambda s: string_split(s, ' ')) AS "table"
  FROM documents)
"""

# SQL texts of the views over CORPUS_SQL columns
SQL_VALUES = "array_to_string(list_transform({rows}, lambda r: array_to_string(r, '{cell}')), '{row}')"
SQL_SCHEMA = "'[TABLE]' || table_name || ' [SCHEMA]' || array_to_string(columns, ',')"
SQL_DOCUMENT = SQL_SCHEMA + " || ' [ROWS]' || " + SQL_VALUES.format(rows="rows", cell=",", row="|")
SQL_FULL = "'[DB]' || database_name || ' ' || " + SQL_DOCUMENT
SQL_ROW = """'[TABLE]' || table_name || ' [ROWS]' || array_to_string(list_transform(rows, lambda r:
  '[ROW] ' || array_to_string(list_transform(list_zip(columns, r), lambda p: p[1] || ':' || p[2]), ' | ')), '')"""
SQL_KEYVALUE = """array_to_string(flatten(list_transform(rows, lambda r:
  list_transform(list_zip(columns, r), lambda p: p[1] || ': ' || p[2]))), ' ')"""
SQL_SIMPLE = ("CASE WHEN len(rows) = 0 THEN '[TABLE] ' || table_name ELSE '[TABLE] ' || table_name || "
              "' [SCHEMA] ' || array_to_string(columns, ', ') || ' [ROWS] ' || "
              + SQL_VALUES.format(rows="rows", cell=" | ", row=" ") + " END")
