"""Text views of a table, as Column expressions (no shuffle, no Python worker)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _cells(row: Column) -> Column:
    # array_join skips nulls, which would shift the columns
    return F.transform(row, lambda v: F.coalesce(v, F.lit("")))


def _pairs(columns: Column, row: Column, glue: str) -> Column:
    named = F.zip_with(columns, row, lambda c, v: F.struct(c.alias("c"), v.alias("v")))
    return F.transform(
        F.filter(named, lambda p: p["c"].isNotNull()),
        lambda p: F.concat(p["c"], F.lit(glue), F.coalesce(p["v"], F.lit(""))),
    )


def _value_rows(rows: Column, cell_glue: str, row_glue: str) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(_cells(r), cell_glue)), row_glue)


def schema_view(table="table_name", columns="columns") -> Column:
    return F.concat(F.lit("[TABLE]"), _c(table), F.lit(" [SCHEMA]"), F.array_join(_c(columns), ","))


def row_view(table="table_name", columns="columns", rows="rows") -> Column:
    line = lambda r: F.concat(F.lit("[ROW] "), F.array_join(_pairs(_c(columns), r, ":"), " | "))
    return F.concat(
        F.lit("[TABLE]"), _c(table), F.lit(" [ROWS]"), F.array_join(F.transform(_c(rows), line), "")
    )


def document_view(table="table_name", columns="columns", rows="rows") -> Column:
    """The index text: schema and values, without the database."""
    return F.concat(
        schema_view(table, columns), F.lit(" [ROWS]"), _value_rows(_c(rows), ",", "|")
    )


def full_view(db="database_name", table="table_name", columns="columns", rows="rows") -> Column:
    return F.concat(F.lit("[DB]"), _c(db), F.lit(" "), document_view(table, columns, rows))


def simple_view(table="table_name", columns="columns", rows="rows") -> Column:
    """Spaced tags and separators; a table without rows is its name only."""
    name = F.concat(F.lit("[TABLE] "), _c(table))
    body = F.concat(
        name, F.lit(" [SCHEMA] "), F.array_join(_c(columns), ", "),
        F.lit(" [ROWS] "), _value_rows(_c(rows), " | ", " "),
    )
    return F.when(F.size(_c(rows)) > 0, body).otherwise(name)


def keyvalue_view(columns="columns", rows="rows") -> Column:
    """``column: value`` words over the given rows."""
    return F.array_join(
        F.flatten(F.transform(_c(rows), lambda r: _pairs(_c(columns), r, ": "))), " "
    )


def sniffed_view(table_id, column_names, header, rows, row_data, fields, row_limit: int = 3) -> Column:
    """Index text of a document whose layout is found by looking at it.

    ``column_names`` holds ``[index, name]`` pairs or one-element lists, ``header`` plain names,
    ``fields`` the document itself as an ordered map, which stands in for whatever is missing.
    """
    names = F.transform(_c(column_names), lambda p: F.get(p, F.size(p) - 1))
    schema = (
        F.when(F.size(_c(column_names)) > 0, F.array_join(_cells(names), ","))
        .when(F.size(_c(column_names)) == 0, F.lit("unknown"))
        .when(_c(header).isNotNull(), F.array_join(_cells(_c(header)), ","))
        .otherwise(F.array_join(F.map_keys(_c(fields)), ","))
    )
    first = F.slice(F.coalesce(_c(rows), _c(row_data)), 1, row_limit)
    ids = ["_id", "table_id", "db_id"]
    own = F.transform(
        F.filter(F.slice(F.map_entries(_c(fields)), 1, 10), lambda e: ~e["key"].isin(ids)),
        lambda e: F.coalesce(e["value"], F.lit("")),
    )
    values = F.when(F.size(first) > 0, _value_rows(first, ",", "|")).otherwise(F.array_join(own, ","))
    return F.concat(F.lit("[TABLE]"), _c(table_id), F.lit(" [SCHEMA]"), schema, F.lit(" [ROWS]"), values)


def long_documents(docs: DataFrame) -> DataFrame:
    """(table_name, line, cells map) with few lines per table -> (table_name, columns, rows)."""
    as_row = F.struct(
        "line", F.map_keys("cells").alias("columns"), F.map_values("cells").alias("cells")
    )
    return docs.groupBy("table_name").agg(F.array_sort(F.collect_list(as_row)).alias("d")).select(
        "table_name", F.col("d")[0]["columns"].alias("columns"),
        F.transform("d", lambda r: r["cells"]).alias("rows"),
    )


VIEWS: dict[str, Callable[[], Column]] = {
    "schema": schema_view,
    "row": row_view,
    "full": full_view,
    "document": document_view,
    "simple": simple_view,
    "keyvalue": keyvalue_view,
}


def serialize(view: str) -> Column:
    """The text of a corpus row under a named view."""
    if view not in VIEWS:
        raise ValueError(f"unknown view {view!r}; known: {sorted(VIEWS)}")
    return VIEWS[view]()


def fan_out(corpus: DataFrame, views: list[str]) -> DataFrame:
    """Every table under every view: (database_name, table_name, view, text)."""
    texts = F.array(*[F.struct(F.lit(v).alias("view"), serialize(v).alias("text")) for v in views])
    return corpus.select("database_name", "table_name", F.inline(texts))
