"""Corpora kept as one folder per database: a JSON catalogue and one CSV file per table."""
from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabscout.functions.names import fk_key, table_key
from tabscout.session import written
from tabscout.sources.files import BATCH_ROWS, csv_records, filesystem, list_files, open_stream
from tabscout.sources.json_events import read_object

CATALOGUE = "info_full.json"
SHORT_CATALOGUE = "info_short.json"
_INFO = (
    "INFO struct<db_folder_name:string>, TABLES map<string, struct<FILEPATH:string, COLUMNS:array<string>, "
    "COLUMN_DATATYPES:array<string>, NUM_ROWS:bigint, "
    "FOREIGN_KEYS:array<struct<FOREIGN_KEY:array<string>, REFERENCE_TABLE:string>>>>, _bad string"
)


def databases(spark: SparkSession, root: str) -> DataFrame:
    """(database_name) of the folders holding a catalogue."""
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return list_files(spark, root, CATALOGUE).select(folder.alias("database_name")).distinct()


def catalogues(spark: SparkSession, root: str, name: str = CATALOGUE) -> DataFrame:
    """(folder, info, c): one parsed catalogue per database; c._bad is set where it cannot be read."""
    texts = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name)
        .text(root, wholetext=True)
    )
    return texts.select(
        F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("folder"),
        F.get_json_object("value", "$.INFO").alias("info"),
        F.from_json("value", _INFO, {"columnNameOfCorruptRecord": "_bad"}).alias("c"),
    )


_TABLE = (
    "FILEPATH string, COLUMNS array<string>, COLUMN_DATATYPES array<string>, NUM_ROWS bigint, "
    "FOREIGN_KEYS array<struct<FOREIGN_KEY:array<string>, REFERENCE_TABLE:string>>, _bad string"
)


def catalogue_tables(spark: SparkSession, root: str, name: str = CATALOGUE) -> DataFrame:
    """(folder, database, table, t), stored: one row per table of every catalogue that can be read whole.

    Catalogues are read member by member, so a database of any number of tables needs no more memory
    than its largest entry. ``database`` is the name that the catalogue gives itself, else the folder.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def events(path: str) -> Iterator[tuple]:
            folder = path.rsplit("/", 2)[-2]
            try:
                with open_stream(path) as stream:
                    text = io.TextIOWrapper(stream, encoding="utf-8", errors="replace")
                    for key, inner, value in read_object(text, "TABLES"):
                        if key == "TABLES" and inner is not None:
                            yield folder, "table", inner, value
                        elif key == "INFO":
                            yield folder, "info", None, value
            except (OSError, ValueError, RecursionError) as broken:
                yield folder, "error", None, str(broken)

        for pdf in batches:
            for path in pdf["path"]:
                batch = []
                for event in events(path):
                    batch.append(event)
                    if len(batch) == BATCH_ROWS:
                        yield pd.DataFrame(batch, columns=["folder", "kind", "name", "value"])
                        batch = []
                if batch:
                    yield pd.DataFrame(batch, columns=["folder", "kind", "name", "value"])

    found = written(list_files(spark, root, name).mapInPandas(read, "folder string, kind string, name string, value string"), "catalogue")
    options = {"columnNameOfCorruptRecord": "_bad"}
    parsed = found.where("kind = 'table'").select("folder", F.col("name").alias("table"), F.from_json("value", _TABLE, options).alias("t"))
    broken = found.where("kind = 'error'").select("folder").unionByName(parsed.where("t._bad is not null").select("folder")).distinct()
    named = found.where("kind = 'info'").groupBy("folder").agg(F.max(F.get_json_object("value", "$.db_folder_name")).alias("_name"))
    tables = parsed.join(broken, "folder", "left_anti").join(named, "folder", "left")
    return tables.select("folder", F.coalesce("_name", "folder").alias("database"), "table", "t")


def rejected(spark: SparkSession, root: str) -> DataFrame:
    """(folder) of databases whose catalogue is not valid JSON."""
    return catalogues(spark, root).filter(F.col("c._bad").isNotNull()).select("folder")


def _head(path: str, row_limit: int) -> tuple[list[str], list[list[str]], str | None]:
    """(header, first rows, what broke off the reading); rows read before an error are kept."""
    header, rows, error = [], [], None
    try:
        with open_stream(path) as stream:
            for record in csv_records(stream):
                if not header:
                    header = record
                else:
                    rows.append(record)
                if len(rows) >= row_limit:
                    break
    except (OSError, ValueError, csv.Error) as broken:
        error = f"{type(broken).__name__}: {broken}"
    return header, rows, error


def csv_heads(spark: SparkSession, root: str, row_limit: int = 3) -> DataFrame:
    """(database_name, file, header, rows, error): first rows of each CSV; reading stops at the limit."""
    tables = list_files(spark, root, "*.csv").filter(F.col("path").rlike("/tables/[^/]+$"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            heads = [_head(p, row_limit) for p in pdf["path"]]
            yield pd.DataFrame({"path": pdf["path"], "header": [h for h, _, _ in heads], "rows": [r for _, r, _ in heads],
                                "error": [e for _, _, e in heads]})

    schema = "path string, header array<string>, rows array<array<string>>, error string"
    return tables.mapInPandas(read, schema).select(
        F.regexp_extract("path", r"([^/]+)/tables/[^/]+$", 1).alias("database_name"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "header", "rows", "error",
    )


def unreadable(spark: SparkSession, root: str) -> DataFrame:
    """(database_name, file, error) of CSV files that cannot be read to their end."""
    tables = list_files(spark, root, "*.csv").filter(F.col("path").rlike("/tables/[^/]+$"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                try:
                    with open_stream(path) as stream:
                        for _ in csv_records(stream):
                            pass
                except (OSError, ValueError, csv.Error) as broken:
                    yield pd.DataFrame({"path": [path], "error": [f"{type(broken).__name__}: {broken}"]})

    return tables.mapInPandas(read, "path string, error string").select(
        F.regexp_extract("path", r"([^/]+)/tables/[^/]+$", 1).alias("database_name"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "error",
    )


def csv_rows(spark: SparkSession, root: str) -> DataFrame:
    """(collection, row_idx, cells): every row of every CSV, streamed; empty files give none.

    The collection is ``database__table``.
    """
    tables = list_files(spark, root, "*.csv").filter(F.col("path").rlike("/tables/[^/]+$"))

    def records(path: str) -> Iterator[tuple]:
        header, n = None, 0
        with open_stream(path) as stream:
            for record in csv_records(stream):
                if header is None:
                    header = record
                    continue
                yield path, n, dict(zip(header, record + [None] * (len(header) - len(record))))
                n += 1

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches go on from file to file, as most files are short."""
        out = []
        for pdf in batches:
            for path in pdf["path"]:
                for row in records(path):
                    out.append(row)
                    if len(out) == BATCH_ROWS:
                        yield pd.DataFrame(out, columns=["path", "row_idx", "cells"])
                        out = []
        if out:
            yield pd.DataFrame(out, columns=["path", "row_idx", "cells"])

    rows = tables.mapInPandas(read, "path string, row_idx bigint, cells map<string,string>")
    name = F.concat(
        F.regexp_extract("path", r"([^/]+)/tables/[^/]+$", 1), F.lit("__"), F.regexp_extract("path", r"([^/]+)\.csv$", 1)
    )
    return rows.select(name.alias("collection"), "row_idx", "cells")


def read_folders(spark: SparkSession, root: str, row_limit: int = 3) -> DataFrame:
    """CORPUS_SCHEMA rows. Cells are aligned with the declared columns by header name; what is
    missing is an empty string. A table without a file has no rows."""
    meta = catalogue_tables(spark, root).select(
        F.col("folder").alias("database_name"), F.col("table").alias("table_name"), "t", F.coalesce("t.FILEPATH", F.lit("")).alias("file"))
    heads = csv_heads(spark, root, row_limit).drop("error").hint("merge")  # as many as tables, though Spark cannot tell
    joined = meta.join(heads, ["database_name", "file"], "left")
    columns = F.coalesce("t.COLUMNS", F.array().cast("array<string>"))
    aligned = F.transform(
        F.coalesce("rows", F.array().cast("array<array<string>>")),
        lambda r: F.transform(columns, lambda c: F.coalesce(
            F.get(r, F.when(F.array_position("header", c) > 0, F.array_position("header", c).cast("int") - 1)), F.lit("")
        )),
    )
    edges = F.transform(
        F.coalesce("t.FOREIGN_KEYS", F.array()),
        lambda k: F.struct(
            F.coalesce(F.get(k["FOREIGN_KEY"], 1), F.lit("")).alias("column"),
            F.coalesce(F.get(k["FOREIGN_KEY"], 0), F.lit("")).alias("property_id"),
            F.coalesce(k["REFERENCE_TABLE"], F.lit("")).alias("reference_table"),
        ),
    )
    return joined.select(
        "database_name", "table_name", columns.alias("columns"),
        F.coalesce("t.COLUMN_DATATYPES", F.array().cast("array<string>")).alias("column_datatypes"),
        aligned.alias("rows"), edges.alias("foreign_keys"), F.col("file").alias("filepath"),
        F.coalesce("t.NUM_ROWS", F.size(F.coalesce("rows", F.array())).cast("bigint")).alias("num_rows_total"),
    )


def _either_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """Tables of the full catalogue of each folder, else of the short one."""
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder")
    full = list_files(spark, root, CATALOGUE).select(folder).distinct()
    return catalogue_tables(spark, root).unionByName(
        catalogue_tables(spark, root, SHORT_CATALOGUE).join(full.hint("merge"), "folder", "left_anti"))


def table_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """(database, table): normalised table names under the database's own name."""
    return _either_catalogue(spark, root).select("database", table_key(F.col("table")).alias("table"))


def fk_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """(database, source_table, destination_table, foreign_key), normalised; incomplete keys dropped."""
    keys = _either_catalogue(spark, root).select("database", "table", F.explode("t.FOREIGN_KEYS").alias("k"))
    return keys.filter(F.size("k.FOREIGN_KEY") >= 2).select(
        "database", table_key(F.col("table")).alias("source_table"),
        table_key(F.coalesce("k.REFERENCE_TABLE", F.lit(""))).alias("destination_table"),
        fk_key(F.get("k.FOREIGN_KEY", 1)).alias("foreign_key"),
    )


# --- writing the same layout ------------------------------------------------------------------

def _write_grouped(df: DataFrame, keys: list[str], order: list[str], path_of, opening, line, closing) -> int:
    """Stream rows, sorted inside each task, into one file per key; no group is held in memory."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out, n, where, made = None, None, 0, None, None
        for pdf in batches:
            names = list(pdf.columns)
            for row in map(lambda values: dict(zip(names, values)), pdf.itertuples(index=False, name=None)):
                key = tuple(row[k] for k in keys)
                if key != now:
                    if out is not None:
                        out.write(closing().encode())
                        out.close()
                    path = path_of(*key)
                    if where is None:
                        where, inner = filesystem(path)
                        outer = path[:len(path) - len(inner)]
                    folder, inner = path.rsplit("/", 1)[0], path[len(outer):]
                    if folder != made:
                        where.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                        made = folder
                    out, now, first = where.open_output_stream(inner), key, True
                    out.write(opening(row).encode())
                    n += 1
                out.write(line(row, first).encode())
                first = False
        if out is not None:
            out.write(closing().encode())
            out.close()
        yield pd.DataFrame({"files": [n]})

    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(write, "files bigint").agg(F.sum("files")).first()[0]


def _csv_line(cells) -> str:
    import io

    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(cells)
    return out.getvalue()


def write_folders(tables: DataFrame, rows: DataFrame, root: str) -> None:
    """Write catalogues from tables(database_name, table_name, columns, column_datatypes,
    foreign_keys, filepath, num_rows_total) and CSV files from rows(database_name, filepath, ord,
    columns, cells)."""
    meta = tables.select("database_name", "table_name", F.to_json(F.struct(
        F.col("filepath").alias("FILEPATH"), F.col("columns").alias("COLUMNS"),
        F.col("column_datatypes").alias("COLUMN_DATATYPES"), F.col("num_rows_total").alias("NUM_ROWS"),
        F.transform("foreign_keys", lambda k: F.struct(
            F.array(k["property_id"], k["column"]).alias("FOREIGN_KEY"), k["reference_table"].alias("REFERENCE_TABLE")
        )).alias("FOREIGN_KEYS"),
    )).alias("meta"))
    _write_grouped(
        meta, ["database_name"], ["table_name"], lambda db: f"{root}/{db}/{CATALOGUE}",
        lambda row: '{"INFO": %s, "TABLES": {' % json.dumps({"db_folder_name": row["database_name"]}),
        lambda row, first: ("" if first else ", ") + json.dumps(row["table_name"]) + ": " + row["meta"],
        lambda: "}}",
    )
    _write_grouped(
        rows, ["database_name", "filepath"], ["ord"], lambda db, file: f"{root}/{db}/tables/{file}",
        lambda row: _csv_line(row["columns"]), lambda row, first: _csv_line(row["cells"]), lambda: "",
    )
