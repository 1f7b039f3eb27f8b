"""Files written from the given tables, in the layouts the readers accept."""
from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabscout.functions.hashing import h
from tabscout.plans.corpora import order_corpus
from tabscout.plans.registry import table
from tabscout.session import scratch_path
from tabscout.sources.files import filesystem
from tabscout.sources.folders import write_folders

DATABASE_TABLES = 1000  # customer keys to a database
ARCHIVE_RECORDS = 4000  # records to an archive, about
COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def nation_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A nation's customers are databases of at most DATABASE_TABLES tables, each customer a table of
    its orders: (tables, rows).

    Building customers do not state their number of rows; every table refers to the first of its
    database. Sides that grow with the customers are merged, not broadcast: their files are small, their
    rows in memory are not.
    """
    customers = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).withColumn("database_name", F.concat_ws(
        "_", "n_name", F.floor(F.col("c_custkey") / DATABASE_TABLES).cast("string")))
    first = customers.groupBy("database_name").agg(F.min("c_custkey").alias("first"))
    named = lambda key: F.concat(F.lit("Customer "), F.col(key).cast("string"))
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    head = customers.join(first.hint("merge"), "database_name").select(
        "c_custkey", "database_name", named("c_custkey").alias("table_name"),
        F.array(*map(F.lit, COLUMNS)).alias("columns"),
        F.concat(F.lit("customer_"), F.col("c_custkey").cast("string"), F.lit(".csv")).alias("filepath"),
        F.array(F.struct(
            F.lit("o_orderkey").alias("column"), F.lit("P9").alias("property_id"), named("first").alias("reference_table")
        )).alias("foreign_keys"),
        F.array(*map(F.lit, ["bigint", "string", "decimal", "string"])).alias("column_datatypes"), "c_mktsegment",
    )
    tables = head.join(counts.hint("merge"), F.col("c_custkey") == F.col("o_custkey"), "left").withColumn(
        "num_rows_total", F.when(F.col("c_mktsegment") != "BUILDING", F.coalesce("n", F.lit(0)))
    )
    cells = F.array(
        F.col("o_orderkey").cast("string"), "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        "o_orderpriority",
    )
    rows = table(spark, sf_dir, "orders").join(head.hint("merge"), F.col("c_custkey") == F.col("o_custkey")).select(
        "database_name", "filepath", F.col("o_orderkey").alias("ord"), "columns", cells.alias("cells")
    )
    return tables, rows


def nation_folders(spark: SparkSession, sf_dir: str) -> str:
    root = scratch_path(spark, "folders")
    write_folders(*nation_tables(spark, sf_dir), root)
    return root


def table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, table_id, record): customers' tables as JSON documents under three sets of names."""
    corpus = order_corpus(spark, sf_dir)
    last = F.element_at("columns", -1)
    short = F.transform("rows", lambda r: F.slice(r, 1, F.size(r) - 1))
    record = (
        F.when(last == "l_returnflag", F.to_json(F.struct(F.col("table_name").alias("table_id"), F.col("columns").alias("header"), "rows")))
        .when(last == "l_linestatus", F.to_json(F.struct(F.col("table_name").alias("id"), "columns", short.alias("data"))))
        .otherwise(F.to_json(F.struct(
            F.col("table_name").alias("name"), F.col("columns").alias("column_names"), "rows",
            F.array().cast("array<string>").alias("header"),
        )))
    )
    return corpus.select("database_name", "table_name", record.alias("record"))


def jsonl_tables(spark: SparkSession, sf_dir: str) -> str:
    root = scratch_path(spark, "jsonl")
    table_records(spark, sf_dir).select("record").write.text(root)
    return root


def write_archives(records: DataFrame, root: str, member_records: int = 1000) -> None:
    """records(archive, name, record) as one tar.gz per archive, with JSONL members of a bounded number
    of records in the order of their names. An archive is written by one task."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out, tar, lines, n, made = None, None, None, [], 0, 0

        def member(name: str, body: bytes) -> None:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))

        def flush() -> None:
            member(f"data/part_{n:06d}.jsonl", "\n".join(lines).encode())
            member(f"data/note_{n:06d}.txt", json.dumps({"ignored": n}).encode())

        def close() -> None:
            if tar is not None:
                if lines:
                    flush()
                tar.close()
                out.close()

        for pdf in batches:
            for key, record in zip(pdf["archive"], pdf["record"]):
                if key != now:
                    close()
                    where, inner = filesystem(f"{root}/part-{key}.tar.gz")
                    where.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    out = where.open_output_stream(inner)
                    tar, now, lines, n, made = tarfile.open(fileobj=out, mode="w|gz"), key, [], 0, made + 1
                lines.append(record)
                if len(lines) == member_records:
                    flush()
                    lines, n = [], n + 1
        close()
        yield pd.DataFrame({"archives": [made]})

    placed = records.select("archive", "name", "record").repartition("archive").sortWithinPartitions("archive", "name")
    placed.mapInPandas(write, "archives int").agg(F.sum("archives")).collect()


def archived_tables(spark: SparkSession, sf_dir: str) -> str:
    """The table records in archives of about ARCHIVE_RECORDS records, chosen by the table's hash."""
    root = scratch_path(spark, "archives")
    records = table_records(spark, sf_dir)
    archives = -(-table(spark, sf_dir, "orders").count() // ARCHIVE_RECORDS)
    named = records.select((h(F.col("table_name"), "archive") % max(1, archives)).alias("archive"), F.col("table_name").alias("name"), "record")
    write_archives(named, root)
    return root
