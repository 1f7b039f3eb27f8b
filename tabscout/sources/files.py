"""Listing files with Spark and opening them inside tasks."""
from __future__ import annotations

import csv
import fnmatch
import io
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

BATCH_ROWS = 5000


def _hidden(name: str) -> bool:
    """Names that Spark's own readers pass over."""
    kept = name.startswith(("_metadata", "_common_metadata"))
    return not kept and (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def _inside(where, folder: str) -> list:
    from pyarrow import fs

    return [i for i in where.get_file_info(fs.FileSelector(folder)) if not _hidden(i.base_name)]


def _spark_listing(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        .load(root).select("path")
    )


def list_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path) of the files below ``root``; the contents are not read.

    One task lists the root, others what lies below each folder in it, and the paths are dealt evenly over
    tasks again: no list passes through the driver. The names of one folder are held by the task that lists
    it. Roots with wildcards, and stores that Arrow does not know, are listed by Spark on the driver.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        return _spark_listing(spark, root, glob)
    whole = store.makeQualified(at).toString()
    try:
        filesystem(whole)
    except (OSError, ValueError, NotImplementedError):
        return _spark_listing(spark, root, glob)

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, inner = filesystem(whole)
        for _ in batches:
            found = [where.get_file_info(inner)]
            if not found[0].is_file:
                found = _inside(where, inner)
            for n in range(0, len(found), BATCH_ROWS):
                part = found[n:n + BATCH_ROWS]
                yield pd.DataFrame({"path": [i.path for i in part], "folder": [not i.is_file for i in part]})

    def below(where, folder: str) -> Iterator[str]:
        for i in _inside(where, folder):
            if i.is_file:
                yield i.path
            else:
                yield from below(where, i.path)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, inner = filesystem(whole)
        inner = inner.rstrip("/")
        out = []
        for pdf in batches:
            for path, folder in zip(pdf["path"], pdf["folder"]):
                for found in below(where, path) if folder else [path]:
                    if wanted(found.rsplit("/", 1)[-1]):
                        out.append(whole.rstrip("/") + found[len(inner):])
                    if len(out) == BATCH_ROWS:
                        yield pd.DataFrame({"path": out})
                        out = []
        yield pd.DataFrame({"path": pd.Series(out, dtype=object)})

    wanted = _matcher(glob)
    tasks = 4 * spark.sparkContext.defaultParallelism
    tops = spark.range(1, numPartitions=1).mapInPandas(top, "path string, folder boolean").repartition(tasks, "path")
    return tops.mapInPandas(walk, "path string").repartition(tasks, "path")


def _matcher(glob: str):
    """Whether a name matches: * and ?, [] and {a,b} as in Spark's ``pathGlobFilter``."""
    alternatives = [glob]
    while any("{" in g for g in alternatives):
        alternatives = [
            g[:g.index("{")] + one + g[g.index("}") + 1:] if "{" in g else g
            for g in alternatives for one in (g[g.index("{") + 1:g.index("}")].split(",") if "{" in g else [""])]
    patterns = [re.compile(fnmatch.translate(g.replace("[^", "[!"))) for g in alternatives]
    return lambda name: any(p.match(name) for p in patterns)


def filesystem(path: str):
    """(file system, path inside it) for a plain path or any URI that Arrow knows."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path)


def open_stream(path: str):
    where, inner = filesystem(path)
    return where.open_input_stream(inner)


def csv_records(stream) -> Iterator[list[str]]:
    """Records of a CSV stream as they come; bad UTF-8 is replaced and blank lines are skipped."""
    text = io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline="")
    for record in csv.reader(text):
        if record:
            yield record


def json_tables(text: str) -> list:
    """The entries of a tables file: a list, an object with ``tables``, or one object."""
    data = json.loads(text)
    if isinstance(data, dict):
        data = data.get("tables", [data])
    return data if isinstance(data, list) else [data]


def jsonl_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, record): non-blank lines numbered in file order. Large files stay split."""
    from tabscout.operators.numbering import number_within

    lines = (
        spark.read.text(path).filter(F.trim("value") != "")
        .select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_at"), F.col("value").alias("record"),
        )
    )
    return number_within(lines, ["file"], F.col("_start"), ["_at"], "idx").select("file", "idx", "record")


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, record): entries of whole JSON files, each as its JSON text; bad files give none."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    entries = F.coalesce(
        F.from_json("value", "array<string>"),
        F.from_json(F.get_json_object("value", "$.tables"), "array<string>"),
        F.when(F.get_json_object("value", "$").isNotNull(), F.array("value")),
    )
    return texts.select("file", F.posexplode(entries).alias("idx", "record")).filter(
        F.col("record").isNotNull()
    ).withColumn("idx", F.col("idx").cast("bigint"))
