"""Positive pairs with their texts, stored as blocks that hold each text once.

A row of the file is a block: up to ``block_tables`` tables of one database in the order of their
ordinals, with their texts. All pairs inside a block, and those of a block with each later block of its
database, are stated by the block numbers alone, so the file grows with the corpus and not with the
pairs. A reader lays two blocks side by side and puts their pairs out in batches.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabscout.functions.views import serialize
from tabscout.operators.samples import index, nonempty

BLOCK_TABLES = 512
BATCH_PAIRS = 4096
SCHEMA = "database_name string, block bigint, blocks bigint, names array<string>, texts array<string>"


def write_pair_blocks(corpus: DataFrame, path: str, view: str = "row", block_tables: int = BLOCK_TABLES) -> None:
    """Blocks of all databases with more than one non-empty table."""
    tables = index(corpus).tables.where("n_tables > 1")
    texts = nonempty(corpus).select("database_name", "table_name", serialize(view).alias("text"))
    of = lambda n: F.call_function("div", n, F.lit(block_tables))
    placed = tables.join(texts, ["database_name", "table_name"]).withColumn("block", of(F.col("tab_ord")))
    rows = placed.groupBy("database_name", "block", (of(F.col("n_tables") - 1) + 1).alias("blocks")).agg(
        F.array_sort(F.collect_list(F.struct("tab_ord", "table_name", "text"))).alias("t"))  # block_tables entries at most
    rows.select("database_name", "block", "blocks", F.transform("t", lambda t: t["table_name"]).alias("names"),
                F.transform("t", lambda t: t["text"]).alias("texts")).write.parquet(path)


_PAIR = "db_a string, table_a string, db_b string, table_b string, label double, text_a string, text_b string"


def read_pairs(spark: SparkSession, path: str, label: float = 0.5) -> DataFrame:
    """(db_a, table_a, db_b, table_b, label, text_a, text_b): every pair, the table with the lower ordinal first."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    first = blocks.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
    own = first.where("other = block").select("database_name", "names", "texts", F.lit(None).cast("array<string>").alias("names_b"), F.lit(None).cast("array<string>").alias("texts_b"))
    later = blocks.select("database_name", F.col("block").alias("other"), F.col("names").alias("names_b"), F.col("texts").alias("texts_b"))
    across = first.where("other > block").join(later, ["database_name", "other"]).select("database_name", "names", "texts", "names_b", "texts_b")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                db = batch.column("database_name")[row].as_py()
                names, texts = (batch.column(c)[row].values for c in ("names", "texts"))
                inside = not batch.column("names_b")[row].is_valid
                other, others = (names, texts) if inside else (batch.column(c)[row].values for c in ("names_b", "texts_b"))
                n, m = len(names), len(other)
                # pairs by rank, so that no more than a batch of them is there at once
                starts = np.concatenate(([0], np.cumsum(m - 1 - np.arange(n) if inside else np.full(n, m))))
                for at in range(0, int(starts[-1]), BATCH_PAIRS):
                    rank = np.arange(at, min(at + BATCH_PAIRS, int(starts[-1])))
                    i = np.searchsorted(starts, rank, side="right") - 1
                    j = rank - starts[i] + (i + 1 if inside else 0)
                    a, b = pa.array(i), pa.array(j)
                    same = pa.array([db] * len(rank), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [same, names.take(a), same, other.take(b), pa.array(np.full(len(rank), label)), texts.take(a), others.take(b)],
                        ["db_a", "table_a", "db_b", "table_b", "label", "text_a", "text_b"])

    return own.unionByName(across).mapInArrow(pairs, _PAIR)
