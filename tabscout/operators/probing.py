"""The join of queries and rows that meet in a cell, in blocks of bounded size."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabscout.operators.search import _ARROW, _NAMES, _ids, _join, _matrix, _result, _schema, _select
from tabscout.session import written


def block_sizes(dim: int, block_rows: int | None, query_block_rows: int | None) -> tuple[int, int]:
    """Rows and queries of a task: some 4 and 1 million numbers unless given."""
    return block_rows or max(1024, (1 << 22) // dim), query_block_rows or max(256, (1 << 20) // dim)


def probe_join(queries: DataFrame, probes: DataFrame, cells: DataFrame, k: int, exclude_self: bool, block_rows: int, query_block_rows: int) -> DataFrame:
    """(query_id, table_id, score): up to k rows of each block of each probed cell.

    ``queries(query_id, embedding[, floor])``, ``probes(query_id, cell)``, ``cells(table_id, embedding, cell)``,
    all stored. Cells of many rows are cut into blocks, those of many queries into parts; a row is copied
    only to the parts that ask for its cell.
    """
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    asked = written(
        probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / query_block_rows).alias("parts")).join(sizes, "cell"), "asked-cells")
    pick = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    keys = ["cell", "block", "part"]
    limit = F.col("floor") if "floor" in queries.columns else F.lit(-2.0)
    left = (
        probes.join(asked, "cell").withColumn("part", pick("query_id", "parts")).withColumn("block", numbers("blocks"))
        .join(queries.select("query_id", "embedding", limit.alias("floor")), "query_id").select(*keys, "query_id", "embedding", "floor"))
    right = (
        cells.join(asked, "cell").withColumn("block", pick("table_id", "blocks")).withColumn("part", numbers("parts"))
        .select(*keys, "table_id", "embedding"))
    schema = _schema(queries, cells)
    kinds = schema.replace(",", "").split()
    empty = pa.schema([("query_id", _ARROW[kinds[1]]), ("table_id", _ARROW[kinds[3]]), ("score", pa.float64())]).empty_table()

    def score(q: pa.Table, c: pa.Table) -> pa.Table:
        if not len(q) or not len(c):
            return empty
        q_ids = _ids(q["query_id"])
        found = _join(_select(
            q_ids, _matrix(q["embedding"]), _ids(c["table_id"]), _matrix(c["embedding"]), k, exclude_self, q["floor"].to_numpy()))
        return pa.Table.from_arrays(_result(q_ids, found), _NAMES) if found is not None else empty

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)
