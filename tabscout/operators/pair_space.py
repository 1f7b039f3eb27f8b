"""Shuffle and split of training pairs over their implicit space, without sorting or listing them.

All pairs have a rank: same-database pairs first, database by database, each database's tables in the
order of their ordinals (the table with the lower ordinal is the anchor), then one negative pair per
database. A seeded permutation of the ranks gives a pair its position in the shuffle, and its inverse
gives the pair at a position. The permutation is a Feistel network on numbers below ``a`` x ``b``, which
is the number of pairs or a little more; positions beyond the last pair walk on until they are inside.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabscout.operators.numbering import running
from tabscout.operators.samples import Index, negative_pairs
from tabscout.session import written

PRIME = (1 << 31) - 1
ROUNDS = 6
SEARCHED = 1000  # factors looked at on both sides of the square root
BLOCK = 1 << 16  # ranks of one row, or a task's step


def constants(seed: int) -> list[tuple[int, int, int]]:
    """Numbers below PRIME for every round."""
    draw = lambda *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16) % PRIME
    return [(1 + draw(seed, j, "a") % (PRIME - 1), draw(seed, j, "b"), draw(seed, j, "c")) for j in range(ROUNDS)]


def factors(total: int) -> tuple[int, int]:
    """a and b near the square root with the smallest a x b that is not below ``total``."""
    root = max(1, math.isqrt(total))
    span = min(root // 2, SEARCHED)
    a = min(range(root - span, root + span + 1), key=lambda a: (-total % a, abs(a - root), a))
    return a, -(-total // a)


class Permutation(NamedTuple):
    """A seeded order of 0 ... total - 1."""

    total: int
    seed: int = 42

    def _walk(self, x: np.ndarray, once) -> np.ndarray:
        out = once(x)
        while (outside := out >= self.total).any():
            out[outside] = once(out[outside])
        return out

    def _mixed(self, x: np.ndarray, turn: tuple[int, int, int]) -> np.ndarray:
        y = (x % PRIME * turn[0] + turn[1]) % PRIME
        return (y * y + turn[2]) % PRIME

    def positions(self, ranks: np.ndarray) -> np.ndarray:
        a, b = factors(self.total)

        def once(x: np.ndarray) -> np.ndarray:
            left, right = x % a, x // a
            for j, turn in enumerate(constants(self.seed)):
                if j % 2 == 0:
                    left = (left + self._mixed(right, turn)) % a
                else:
                    right = (right + self._mixed(left, turn)) % b
            return right * a + left

        return self._walk(ranks.astype(np.int64), once)

    def ranks(self, positions: np.ndarray) -> np.ndarray:
        """The inverse of ``positions``."""
        a, b = factors(self.total)

        def once(x: np.ndarray) -> np.ndarray:
            left, right = x % a, x // a
            for j, turn in reversed(list(enumerate(constants(self.seed)))):
                if j % 2 == 0:
                    left = (left - self._mixed(right, turn)) % a
                else:
                    right = (right - self._mixed(left, turn)) % b
            return right * a + left

        return self._walk(positions.astype(np.int64), once)


def anchor_of(rank: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): the pair of that rank inside a database of n tables."""
    start = lambda i: i * (2 * n - i - 1) // 2
    wide = 2.0 * n - 1
    i = np.floor((wide - np.sqrt(np.maximum(wide * wide - 8.0 * rank, 0))) / 2).astype(np.int64)
    while (high := start(i) > rank).any():
        i = i - high
    while (low := start(i + 1) <= rank).any():
        i = i + low
    return i, rank - start(i) + i + 1


class PairSpace(NamedTuple):
    """databases(database_name, db_ord, n_tables, first_rank), stored, and the sizes of both kinds."""

    ix: Index
    databases: DataFrame
    positives: int
    negatives: int
    seed: int

    @property
    def order(self) -> Permutation:
        return Permutation(self.positives + self.negatives, self.seed)


def pair_space(ix: Index, seed: int = 42) -> PairSpace:
    sized = ix.databases.withColumn("_pairs", F.call_function("div", F.col("n_tables") * (F.col("n_tables") - 1), F.lit(2)))
    placed = written(
        running(sized, [], "db_ord", "_pairs", "sum", "first_rank", inclusive=False)
        .select("database_name", "db_ord", "n_tables", F.col("first_rank").cast("bigint").alias("first_rank"), "_pairs"), "pair-space")
    one = placed.agg(F.coalesce(F.sum("_pairs"), F.lit(0)).alias("pairs"), F.count(F.lit(1)).alias("n")).first()
    return PairSpace(ix, placed.drop("_pairs"), int(one.pairs), one.n if one.n > 1 else 0, seed)


def _blocks(space: PairSpace) -> DataFrame:
    """Stretches of at most BLOCK ranks of one database, dealt evenly over tasks."""
    n = F.col("n_tables")
    pairs = F.call_function("div", n * (n - 1), F.lit(2))
    cut = space.databases.where("n_tables > 1").select(
        "database_name", "n_tables", "first_rank", pairs.alias("pairs"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), pairs - 1, F.lit(BLOCK).cast("bigint"))).alias("start"))
    # a given number of tasks: by their size alone these few rows would end up in one
    tasks = max(space.databases.sparkSession.sparkContext.defaultParallelism, min(1 << 16, space.positives // (16 * BLOCK)))
    return cut.withColumn("stop", F.least(F.col("start") + BLOCK, F.col("pairs"))).repartition(tasks, "database_name", "start")


def _pairs_of(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rank = np.arange(block["start"], block["stop"], dtype=np.int64)
    return (*anchor_of(rank, np.full(len(rank), block["n_tables"], np.int64)), rank + block["first_rank"])


def _named(space: PairSpace, pairs: DataFrame) -> DataFrame:
    """Table names for (database_name, ord_a, ord_b, ...)."""
    name = lambda side: space.ix.tables.select("database_name", F.col("tab_ord").alias(f"ord_{side}"), F.col("table_name").alias(f"table_{side}"))
    return pairs.join(name("a"), ["database_name", "ord_a"]).join(name("b"), ["database_name", "ord_b"])


def _negatives(space: PairSpace) -> DataFrame:
    """(rank, database_name, table_a, other_db, table_b, label) of the negative pairs."""
    drawn = negative_pairs(space.ix, space.seed)
    return drawn.join(space.databases.select("database_name", "db_ord"), "database_name").select(
        (F.col("db_ord") + space.positives).alias("rank"), "database_name", "table_a", "other_db", "table_b", "label")


def with_positions(df: DataFrame, order: Permutation, rank: str = "rank", name: str = "position") -> DataFrame:
    """Adds the place that each rank has in the shuffle."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = order.positions(batch.column(rank).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, name])

    return df.mapInArrow(add, df.withColumn(name, F.lit(0).cast("bigint")).schema)


def shuffled_pairs(space: PairSpace, label: float = 0.5) -> DataFrame:
    """Every pair with its position: (position, db_a, table_a, db_b, table_b, label).

    Positions are computed pair by pair; nothing is sorted, and a large database is many blocks.
    """
    order = space.order

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                i, j, rank = _pairs_of(block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block["database_name"]] * len(i)), pa.array(i), pa.array(j), pa.array(order.positions(rank))],
                    ["database_name", "ord_a", "ord_b", "position"])

    pairs = _named(space, _blocks(space).mapInArrow(listed, "database_name string, ord_a bigint, ord_b bigint, position bigint"))
    db = F.col("database_name").alias("db_a")
    positive = pairs.select("position", db, "table_a", F.col("database_name").alias("db_b"), "table_b", F.lit(label).alias("label"))
    negative = with_positions(_negatives(space), order).select(
        "position", db, "table_a", F.col("other_db").alias("db_b"), "table_b", "label")
    return positive.unionByName(negative)


def pairs_at(space: PairSpace, first: int, last: int, label: float = 0.5) -> DataFrame:
    """The pairs at positions ``first`` to ``last`` - 1 of the shuffle, as a training loop asks for them.

    Positions turn into ranks; ranks find their database as the last one that starts at or before them.
    """
    spark, order = space.databases.sparkSession, space.order
    last = min(last, order.total)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("position")
            yield pa.RecordBatch.from_arrays([at, pa.array(order.ranks(at.to_numpy()))], ["position", "rank"])

    asked = written(spark.range(first, max(first, last)).toDF("position").mapInArrow(invert, "position bigint, rank bigint"), "ranks")
    starts = space.databases.where("n_tables > 1").select(
        F.lit(None).cast("bigint").alias("position"), F.col("first_rank").alias("rank"), F.struct("first_rank", "database_name", "n_tables").alias("db"))
    inside = asked.where(F.col("rank") < space.positives).withColumn("db", F.lit(None).cast(starts.schema["db"].dataType))
    step = max(2, 2 * space.positives * BLOCK // max(1, last - first))  # ranks are even over the space
    merged = starts.unionByName(inside).withColumn("_at", 2 * F.col("rank") + F.col("position").isNotNull().cast("bigint"))
    found = running(written(merged, "starts"), [], "_at", "db", "max", "_db", block_rows=step).where(
        "position is not null").select("position", "rank", "_db.*")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n).to_numpy() for n in ("rank", "first_rank", "n_tables")}
            i, j = anchor_of(c["rank"] - c["first_rank"], c["n_tables"])
            yield pa.RecordBatch.from_arrays([batch.column("database_name"), pa.array(i), pa.array(j), batch.column("position")],
                                             ["database_name", "ord_a", "ord_b", "position"])

    pairs = _named(space, found.mapInArrow(local, "database_name string, ord_a bigint, ord_b bigint, position bigint"))
    db = F.col("database_name").alias("db_a")
    positive = pairs.select("position", db, "table_a", F.col("database_name").alias("db_b"), "table_b", F.lit(label).alias("label"))
    negative = asked.join(_negatives(space), "rank").select("position", db, "table_a", F.col("other_db").alias("db_b"), "table_b", "label")
    return positive.unionByName(negative)


def split_counts(space: PairSpace, train: float = 0.9) -> DataFrame:
    """How many pairs of every anchor fall to training, as one row per anchor and kind.

    (database_name, table_name, kind, n_pairs, n_train): the first ``train`` share of positions is
    training, exactly. Tasks count over stretches of ranks and never put a pair out.
    """
    order = space.order
    cut = math.floor(round(train * order.total, 6))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                i, _, rank = _pairs_of(block)
                low = int(i[0])
                n = np.bincount(i - low)
                taken = np.bincount((i - low)[order.positions(rank) < cut], minlength=len(n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block["database_name"]] * len(n)), pa.array(np.arange(low, low + len(n))), pa.array(n), pa.array(taken)],
                    ["database_name", "tab_ord", "n_pairs", "n_train"])

    counts = (
        _blocks(space).mapInArrow(count, "database_name string, tab_ord bigint, n_pairs bigint, n_train bigint")
        .groupBy("database_name", "tab_ord").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("n_train").alias("n_train"))
    )
    anchors = space.ix.tables.select("database_name", "tab_ord", "table_name")
    positive = counts.join(anchors, ["database_name", "tab_ord"]).select("database_name", "table_name", F.lit("positive").alias("kind"), "n_pairs", "n_train")
    negative = with_positions(_negatives(space), order).select(
        "database_name", F.col("table_a").alias("table_name"), F.lit("negative").alias("kind"), F.lit(1).cast("bigint").alias("n_pairs"),
        (F.col("position") < cut).cast("bigint").alias("n_train"))
    return positive.unionByName(negative)
