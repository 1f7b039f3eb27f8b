"""Exact cosine top-k for corpora beyond a flat set of cells: two levels of pivots.

A branch is a top pivot with the pivots nearest to it; a row belongs to the nearest top pivot and, inside
that branch, to the nearest pivot. Both levels know their radius, the largest angle from the pivot to a
row. The angle between a query and any row is at least the angle to the pivot minus the radius, so a query
that has k rows at hand drops whole branches by one comparison and looks at the pivots of the others only.

Pivots are rows chosen by hash. There are at most ``MOST_CELLS`` of them, whose vectors and sizes go to
the driver and to every task (64 numbers each: 134 MB); beyond some 4 billion rows cells grow instead,
and a large cell is cut into blocks.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabscout.functions.hashing import h
from tabscout.operators.probing import block_sizes, probe_join
from tabscout.operators.search import ANGLE_SLACK, SLACK, _matrix, _similar, rank, sample_pivots, scan_topk
from tabscout.session import written

MOST_CELLS = 1 << 18
CELL_ROWS = 1 << 14


def tree_cells(rows: int) -> int:
    return min(MOST_CELLS, max(16, rows // CELL_ROWS))


class Tree(NamedTuple):
    """Pivots sorted by branch: branch g holds pivots ``first[g]`` to ``first[g + 1]`` - 1."""

    tops: np.ndarray
    pivots: np.ndarray
    first: np.ndarray
    rows: np.ndarray | None = None  # of every cell
    radius: np.ndarray | None = None  # of every cell
    reach: np.ndarray | None = None  # of every branch

    def branches(self) -> range:
        return range(len(self.tops))

    def of(self, g: int) -> slice:
        return slice(self.first[g], self.first[g + 1])


def plant(pivots: np.ndarray, tops: int) -> Tree:
    """The first ``tops`` pivots become branches; every pivot goes to the nearest."""
    heads = pivots[:tops]
    branch = np.concatenate([_nearest(pivots[at:at + 4096], heads)[0] for at in range(0, len(pivots), 4096)])
    order = np.argsort(branch, kind="stable")
    return Tree(heads, pivots[order], np.searchsorted(branch[order], np.arange(tops + 1)))


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, angle from above) of the nearest pivot of every row."""
    s = np.round(x @ pivots.T, 6)
    best = s.argmax(axis=1)
    return best, np.arccos(np.clip(s[np.arange(len(s)), best] - SLACK, -1, 1))


def place(x: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(branch, angle to its top, cell, angle to its pivot) of every row."""
    branch, top_angle = _nearest(x, tree.tops)
    cell, angle = np.empty(len(x), np.int64), np.empty(len(x))
    for g in np.unique(branch):
        at = np.flatnonzero(branch == g)
        local, angle[at] = _nearest(x[at], tree.pivots[tree.of(g)])
        cell[at] = local + tree.first[g]
    return branch, top_angle, cell, angle


def _limit(angle: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Upper bound of the score of rows within ``radius`` of a pivot at that angle."""
    return np.cos(np.maximum(0.0, angle - radius - ANGLE_SLACK)) + SLACK


def visits(x: np.ndarray, floor: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, cell) that may hold one of the k best, and how many angles were looked at."""
    angles = lambda rows, pivots: np.arccos(np.clip(np.round(rows @ pivots.T, 6), -1, 1))
    open_ = _limit(angles(x, tree.tops), tree.reach) >= floor[:, None]
    row, col, looked = [], [], x.shape[0] * len(tree.tops)
    for g in tree.branches():
        at = np.flatnonzero(open_[:, g])
        cells = tree.of(g)
        if not len(at) or cells.start == cells.stop:
            continue
        looked += len(at) * (cells.stop - cells.start)
        good = (_limit(angles(x[at], tree.pivots[cells]), tree.radius[cells]) >= floor[at, None]) & (tree.rows[cells] > 0)
        i, j = np.nonzero(good)
        row.append(at[i])
        col.append(j + cells.start)
    empty = [np.empty(0, np.int64)]
    return np.concatenate(empty + row), np.concatenate(empty + col), looked


def grow(corpus: DataFrame, n_cells: int | None = None, n_tops: int | None = None) -> tuple[Tree, DataFrame]:
    """The tree and the stored corpus with its cells."""
    pivots = sample_pivots(corpus, n_cells or tree_cells(corpus.count()))
    tree = plant(pivots, min(len(pivots), n_tops or max(1, int(len(pivots) ** 0.5))))
    shipped = corpus.sparkSession.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            branch, top_angle, cell, angle = place(_matrix(batch.column("embedding")), shipped.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, (branch, top_angle, cell, angle))],
                [*batch.schema.names, "branch", "top_angle", "cell", "angle"])

    kinds = ", ".join(f"{c} {corpus.schema[c].dataType.simpleString()}" for c in ("table_id", "embedding"))
    cells = written(corpus.select("table_id", "embedding").mapInArrow(
        assign, f"{kinds}, branch bigint, top_angle double, cell bigint, angle double"), "cells")
    found = cells.groupBy("cell").agg(
        F.first("branch").alias("branch"), F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"), F.max("top_angle").alias("reach")).toArrow()
    rows, radius, reach = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(tree.tops))
    at = found["cell"].to_numpy()
    rows[at], radius[at] = found["n"].to_numpy(), found["radius"].to_numpy()
    np.maximum.at(reach, found["branch"].to_numpy(), found["reach"].to_numpy())
    return tree._replace(rows=rows, radius=radius, reach=reach), cells


def _probes(queries: DataFrame, tree: Tree, choose) -> DataFrame:
    """(query_id, cell) of what ``choose(vectors, floor, tree)`` names."""
    shipped = queries.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, cell = choose(_matrix(part.column("embedding")), part.column("floor").to_numpy(), shipped.value)[:2]
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(row)), pa.array(cell)], ["query_id", "cell"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return written(queries.select("query_id", "embedding", "floor").mapInArrow(run, f"query_id {kind}, cell bigint"), "visits")


def _own_cell(k: int):
    def choose(x: np.ndarray, floor: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
        """The nearest cell that can fill k, in the nearest branch."""
        branch = _nearest(x, tree.tops)[0]
        row, col = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for g in np.unique(branch):
            at = np.flatnonzero(branch == g)
            enough = np.flatnonzero(tree.rows[tree.of(g)] > k) + tree.first[g]
            if len(enough):
                row.append(at)
                col.append(enough[_nearest(x[at], tree.pivots[enough])[0]])
        return np.concatenate(row), np.concatenate(col)

    return choose


def tree_topk(
    queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = False, n_cells: int | None = None, n_tops: int | None = None,
    block_rows: int | None = None, query_block_rows: int | None = None, seed_rows: int = 4096,
) -> DataFrame:
    """(query_id, rank, table_id, score), exact; arguments as for ``search.exact_topk``."""
    if corpus.isEmpty() or queries.isEmpty():
        return scan_topk(queries.limit(0), corpus, k)
    queries = written(queries.select("query_id", "embedding"), "queries")
    tree, cells = grow(corpus, n_cells, n_tops)
    sizes = block_sizes(tree.tops.shape[1], block_rows, query_block_rows)
    open_ended = queries.withColumn("floor", F.lit(-2.0))
    # a lower limit of each k-th best score, from a sample of the query's own cell
    share = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / seed_rows).alias("share"))
    some = written(cells.select("table_id", "embedding", "cell").join(share, "cell").where(h(F.col("table_id"), "seed") % F.col("share") == 0).drop("share"), "seeds")
    seeds = probe_join(open_ended, _probes(open_ended, tree, _own_cell(k)), some, k, exclude_self, *sizes)
    floor = seeds.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    bounded = written(queries.join(floor, "query_id", "left").select(
        "query_id", "embedding", F.coalesce("floor", F.lit(-2.0)).alias("floor")), "floors")
    return rank(probe_join(bounded, _probes(bounded, tree, visits), cells, k, exclude_self, *sizes), k)
