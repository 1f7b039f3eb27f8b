"""Cosine top-k: exact, and approximate by probing the nearest cells.

Vectors are unit length. Scores are rounded to six digits, ties go to the smaller id, so results do
not depend on the order of summation. No pair of (query, table) leaves a task unless it is among the
k best of its block.

Few queries (proven by a bounded count) are sent to every task of one corpus scan. Otherwise the
corpus is stored in cells around pivots, and a task holds a block of queries of neighbouring cells and
reads the cells that can still hold one of their k best, nearest first, a bounded piece at a time: the
angle to any member of a cell is at least the angle to its pivot minus the cell's radius. Nothing is
copied per pair of blocks, so what is shuffled and stored grows with the tables and not with the pairs.
The result is exact whatever the data looks like; only the amount of pruning depends on it.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabscout.functions.hashing import h
from tabscout.session import scratch_path, written
from tabscout.sources.files import filesystem

DIGITS = 6
SLACK = 2e-6  # covers the rounding of scores
# near 1 the arc cosine magnifies a rounding of 1e-6 to about sqrt(2e-6)
ANGLE_SLACK = 3e-3
MOST_PIVOTS = 1024  # of a flat set of cells; larger corpora take a tree of pivots
_CHUNK = 1 << 21  # scores held at once
_TILE = 8192  # rows of the corpus that are scored at once
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}  # types of ids


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """An Arrow list column as a matrix, without a Python object per row."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), -1)


def _ids(values) -> np.ndarray:
    a = np.asarray(values.to_numpy(zero_copy_only=False) if isinstance(values, pa.Array) else values.to_numpy())
    return a.astype(str) if a.dtype == object else a


def _first_k(row, val, tie, k: int) -> np.ndarray:
    """Positions of the k best entries of each row by (value descending, tie ascending)."""
    o = np.lexsort((tie, -val, row))
    return o[np.arange(len(o)) - np.searchsorted(row[o], row[o]) < k]


def _set(mask: np.ndarray) -> np.ndarray:
    """Flat positions that are true, where few are: eight are looked at at once."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    near = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return near[flat[near]]


def _select(q_ids, q, c_ids, c, k: int, exclude_self: bool, floor=None) -> Iterator[tuple]:
    """k best of one corpus block for each query: (query rows, table ids, scores) per chunk.

    ``floor`` is a lower limit of each query's k-th best score, if one is known. Scores are made a tile of the
    block at a time, so that queries, tile and scores stay in the processor's caches; what a tile finds raises the
    limit for the next ones.
    """
    if not len(q_ids) or not len(c_ids):
        return
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    q4, c4 = q.astype(np.float32), c.T.astype(np.float32)
    slack = np.float32(SLACK + 1e-7 * (c.shape[1] + 16))  # single precision is off by less than this
    n = len(c_ids)
    step = max(1, _CHUNK // min(n, _TILE))
    for at in range(0, len(q_ids), step):
        ids = q_ids[at:at + step]
        if exclude_self:
            own = np.minimum(np.searchsorted(c_ids, ids), n - 1)
            own[c_ids[own] != ids] = -1
        cut = np.full(len(ids), -2, np.float32) if floor is None else floor[at:at + step].astype(np.float32) - slack
        best = []
        for begin in range(0, n, _TILE):
            s = q4[at:at + step] @ c4[:, begin:begin + _TILE]
            width = s.shape[1]
            if exclude_self:
                hit = np.flatnonzero((own >= begin) & (own < begin + width))
                s[hit, own[hit] - begin] = -np.inf
            found = _set(s >= cut[:, None])
            if width > k and len(found) > 8 * k * len(ids):  # the limit does not help: find the k-th best
                cut = np.maximum(cut, np.partition(s, width - k, axis=1)[:, width - k] - 2 * slack)
                found = _set(s >= cut[:, None])
            row, col = np.divmod(found, width)
            col += begin
            # what may be among the best is scored again in double precision
            val = np.round(np.einsum("ij,ij->i", q[at + row], c[col]), DIGITS) + 0.0
            best.append((row, col, val))
            if begin + width >= n or sum(len(b[0]) for b in best) > 4 * k * len(ids):
                row, col, val = _join(best)
                keep = _first_k(row, val, col, k)
                best = [(row[keep], col[keep], val[keep])]
                cut = np.maximum(cut, _floor((row[keep], None, val[keep]), len(ids), k).astype(np.float32) - slack)
        row, col, val = best[0]
        yield at + row, c_ids[col], val


def _join(parts) -> tuple | None:
    parts = list(parts)
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else None


_NAMES = ["query_id", "table_id", "score"]


def _result(q_ids, found: tuple) -> list[pa.Array]:
    row, ids, val = found
    return [pa.array(q_ids[row]), pa.array(ids), pa.array(val)]


def _schema(queries: DataFrame, corpus: DataFrame) -> str:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return f"query_id {kind(queries, 'query_id')}, table_id {kind(corpus, 'table_id')}, score double"


def rank(scored: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Best k per query; the window limit runs before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "table_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        *keys, "rank", "table_id", "score"
    )


def _floor(best: tuple | None, n: int, k: int) -> np.ndarray:
    """The k-th best score of each of n queries, -2 where fewer than k are known."""
    floor = np.full(n, -2.0)
    if best is not None:
        full = np.bincount(best[0], minlength=n) >= k
        worst = np.full(n, np.inf)
        np.minimum.at(worst, best[0], best[2])
        floor[full] = worst[full]
    return floor


def scan_topk(
    queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = False, seed_rows: int = 2048
) -> DataFrame:
    """One scan of the corpus with all queries in each task; for query sets of checked size only.

    Any few rows of the corpus give a lower limit of each query's k-th best score. Tasks start from
    it, so that they put out little more than the result and not k rows per query each.
    """
    local = queries.select("query_id", "embedding").toArrow()
    if not len(local):
        return queries.sparkSession.createDataFrame([], _schema(queries, corpus) + ", rank int").select(
            "query_id", "rank", "table_id", "score"
        )
    q_ids, q = _ids(local["query_id"]), _matrix(local["embedding"])
    some = corpus.select("table_id", "embedding").limit(seed_rows).toArrow()
    seeds = _join(_select(q_ids, q, _ids(some["table_id"]), _matrix(some["embedding"]), k, exclude_self)) if len(some) else None
    shipped = queries.sparkSession.sparkContext.broadcast((q_ids, q, _floor(seeds, len(q_ids), k)))

    def scan(batches):
        q_ids, q, start = shipped.value
        best, floor = None, start
        for batch in batches:
            c_ids, c = _ids(batch.column("table_id")), _matrix(batch.column("embedding"))
            new = _join(_select(q_ids, q, c_ids, c, k, exclude_self, floor))
            if new is None:
                continue
            if best is not None:
                new = _join([best, new])
                keep = _first_k(new[0], new[2], new[1], k)
                new = tuple(x[keep] for x in new)
            best, floor = new, np.maximum(start, _floor(new, len(q_ids), k))
        if best is not None:
            yield pa.RecordBatch.from_arrays(_result(q_ids, best), _NAMES)

    scored = corpus.select("table_id", "embedding").mapInArrow(scan, _schema(queries, corpus))
    return rank(scored, k)


# --- cells ------------------------------------------------------------------------------------

def sample_pivots(corpus: DataFrame, n: int) -> np.ndarray:
    """n vectors chosen by the hash of their id (n x dim numbers on the driver)."""
    key = h(F.col("table_id"))
    rows = (
        corpus.select("table_id", "embedding", key.alias("_h")).orderBy("_h", "table_id").limit(n)
        .select("embedding").collect()
    )
    return np.array([r[0] for r in rows], dtype=np.float64)


def kmeans_pivots(corpus: DataFrame, n: int, seed: int = 42) -> np.ndarray:
    """Unit-length k-means centres, fitted on the cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    fit = KMeans(k=n, seed=seed, featuresCol="_v").fit(
        corpus.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("_v"))
    )
    centres = np.array(fit.clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def _similar(vectors, pivots: np.ndarray) -> np.ndarray:
    return np.round(_matrix(vectors) @ pivots.T, DIGITS)


def assign_cells(corpus: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(table_id, embedding, cell, angle): the nearest pivot and the angle to it."""
    shipped = corpus.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches):
        for batch in batches:
            s = _similar(batch.column("embedding"), shipped.value)
            cell = s.argmax(axis=1)
            top = s[np.arange(len(cell)), cell]
            angle = np.arccos(np.clip(top - SLACK, -1, 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], [*batch.schema.names, "cell", "angle"]
            )

    kind = corpus.schema["table_id"].dataType.simpleString()
    vec = corpus.schema["embedding"].dataType.simpleString()
    return corpus.select("table_id", "embedding").mapInArrow(
        assign, f"table_id {kind}, embedding {vec}, cell int, angle double"
    )


def _probe(queries: DataFrame, choose) -> DataFrame:
    """(query_id, cell) for the cells that ``choose`` (a queries x cells mask) names; ids only."""

    def run(batches):
        for batch in batches:
            row, col = np.nonzero(choose(batch.column("embedding"), batch.column("floor").to_numpy()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(pa.array(row)), pa.array(col.astype(np.int32))], ["query_id", "cell"]
            )

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "embedding", "floor").mapInArrow(run, f"query_id {kind}, cell int")


def _block_topk(
    visits: DataFrame, queries: DataFrame, blocks: DataFrame, n_blocks: list[int], k: int, n_query_blocks: int,
    exclude_self: bool,
) -> DataFrame:
    """Score each query against the corpus blocks of the cells it visits; both sides of a group are
    bounded. Visits are stored as ids; a corpus block is copied to the query blocks that visit its
    cell and to no others."""
    keys = ["cell", "block", "qblock"]
    spark = visits.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    visits = written(visits.withColumn("qblock", (h(F.col("query_id")) % n_query_blocks).cast("int")), "visits")
    per_cell = F.get(F.array(*map(F.lit, n_blocks)), F.col("cell"))
    left = visits.join(queries, "query_id").withColumn("block", F.explode(F.sequence(F.lit(0), per_cell - 1)))
    right = blocks.join(visits.select("cell", F.col("qblock").alias("qblock")).distinct(), "cell")

    schema = _schema(queries, blocks)
    empty = pa.schema([("query_id", _ARROW[schema.split()[1].rstrip(",")]), ("table_id", _ARROW[schema.split()[3].rstrip(",")]),
                       ("score", pa.float64())]).empty_table()

    def score(q: pa.Table, c: pa.Table) -> pa.Table:
        if not len(q) or not len(c):
            return empty
        q_ids = _ids(q["query_id"])
        found = _join(_select(
            q_ids, _matrix(q["embedding"]), _ids(c["table_id"]), _matrix(c["embedding"]), k, exclude_self,
            q["floor"].to_numpy(),
        ))
        return pa.Table.from_arrays(_result(q_ids, found), _NAMES) if found is not None else empty

    return (
        left.select(*keys, "query_id", "embedding", "floor").repartition(parts, *keys).groupBy(*keys)
        .cogroup(right.select(*keys, "table_id", "embedding").repartition(parts, *keys).groupBy(*keys))
        .applyInArrow(score, schema)
    )


def _cut_blocks(assigned: DataFrame, n_blocks: list[int]) -> DataFrame:
    per_cell = F.get(F.array(*map(F.lit, n_blocks)), F.col("cell"))
    return assigned.withColumn("block", (h(F.col("table_id"), "block") % per_cell).cast("int"))


def _cells(corpus: DataFrame, pivots: np.ndarray, block_rows: int):
    """Blocks of the corpus and, per cell, its size, radius and number of blocks."""
    assigned = written(assign_cells(corpus, pivots), "cells")
    found = {
        r["cell"]: r for r in
        assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()
    }  # one row per pivot
    sizes = np.array([found[c]["n"] if c in found else 0 for c in range(len(pivots))])
    radius = np.array([found[c]["radius"] if c in found else 0.0 for c in range(len(pivots))])
    n_blocks = [max(1, int(-(-s // block_rows))) for s in sizes]
    return _cut_blocks(assigned, n_blocks), sizes, radius, n_blocks


def _merge(best: tuple | None, new: tuple, n: int, k: int) -> tuple:
    """The k best of each of n queries, where ``new`` has better ones; other rows are left as they are."""
    if best is None:
        return new
    touched = np.zeros(n, dtype=bool)
    touched[new[0]] = True
    again = touched[best[0]]
    both = _join([tuple(x[again] for x in best), new])
    keep = _first_k(both[0], both[2], both[1], k)
    return _join([tuple(x[~again] for x in best), tuple(x[keep] for x in both)])


def _arrow_knows(path: str) -> bool:
    try:
        filesystem(path)
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def _stored_topk(
    queries: DataFrame, corpus: DataFrame, path: str, k: int, exclude_self: bool, pivots: np.ndarray, block_rows: int,
    query_block_rows: int,
) -> DataFrame:
    """Exact top-k: blocks of queries against the cells stored under ``path``, which their tasks read.

    A task holds at most twice ``query_block_rows`` queries with their k best and ``block_rows`` rows (and
    a row group) of a cell. Each cell read raises the limits that later cells must reach.
    """
    spark = corpus.sparkSession
    cores = spark.sparkContext.defaultParallelism
    parts = max(cores, -(-corpus.count() // block_rows))
    (
        assign_cells(corpus, pivots).repartitionByRange(parts, "cell", h(F.col("table_id"))).sortWithinPartitions("cell")
        .write.option("parquet.block.size", 1 << 23).parquet(path)
    )
    found = spark.read.parquet(path).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()
    radius = {r["cell"]: r["radius"] for r in found if r["n"]}  # one row per pivot at most
    shipped = spark.sparkContext.broadcast((pivots, radius))
    known = queries.where(F.col("query_id").isNotNull())
    n_queries = known.count()
    kind = queries.schema["query_id"].dataType.simpleString()
    repeated = not known.groupBy("query_id").count().where("count > 1").isEmpty()
    if repeated:  # a row for every pair of rows of one id, as where ids are joined with vectors
        copies = known.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
        known = known.join(copies, "query_id").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n")
    placed = assign_cells(known.select(F.col("query_id").alias("table_id"), "embedding"), pivots)
    tasks = max(min(cores, n_queries), -(-n_queries // query_block_rows), 1)
    tasks = -(-tasks // cores) * cores if tasks > cores else tasks  # whole rounds over the cores
    dealt = placed.select(F.col("table_id").alias("query_id"), "embedding", "cell").repartitionByRange(
        tasks, "cell", h(F.col("query_id"))).select("query_id", "embedding")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, query_block_rows):
                held.append(batch.slice(at, query_block_rows))
                n += held[-1].num_rows
                if n >= 2 * query_block_rows:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    def pieces(stored, cell: int) -> Iterator[pa.Table]:
        import pyarrow.dataset as ds

        held, n = [], 0
        for batch in stored.to_batches(
            columns=["table_id", "embedding"], filter=ds.field("cell") == cell, batch_size=block_rows,
            batch_readahead=1, fragment_readahead=1, use_threads=False,
        ):
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= block_rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        pivots, radius = shipped.value
        where, inner = filesystem(path)
        stored = None
        for block in blocks(batches):
            if stored is None:
                stored = ds.dataset(inner, filesystem=where, format="parquet")
            q_ids, q = _ids(block["query_id"]), _matrix(block["embedding"])
            best, floor = None, np.full(len(q), -2.0)
            for cell in np.argsort(-(pivots @ q.mean(axis=0)), kind="stable"):
                if cell not in radius:
                    continue
                angle = np.arccos(np.clip(np.round(q @ pivots[cell], DIGITS), -1, 1))
                limit = np.cos(np.maximum(0.0, angle - radius[cell] - ANGLE_SLACK)) + SLACK
                if not (limit >= floor).any():
                    continue
                for piece in pieces(stored, int(cell)):
                    at = np.flatnonzero(limit >= floor)
                    new = _join(_select(
                        q_ids[at], q[at], _ids(piece["table_id"]), _matrix(piece["embedding"]), k, exclude_self, floor[at]))
                    if new is not None and len(new[0]):
                        best = _merge(best, (at[new[0]], new[1], new[2]), len(q), k)
                        floor = _floor(best, len(q), k)
            if best is None:
                continue
            row, ids, val = best
            order = np.lexsort((ids, -val, row))
            row, ids, val = row[order], ids[order], val[order]
            place = (np.arange(len(row)) - np.searchsorted(row, row) + 1).astype(np.int32)
            for at in range(0, len(row), 1 << 16):
                cut = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[row[cut]]), pa.array(place[cut]), pa.array(ids[cut]), pa.array(val[cut])],
                    ["query_id", "rank", "table_id", "score"])

    of = corpus.schema["table_id"].dataType.simpleString()
    best = dealt.mapInArrow(scan, f"query_id {kind}, rank int, table_id {of}, score double")
    return rank(best.drop("rank"), k) if repeated else best


def cells_for(rows: int) -> int:
    """Pivots for a corpus of that size: cells of some 16,000 rows, 16 to MOST_PIVOTS of them."""
    return min(MOST_PIVOTS, max(16, rows // 16384))


def cell_topk(
    queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = False, pivots: np.ndarray | None = None,
    n_pivots: int | None = None, block_rows: int | None = None, query_block_rows: int | None = None,
    n_probe: int | None = None, seed_rows: int = 4096,
) -> DataFrame:
    """Top-k through cells; exact without ``n_probe``, else over the ``n_probe`` nearest cells.

    A block holds some 4 million numbers of the corpus and 1 million of the queries unless its rows
    are given, so a task's memory depends neither on the data nor on the dimension.
    """
    if pivots is None:
        pivots = sample_pivots(corpus, n_pivots or cells_for(corpus.count()))
    if not len(pivots):  # an empty corpus
        return scan_topk(queries.limit(0), corpus, k)
    block_rows = block_rows or max(1024, (1 << 22) // pivots.shape[1])
    query_block_rows = query_block_rows or max(256, (1 << 20) // pivots.shape[1])
    blocks, sizes, radius, n_blocks = _cells(corpus, pivots, block_rows)
    n_query_blocks = max(1, -(-queries.count() // query_block_rows))
    open_ended = queries.select("query_id", "embedding", F.lit(-2.0).alias("floor"))

    if n_probe is not None:
        def nearest(vectors, floor):
            s = _similar(vectors, pivots)
            mask = np.zeros(s.shape, dtype=bool)
            np.put_along_axis(mask, np.argsort(-s, axis=1, kind="stable")[:, :n_probe], True, axis=1)
            return mask

        return rank(_block_topk(_probe(open_ended, nearest), open_ended, blocks, n_blocks, k, n_query_blocks, exclude_self), k)

    # a lower limit for each query's k-th best: a sample of the nearest cell that can fill k
    share = F.get(F.array(*[F.lit(max(1, int(-(-n // seed_rows)))) for n in sizes]), F.col("cell"))
    sample = blocks.filter(h(F.col("table_id"), "seed") % share == 0).withColumn("block", F.lit(0))
    enough = np.nonzero(sizes > k)[0]

    def first(vectors, floor):
        mask = np.zeros((len(vectors), len(pivots)), dtype=bool)
        if len(enough):
            mask[np.arange(len(mask)), enough[_similar(vectors, pivots[enough]).argmax(axis=1)]] = True
        return mask

    seeds = _block_topk(
        _probe(open_ended, first), open_ended, sample, [1] * len(pivots), k, n_query_blocks, exclude_self
    )
    floor = seeds.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("_floor")
    )  # at most k rows per query

    def reachable(vectors, floor):
        angle = np.arccos(np.clip(_similar(vectors, pivots), -1, 1))
        limit = np.cos(np.maximum(0.0, angle - radius[None, :] - ANGLE_SLACK)) + SLACK
        return (limit >= floor[:, None]) & (sizes > 0)[None, :]

    bounded = queries.join(floor, "query_id", "left").select(
        "query_id", "embedding", F.coalesce("_floor", F.lit(-2.0)).alias("floor")
    )
    bounded = written(bounded, "floors")
    return rank(_block_topk(_probe(bounded, reachable), bounded, blocks, n_blocks, k, n_query_blocks, exclude_self), k)


def stored_topk(
    queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = False, pivots: np.ndarray | None = None,
    n_pivots: int | None = None, block_rows: int | None = None, query_block_rows: int | None = None, **cells,
) -> DataFrame:
    """Exact top-k by tasks that read cells from the shared folder; arguments as for ``cell_topk``, which is
    taken where Arrow cannot read that folder."""
    if pivots is None:
        pivots = sample_pivots(corpus, n_pivots or cells_for(corpus.count()))
    path = scratch_path(corpus.sparkSession, "cells")
    if not len(pivots) or "n_probe" in cells or not _arrow_knows(path):
        return cell_topk(queries, corpus, k, exclude_self, pivots, block_rows=block_rows, query_block_rows=query_block_rows, **cells)
    sizes = block_rows or max(1024, (1 << 22) // pivots.shape[1]), query_block_rows or max(256, (1 << 20) // pivots.shape[1])
    return _stored_topk(queries, corpus, path, k, exclude_self, pivots, *sizes)


def _whole(queries: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides without null vectors, vectors with a null, and lengths other than the commonest."""
    filled = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull())
    corpus, queries = corpus.where(filled), queries.where(filled)
    sizes = corpus.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return queries, corpus
    return queries.where(F.size("embedding") == sizes[0].n), corpus.where(F.size("embedding") == sizes[0].n)


def exact_topk(
    queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = False,
    broadcast_values: int = 2_000_000, **cells,
) -> DataFrame:
    """(query_id, rank, table_id, score), exact.

    ``queries(query_id, embedding)``, ``corpus(table_id, embedding)``, ids unique, vectors of unit
    length or zero; rows without a whole vector take no part. The query set is broadcast only when a bounded count shows that its vectors hold at most
    ``broadcast_values`` numbers (16 MB).
    """
    queries, corpus = _whole(queries, corpus)
    one = queries.select(F.size("embedding")).first()
    most = broadcast_values // max(1, one[0] if one else 1)
    if queries.select("query_id").limit(most + 1).count() <= most:
        return scan_topk(queries, corpus, k, exclude_self)
    if not cells and cells_for(corpus.count()) >= MOST_PIVOTS:
        from tabscout.operators.pivot_tree import tree_topk  # builds on this module

        return tree_topk(queries, corpus, k, exclude_self)
    return stored_topk(queries, corpus, k, exclude_self, **cells)


def approx_topk(
    queries: DataFrame, corpus: DataFrame, k: int, n_probe: int = 4, n_pivots: int | None = None,
    exclude_self: bool = False, centres: str = "sample", **cells,
) -> DataFrame:
    """Top-k among the tables of the ``n_probe`` cells nearest to the query, scores exact."""
    queries, corpus = _whole(queries, corpus)
    n_pivots = n_pivots or max(16, int(corpus.count() ** 0.5))
    make = {"sample": sample_pivots, "kmeans": kmeans_pivots}[centres]
    return cell_topk(queries, corpus, k, exclude_self, pivots=make(corpus, n_pivots), n_probe=n_probe, **cells)


def recall_against(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Per query: the share of its exact top k that was found."""
    hit = found.select("query_id", "table_id").withColumn("hit", F.lit(1))
    return (
        exact.filter(F.col("rank") <= k).join(hit, ["query_id", "table_id"], "left").groupBy("query_id")
        .agg(F.count("hit").cast("bigint").alias("found"), F.count(F.lit(1)).alias("wanted"))
        .withColumn("recall", F.round(F.col("found") / F.col("wanted"), DIGITS))
    )


# --- similar tables ---------------------------------------------------------------------------

def valid_tables(rows: DataFrame, table: str, min_rows: int) -> DataFrame:
    """Tables with at least ``min_rows`` row documents."""
    return rows.groupBy(table).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") >= min_rows)


def similar_tables(vectors: DataFrame, valid: DataFrame, k: int, queries: DataFrame | None = None, **cells) -> DataFrame:
    """For each query table its k best others among k + 1 hits; invalid hits are not replaced."""
    if queries is None:
        queries = vectors.select(F.col("table_id").alias("query_id"), "embedding")
    hits = exact_topk(queries, vectors, k + 1, **cells)
    kept = hits.filter(F.col("table_id") != F.col("query_id")).join(
        valid.select("table_id").hint("merge"), "table_id", "left_semi"  # small when shuffled, not in memory
    )
    return rank(kept.drop("rank"), k)


_FK_WORDS = "id|key|code|ref"  # fixed values


def pair_evidence(pairs: DataFrame, tables: DataFrame, a: str = "query_id", b: str = "table_id") -> DataFrame:
    """Why two tables look alike. ``tables(table_id, columns, first_row)``, first_row null if empty."""
    side = lambda name, p: tables.select(
        F.col("table_id").alias(name), F.col("columns").alias(f"{p}cols"), F.col("first_row").alias(f"{p}row")
    )
    joined = pairs.join(side(a, "_a").hint("merge"), a).join(side(b, "_b").hint("merge"), b)
    both = F.col("_arow").isNotNull() & F.col("_brow").isNotNull()
    shared = F.when(both, F.array_sort(F.array_intersect("_acols", "_bcols"))).otherwise(F.array().cast("array<string>"))
    joined = joined.withColumn("_shared", shared)

    def cell(p, c):
        return F.get(f"{p}row", F.array_position(F.col(f"{p}cols"), c).cast("int") - 1)

    keys = F.filter("_shared", lambda c: F.lower(c).rlike(_FK_WORDS))
    same = F.filter("_shared", lambda c: (cell("_a", c) != "") & (cell("_a", c) == cell("_b", c)))
    match = F.get(same, 0)
    match_value = F.get("_arow", F.array_position(F.col("_acols"), match).cast("int") - 1)
    parts = F.concat_ws(
        " | ",
        F.when(F.size("_shared") > 0, F.concat(F.lit("shared_columns:"), F.array_join("_shared", ","))),
        F.when(F.size(keys) > 0, F.concat(F.lit("potential_fk:"), F.array_join(keys, ","))),
        F.when(match.isNotNull(), F.concat(F.lit("value_match:"), match, F.lit("="), match_value)),
    )
    return joined.withColumn(
        "evidence", F.when(parts == "", F.lit("embedding_similarity_only")).otherwise(parts)
    ).drop("_acols", "_bcols", "_arow", "_brow", "_shared")
