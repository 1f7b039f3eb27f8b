"""Approximate nearest neighbours over learned partitions.

1. A bounded sample of distinct vectors gives a neighbour graph. The graph is cut into balanced parts:
   parts grown along the graph, then moves to the part that holds most of a vector's neighbours, as
   long as there is room.
2. A small classifier (one hidden layer) learns which parts hold a vector's neighbours. Its first
   choice puts every row of the table into a part.
3. A query goes to its most probable parts, until their probabilities add up to a level at which
   sampled vectors kept out of the fit found ``target`` of their sampled neighbours, and until the
   parts hold enough rows. Parts are cut into blocks; every (block of rows, block of queries) is one
   matrix product, which sends on the best of each query. The first part limits what the others
   send. All scores are exact inner products.

Equal vectors are one candidate that stands for its k + 1 smallest ids, which is all that can be
reported, so a vector that fills a third of the table costs one row. Rows with a null id, and vectors
that are null, zero, of an uncommon length or hold null or non-finite components take no part. Ties
go to the smaller id. Of rows that repeat an id each is a candidate. An empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabscout.session import ship, written

SAMPLE_NUMBERS = 1 << 18  # at most so many numbers in the sample: 4096 vectors of 64
ROWS_PER_PART = 1500
MOST_PARTS = 128
BLOCK_ROWS = 8192
BLOCK_QUERIES = 4096
TARGET = 0.96


def nearest(x: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Places of the k + 1 largest inner products for rows of ``x`` numbered ``queries``, itself left out."""
    out = []
    for at in np.array_split(queries, max(1, len(queries) // 128)):
        scores = x[at] @ x.T
        scores[np.arange(len(at)), at] = -np.inf
        out.append(np.argpartition(scores, -k, axis=1)[:, -k:])
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1, seed: int = 3) -> np.ndarray:
    """A part for every node of the neighbour graph, none over ``slack`` times the mean."""
    n = len(graph)
    room = int(np.ceil(n / parts * slack))
    rng = np.random.default_rng(seed)
    part = np.full(n, -1)
    queue: list[int] = []
    now, held, starts = 0, 0, iter(rng.permutation(n))
    for _ in range(n):
        while queue and part[queue[0]] >= 0:
            queue.pop(0)
        node = queue.pop(0) if queue else next(s for s in starts if part[s] < 0)
        part[node] = now
        held += 1
        queue += [x for x in graph[node] if part[x] < 0][:6]
        if held >= n / parts and now < parts - 1:
            now, held, queue = now + 1, 0, []
    sizes = np.bincount(part, minlength=parts)
    both = np.concatenate((np.stack((np.repeat(np.arange(n), graph.shape[1]), graph.ravel()), 1),
                           np.stack((graph.ravel(), np.repeat(np.arange(n), graph.shape[1])), 1)))
    for _ in range(rounds):
        votes = np.bincount(both[:, 0] * parts + part[both[:, 1]], minlength=n * parts).reshape(n, parts)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        moved = 0
        for node in np.argsort(-gain, kind="stable"):
            if gain[node] <= 0:
                break
            if sizes[best[node]] < room:
                sizes[part[node]] -= 1
                sizes[best[node]] += 1
                part[node] = best[node]
                moved += 1
        if moved < n / 500:
            break
    return part


class Router:
    """Probabilities of parts from one hidden layer."""

    def __init__(self, dim: int, parts: int, hidden: int = 128, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, (2 / dim) ** 0.5, (dim, hidden)), np.zeros(hidden),
                  rng.normal(0, 0.01, (hidden, parts)), np.zeros(parts)]
        self.scale, self.level, self.sizes = 1.0, 1.0, np.zeros(parts, np.int64)

    def _forward(self, x: np.ndarray):
        x = x * self.scale
        h = np.maximum(x @ self.p[0] + self.p[1], 0)
        z = h @ self.p[2] + self.p[3]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return x, h, e / e.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[2]

    def fit(self, x: np.ndarray, wanted: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 2e-3) -> None:
        rng = np.random.default_rng(9)
        self.scale = 1 / max(float(np.sqrt((x * x).sum(axis=1).mean() / x.shape[1])), 1e-300)
        first, second, turn = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                turn += 1
                inputs, h, p = self._forward(x[at])
                d = (p - wanted[at]) / len(at)
                dh = (d @ self.p[2].T) * (h > 0)
                grads = [inputs.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0)]
                for i, g in enumerate(grads):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.p[i] -= rate * first[i] / (1 - 0.9 ** turn) / (np.sqrt(second[i] / (1 - 0.999 ** turn)) + 1e-8)

    def parts(self, x: np.ndarray) -> np.ndarray:
        return self.probabilities(x).argmax(axis=1)

    def probes(self, x: np.ndarray, least_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query places, parts to look at, their rank for the query)."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, order, 1), axis=1) - np.take_along_axis(p, order, 1)
        rows = self.sizes[order]
        rows_before = np.cumsum(rows, axis=1) - rows
        take = ((before < self.level) | (rows_before < least_rows)) & (rows > 0)
        who, place = np.nonzero(take)
        return who, order[who, place], place


def learn(x: np.ndarray, rows: int, k: int, target: float) -> Router:
    """The router for a table of ``rows`` distinct vectors from a sample of them."""
    n, dim = x.shape
    k = min(k, n - 1)
    parts = int(np.clip(-(-rows // ROWS_PER_PART), 1, min(MOST_PARTS, max(1, n // 32))))
    router = Router(dim, parts)
    if parts == 1 or k < 1:
        return router
    graph = nearest(x, np.arange(n), k)
    part = balanced_parts(graph, parts)
    wanted = np.zeros((n, parts))
    np.add.at(wanted, (np.repeat(np.arange(n), k), part[graph].ravel()), 0.5 / k)
    wanted[np.arange(n), part] += 0.5
    out = np.arange(n) % 8 == 0  # these only tell how far to look
    router.fit(x[~out], wanted[~out])
    own = router.parts(x)
    p = router.probabilities(x[out])
    order = np.argsort(-p, axis=1, kind="stable")
    found = (own[graph[out]][:, :, None] == order[:, None, :]).mean(axis=1)  # share of neighbours by rank of part
    sums = np.cumsum(np.take_along_axis(p, order, 1), axis=1)
    before = sums - np.take_along_axis(p, order, 1)
    levels = np.unique(np.concatenate((1 - np.logspace(-6, -0.05, 60), [1.0])))
    recalls = [float((found * (before < level)).sum(axis=1).mean()) for level in levels]
    router.level = float(next((level for level, r in zip(levels, recalls) if r >= target), 2.0))
    return router


def _matrix(column) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False) if n else np.empty(0)
    return np.asarray(flat, np.float64).reshape(n, -1)


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v): rows that take part, components as doubles."""
    v = F.col(column).cast("array<double>")
    good = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0"
    ).where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.where(F.size("v") == (lengths[0].n if lengths else 0))


def search(vectors: DataFrame, is_query: Column, k: int = 20, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best found for every row that ``is_query`` (on vec_id) marks."""
    spark = ship(vectors.sparkSession)
    rows = written(usable(vectors), "vectors")
    # Equal vectors: the k + 1 smallest ids; the limit is taken before the shuffle.
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    limited = rows.withColumn("_n", F.row_number().over(by_vector)).where(F.col("_n") <= k + 1)
    distinct = written(
        limited.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "v"),
        "distinct")
    asked = written(
        rows.where(is_query).join(distinct.select("rep", "v"), "v").select(F.col("vec_id").alias("query_id"), "rep"), "queries")
    n = distinct.count()
    dim = distinct.select(F.size("v").alias("n")).first()
    if n == 0:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = distinct.select("v", F.xxhash64("rep").alias("h"), "rep").orderBy("h", "rep").limit(max(256, SAMPLE_NUMBERS // dim.n)).select("v")
    x = _matrix(sample.toArrow().column("v").combine_chunks())
    router = learn(x, n, k, target)

    placed = written(distinct.select("rep", "v").mapInArrow(_placing(router), "rep bigint, part int, v array<double>"), "placed")
    for row in placed.groupBy("part").count().collect():  # at most MOST_PARTS rows
        router.sizes[row.part] = row["count"]
    queries = distinct.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "v")
    probing = written(queries.mapInArrow(_probing(router, 4 * (k + 1)), "rep bigint, part int, place int, v array<double>"), "probing")
    first = F.min("place").over(Window.partitionBy("rep"))
    probing = written(probing.withColumn("first", F.col("place") == first), "probing")

    # The most probable part gives each query a lower limit; other parts send what reaches it.
    seeds = written(_scored(placed, probing.where("first").withColumn("floor", F.lit(float("-inf"))), k + 1), "seeds")
    enough = F.when(F.count(F.lit(1)) > k, F.min("score")).otherwise(float("-inf"))
    floor = seeds.groupBy("query").agg(enough.alias("floor"))
    others = probing.where("not first").join(floor, F.col("rep") == F.col("query")).drop("query")
    scored = seeds.unionByName(_scored(placed, written(others, "others"), k + 1))
    top = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    reps = scored.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= k + 1).drop("_n")
    each = reps.join(distinct.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = written(each.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n"), "found")
    # One of the k + 1 may be the query itself; of a repeated id only that one row goes.
    own = asked.join(found, asked["rep"] == found["query"]).select("query_id", "vec_id", "score")
    itself = Window.partitionBy("query_id", "vec_id").orderBy("score")
    answered = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        own.withColumn("_same", F.row_number().over(itself))
        .where((F.col("vec_id") != F.col("query_id")) | (F.col("_same") > 1)).drop("_same")
        .withColumn("rank", F.row_number().over(answered)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _scored(placed: DataFrame, probing: DataFrame, k: int) -> DataFrame:
    """(query, rep, score): the k best of every block of rows for the queries that probe its part."""

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    grid = written(blocks(placed, BLOCK_ROWS, "row_blocks").join(blocks(probing, BLOCK_QUERIES, "query_blocks"), "part"), "grid")

    def dealt(df: DataFrame, own: str, other: str, *columns: str) -> DataFrame:
        spread = df.join(grid, "part").withColumn("_own", F.pmod(F.xxhash64("rep"), F.col(own)).cast("int"))
        spread = spread.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        pair = ("_own", "_other") if own == "row_blocks" else ("_other", "_own")
        return spread.select("part", F.col(pair[0]).alias("row_block"), F.col(pair[1]).alias("query_block"), "rep", "v", *columns)

    cell = ["part", "row_block", "query_block"]
    return (
        dealt(placed, "row_blocks", "query_blocks").groupBy(*cell)
        .cogroup(dealt(probing, "query_blocks", "row_blocks", "floor").groupBy(*cell))
        .applyInArrow(_best(k), "query bigint, rep bigint, score double")
    )


def _placing(router: Router):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = router.parts(_matrix(batch.column("v"))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), pa.array(parts.astype(np.int32)), batch.column("v")], ["rep", "part", "v"])

    return place


def _probing(router: Router, least_rows: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            who, part, place = router.probes(_matrix(batch.column("v")), least_rows)
            taken = batch.take(pa.array(who))
            yield pa.RecordBatch.from_arrays(
                [taken.column("rep"), pa.array(part.astype(np.int32)), pa.array(place.astype(np.int32)), taken.column("v")],
                ["rep", "part", "place", "v"])

    return probe


def _best(k: int):
    def best(_key, rows, queries):
        names = ["query", "rep", "score"]
        if not rows.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        reps = rows.column("rep").to_numpy()
        order = np.argsort(reps)
        reps, x = reps[order], _matrix(rows.column("v").combine_chunks())[order]
        asking, q = queries.column("rep").to_numpy(), _matrix(queries.column("v").combine_chunks())
        floor = queries.column("floor").to_numpy()
        out: list[tuple] = []
        for at in range(0, len(q), 512):
            scores = q[at:at + 512] @ x.T
            least = floor[at:at + 512]
            if len(reps) > k:
                least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
            who, place = np.nonzero(scores >= least[:, None])
            value = scores[who, place]
            rank = np.lexsort((place, -value, who))  # reps ascend with place
            who, place, value = who[rank], place[rank], value[rank]
            inside = np.arange(len(who)) - np.searchsorted(who, who)
            keep = inside < k
            out.append((asking[at + who[keep]], reps[place[keep]], value[keep]))
        return pa.table([np.concatenate(c) for c in zip(*out)], names=names)

    return best
