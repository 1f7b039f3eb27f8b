"""Hard negatives by threshold joins over an inverted index with norm bounds.

Anchors are a stated part of the rows. An anchor's positives are its best rows of the same label; a
negative of an anchor and a positive is a row of another label whose score lies in a window below the
positive's score. Scores are exact integer inner products.

Both searches are joins by a threshold for each anchor. Rows are dealt over blocks of bounded size, and
so are anchors; a task gets one block of each. It orders dimensions by energy and indexes a block's rows
by groups of dimensions, leaving out those from which on a row's remaining norm cannot lift any product
to the threshold. Groups are accumulated one after the other; a pair leaves when its partial score plus
the product of both remaining norms stays below its anchor's threshold, and what is still there is
completed exactly. A task starts with high thresholds and lowers them for the anchors whose positives or
windows are not full yet. Blocks that make up 1/256 and then 1/16 of a large table go first: what they
find is where thresholds end for the other blocks, so that tasks put out little more than the result.

Rows with a null label or vector, or a component that is null, not finite, or not finite once scaled,
take no part. Missing components of a shorter vector count as 0. Ties go to the smaller id, null ids
last. Rows with equal or null ids are told apart by a stored number; each is an anchor, a positive or a
negative by itself. Scores beyond a long end at its limits. Other columns are not looked at; an empty
table, or one without anchors, gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabscout.session import ship, written

BLOCK = 1 << 15  # rows, and anchors, of a task
SCALE = 256
GROUP = 8  # dimensions accumulated at once
AREA = 1 << 22  # partial scores held at once
SPARSE = 16  # pairs are completed one by one when fewer than one in so many is left
SHARES = (256, 16, 1)
REACH = (0.8, 0.55, 0.35, 0.2, 0.1, -1.0)  # thresholds for positives, as parts of the largest possible score
LOWEST = -(1 << 63)
EXACT = 1 << 53


# --- one block against one block --------------------------------------------------------------

def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix of whole numbers; shorter lists end in zeros."""
    whole = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(whole.offsets.to_numpy())
    flat = whole.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1], 1)
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def _remaining(x: np.ndarray, groups: int) -> np.ndarray:
    """Norm of what is left of each row from each group of dimensions on."""
    squares = np.add.reduceat(x * x, np.arange(0, x.shape[1], GROUP), axis=1)
    return np.sqrt(np.pad(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1], ((0, 0), (0, 1))))[:, :groups + 1]


class Index:
    """The rows of a block by groups of dimensions, those of most energy first."""

    def __init__(self, rows: np.ndarray):
        self.order = np.argsort(-(rows * rows).sum(axis=0), kind="stable")
        self.rows = rows[:, self.order]
        self.groups = -(-rows.shape[1] // GROUP)
        self.rest = _remaining(self.rows, self.groups)
        self.seen = 0  # partial products, for tests

    def at_least(self, queries: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of all pairs whose score reaches the query's threshold."""
        step = max(1, AREA // max(1, len(self.rows)))
        parts = [self._some(queries[at:at + step, self.order], t[at:at + step], at) for at in range(0, len(queries), step)]
        return tuple(np.concatenate([np.empty(0, kind), *(p[i] for p in parts)]) for i, kind in enumerate((np.int64, np.int64, np.float64)))

    def _some(self, q: np.ndarray, t: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left = _remaining(q, self.groups)
        covered = self.rest[:, :self.groups] * left[:, :self.groups].max(axis=0) * (1 + 1e-12) + 1 < t.min()
        rows, partial, found = np.arange(len(self.rows)), np.zeros((len(q), len(self.rows))), []

        def alive(group: int) -> np.ndarray:
            bound = left[:, group, None] * self.rest[None, rows, group]
            return partial + bound * (1 + 1e-12) + 1 >= t[:, None]

        def leave(pairs: np.ndarray, group: int) -> None:
            """Completes pairs with the dimensions that are not in their partial score."""
            i, j = np.nonzero(pairs)
            for part in range(0, len(i), AREA // 8):
                a, b = i[part:part + AREA // 8], j[part:part + AREA // 8]
                score = partial[a, b] + np.einsum("ij,ij->i", q[a, group * GROUP:], self.rows[rows[b], group * GROUP:])
                hit = score >= t[a]
                found.append((a[hit] + at, rows[b[hit]], score[hit]))

        for group in range(self.groups):
            omitted = covered[rows, group]
            if omitted.any():
                if group:
                    leave(alive(group) & omitted, group)
                rows, partial = rows[~omitted], partial[:, ~omitted]
            if not len(rows):
                break
            these = slice(group * GROUP, (group + 1) * GROUP)
            partial += q[:, these] @ self.rows[rows, these].T
            self.seen += partial.size
            pairs = alive(group + 1)
            n = np.count_nonzero(pairs)
            if n * SPARSE <= pairs.size:
                leave(pairs, group + 1)
                rows, partial = rows[:0], partial[:, :0]
                break
            some = pairs.any(axis=0)
            if not some.all():
                rows, partial = rows[some], partial[:, some]
        if len(rows):
            leave(alive(self.groups), self.groups)
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        return tuple(map(np.concatenate, zip(*found)))


class _Large:
    """As Index for numbers whose products a double does not hold exactly."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows

    def at_least(self, queries: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = lambda m: [[int(x) for x in row] for row in m]
        rows = whole(self.rows)
        pairs = [(i, j, s) for i, a in enumerate(whole(queries)) for j, b in enumerate(rows)
                 if (s := min(max(sum(x * y for x, y in zip(a, b)), LOWEST), -LOWEST - 1)) >= t[i]]
        return tuple(np.array([p[k] for p in pairs], np.int64) for k in range(3))


def index_of(queries: np.ndarray, rows: np.ndarray) -> Index | _Large:
    most = lambda m: float(np.abs(m).max(initial=0))
    return Index(rows) if most(queries) * most(rows) * max(1, rows.shape[1]) < EXACT else _Large(rows)


def _first(row: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of every row by (score descending, tie ascending)."""
    order = np.lexsort((tie, ~score, row))  # the complement falls as whole numbers rise
    return order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]


def nearest(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, rows: np.ndarray, uid: np.ndarray, tie: np.ndarray, k: int):
    """(query, row, score): the first k rows other than itself of every query, if they reach its floor."""
    queries, rows = _same_width(queries, rows)
    index = index_of(queries, rows)
    norm = lambda m: np.sqrt((m * m).sum(axis=1))
    most = norm(queries) * norm(rows).max(initial=0)
    going, done = np.arange(len(queries)), []
    for part in REACH:
        if not len(going):
            break
        t = np.nextafter(np.maximum(floor[going], np.floor(part * most[going]) if part > 0 else LOWEST).astype(np.float64), -np.inf)
        q, r, score = index.at_least(queries[going], t)
        other = uid[r] != own[going[q]]
        q, r, score = going[q[other]], r[other], score[other].astype(np.int64)
        full = (np.bincount(q, minlength=len(queries))[going] >= k) | (t <= floor[going])
        ended = np.zeros(len(queries), bool)
        ended[going[full]] = True
        at = np.flatnonzero(ended[q])
        at = at[_first(q[at], score[at], tie[r[at]], k)]
        done.append((q[at], r[at], score[at]))
        going = going[~full]
    return tuple(np.concatenate([np.empty(0, np.int64), *(d[i] for d in done)]).astype(np.int64) for i in range(3))


def in_windows(queries: np.ndarray, label: np.ndarray, top: np.ndarray, low: np.ndarray, floor: np.ndarray,
               rows: np.ndarray, row_label: np.ndarray, tie: np.ndarray, k: int):
    """(query, window, row, score): the first k rows of another label in every window.

    ``top``, ``low`` and ``floor`` have a column per window; one with ``low`` above ``top`` is empty.
    """
    queries, rows = _same_width(queries, rows)
    index = index_of(queries, rows)
    end = np.maximum(low, floor)
    open_ = (low <= top) & (end <= top)
    done = []
    for share in (0.15, 0.3, 0.5, 0.75, 1.0):  # how far down a window the threshold goes
        going = np.flatnonzero(open_.any(axis=1))
        if not len(going):
            break
        down = np.maximum(end, top - np.ceil((top - low) * share).astype(np.int64)) if share < 1 else end
        t = np.where(open_, down, np.iinfo(np.int64).max).min(axis=1)
        q, r, score = index.at_least(queries[going], t[going])
        score = score.astype(np.int64)
        q = going[q]
        other = label[q] != row_label[r]
        q, r, score = q[other], r[other], score[other]
        for w in range(top.shape[1]):
            inside = np.flatnonzero(open_[q, w] & (score <= top[q, w]) & (score >= down[q, w]))
            full = open_[:, w] & ((np.bincount(q[inside], minlength=len(queries)) >= k) | (down[:, w] <= end[:, w]))
            at = inside[full[q[inside]]]
            at = at[_first(q[at], score[at], tie[r[at]], k)]
            done.append((q[at], np.full(len(at), w), r[at], score[at]))
            open_[:, w] &= ~full
    return tuple(np.concatenate([np.empty(0, np.int64), *(d[i] for d in done)]).astype(np.int64) for i in range(4))


# --- blocks over the cluster ------------------------------------------------------------------

def prepared(table: DataFrame, is_anchor: Column, relabel: Column | None = None) -> DataFrame:
    """Stored rows (uid, id, label, v, anchor); ``relabel`` is the label a row is taken to have."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    # a double beyond 2^52 is whole
    scaled = lambda x: x.cast("double") * SCALE
    whole = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < 2.0 ** 52, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    return written(
        table.where("label is not null and embedding is not null").where(finite)
        .select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("bigint").alias("id"),
                (F.col("label") if relabel is None else relabel).cast("bigint").alias("label"), whole.alias("v"),
                F.coalesce(is_anchor, F.lit(False)).alias("anchor")), "vectors")


def _order(score: str = "score", prefix: str = "") -> list[Column]:
    return [F.desc(score), F.col(f"{prefix}id").asc_nulls_last(), F.col(f"{prefix}uid")]


def _best(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first k of every key; the limit runs before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*_order())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _tie(ids: pa.ChunkedArray, uid: np.ndarray) -> np.ndarray:
    """Places of rows by (id, null last, uid)."""
    null = ids.is_null().to_numpy().astype(bool)
    values = ids.fill_null(0).to_numpy()
    out = np.empty(len(uid), np.int64)
    out[np.lexsort((uid, values, null))] = np.arange(len(uid))
    return out


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


_FOUND = pa.schema([("anchor", pa.int64()), ("uid", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
_HIT = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("uid", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _numbers(n: Column, step: int = 1) -> Column:
    """0, ``step``, 2 ``step`` and so on below n."""
    return F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1, F.lit(step).cast("bigint"))


def _shares(blocks: int) -> Iterator[int]:
    return (s for s in SHARES if s == 1 or blocks >= 2 * s)


def positives(rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(anchor, place, uid, id, score), stored: the first k rows of the same label of every anchor.

    A label's rows are dealt over its own blocks, its anchors likewise, so that a label with a third of
    all rows is many tasks and a rare one is a single small task.
    """
    sizes = written(rows.groupBy("label").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.ceil(F.count_if("anchor") / block).cast("int").alias("parts"))
        .where("parts > 0"), "labels")
    dealt = rows.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("uid"), "blocks"))
    anchors = written(dealt.where("anchor").select("label", "blocks", "parts", "uid", "v"), "anchors")
    most = sizes.agg(F.max("blocks")).first()[0] or 0
    floors = None
    for share in _shares(most):
        asked = anchors.withColumn("floor", F.lit(LOWEST)) if floors is None else anchors.join(
            floors, F.col("uid") == F.col("of"), "left").withColumn("floor", F.coalesce("floor", F.lit(LOWEST)))
        asked = asked.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(1)), "parts")).select(
            "label", "part", F.explode(_numbers(F.col("blocks"), share)).alias("block"),
            "uid", "v", "floor")
        searched = dealt.where(F.col("block") % share == 0).select(
            "label", F.explode(_numbers(F.col("parts"))).alias("part"), "block", "uid", "id", "v")

        def search(queries: pa.Table, data: pa.Table) -> pa.Table:
            if not len(queries) or not len(data):
                return _FOUND.empty_table()
            own, uid = _column(queries, "uid"), _column(data, "uid")
            q, r, score = nearest(matrix(queries["v"]), own, _column(queries, "floor"), matrix(data["v"]), uid, _tie(data["id"], uid), k)
            return pa.Table.from_arrays([pa.array(own[q]), pa.array(uid[r]), data["id"].take(pa.array(r)), pa.array(score)], schema=_FOUND)

        keys = ["label", "part", "block"]
        found = asked.groupBy(*keys).cogroup(searched.groupBy(*keys)).applyInArrow(search, "anchor bigint, uid bigint, id bigint, score bigint")
        best = written(_best(found, k, "anchor").withColumnRenamed("rank", "place"), "positives")
        floors = best.where(F.col("place") == k).select(F.col("anchor").alias("of"), F.col("score").alias("floor"))
    return best


def mine(rows: DataFrame, k_positive: int = 5, k_negative: int = 5, low: int = 80, high: int = 100, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``prepared`` rows.

    A negative's score s satisfies ``low`` x positive <= 100 x s <= ``high`` x positive.
    """
    spark = ship(rows.sparkSession)
    best = positives(rows, k_positive, block)
    # windows in whole numbers; one whose lower end is above its upper end holds nothing
    score = F.col("score").cast("decimal(20,0)")
    percent = lambda c, p, up: F.call_function("div", c * p + F.when(c * p > 0, 99 if up else 0).otherwise(0 if up else -99), F.lit(100))
    spans = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct(
        "place", percent(score, high, False).alias("top"), percent(score, low, True).alias("low")))).alias("spans"))
    anchors = written(
        rows.where("anchor").drop("anchor").join(spans, F.col("uid") == F.col("anchor")).select("uid", "label", "v", "spans"), "anchors")
    cores = spark.sparkContext.defaultParallelism
    n = rows.count()
    blocks, parts = max(-(-n // block), min(cores, n // 1024), 1), max(1, -(-anchors.count() // block))
    floors = None
    for share in _shares(blocks):
        asked = anchors.withColumn("floors", F.lit(None).cast("map<int,bigint>")) if floors is None else anchors.join(
            floors, F.col("uid") == F.col("of"), "left")
        asked = asked.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(parts))).select(
            "part", F.explode(_numbers(F.lit(blocks), share)).alias("block"), "uid", "label", "v",
            *[F.transform("spans", lambda s: s[c]).alias(c) for c in ("top", "low")],
            F.transform("spans", lambda s: F.coalesce(F.try_element_at("floors", s["place"]), F.lit(LOWEST))).alias("floor"))
        searched = rows.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks))).where(F.col("block") % share == 0).select(
            F.explode(_numbers(F.lit(parts))).alias("part"), "block", "uid", "id", "label", "v")

        def search(queries: pa.Table, data: pa.Table) -> pa.Table:
            if not len(queries) or not len(data):
                return _HIT.empty_table()
            own, uid = _column(queries, "uid"), _column(data, "uid")
            sizes = np.diff(queries["top"].combine_chunks().offsets.to_numpy())
            wide = {}
            for name, filler in (("top", LOWEST), ("low", -LOWEST - 1), ("floor", LOWEST)):
                wide[name] = np.full((len(queries), int(sizes.max())), filler, np.int64)
                wide[name][np.arange(wide[name].shape[1]) < sizes[:, None]] = queries[name].combine_chunks().flatten().to_numpy()
            q, w, r, score = in_windows(
                matrix(queries["v"]), _column(queries, "label"), wide["top"], wide["low"], wide["floor"],
                matrix(data["v"]), _column(data, "label"), _tie(data["id"], uid), k_negative)
            return pa.Table.from_arrays([pa.array(own[q]), pa.array((w + 1).astype(np.int32)), pa.array(uid[r]), data["id"].take(pa.array(r)),
                                         pa.array(score)], schema=_HIT)

        keys = ["part", "block"]
        found = asked.groupBy(*keys).cogroup(searched.groupBy(*keys)).applyInArrow(
            search, "anchor bigint, place int, uid bigint, id bigint, score bigint")
        hits = written(_best(found, k_negative, "anchor", "place"), "negatives")
        floors = hits.where(F.col("rank") == k_negative).groupBy(F.col("anchor").alias("of")).agg(
            F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("floors"))
    named = rows.where("anchor").select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = best.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(named, "anchor")
    return hits.join(pairs, ["anchor", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
