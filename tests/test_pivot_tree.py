"""Two levels of pivots give the scan's result and prune branches."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscout.operators import pivot_tree, search


def clustered(n, dim=8, clusters=40, seed=4, hot=0):
    deal = np.random.default_rng(seed)
    v = deal.normal(size=(clusters, dim))[deal.integers(0, clusters, n)] + 0.15 * deal.normal(size=(n, dim))
    v[:hot] = v[0]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "table_id bigint, embedding array<double>").repartition(4)


def as_queries(v):
    return v.select(F.col("table_id").alias("query_id"), "embedding")


def rows(df):
    return sorted((r.query_id, r["rank"], r.table_id, round(r.score, 6) + 0.0) for r in df.collect())


@pytest.mark.parametrize("exclude_self", [True, False])
def test_tree_equals_the_scan(spark, exclude_self):
    df = frame(spark, clustered(450, hot=150))
    want = rows(search.scan_topk(as_queries(df), df, 6, exclude_self))
    got = pivot_tree.tree_topk(as_queries(df), df, 6, exclude_self, n_cells=30, n_tops=5, block_rows=40, query_block_rows=60, seed_rows=20)
    assert rows(got) == want
    assert rows(pivot_tree.tree_topk(as_queries(df), df, 500, exclude_self, n_cells=9)) == rows(search.scan_topk(as_queries(df), df, 500, exclude_self))


def test_exact_search_takes_the_tree_beyond_a_flat_set(spark, monkeypatch):
    df = frame(spark, clustered(400))
    monkeypatch.setattr(search, "MOST_PIVOTS", 16)
    taken = []
    real = pivot_tree.tree_topk
    monkeypatch.setattr(pivot_tree, "tree_topk", lambda *a, **o: taken.append(1) or real(*a, **o))
    got = search.exact_topk(as_queries(df), df, 4, broadcast_values=10)
    assert taken and rows(got) == rows(search.scan_topk(as_queries(df), df, 4))


def test_visits_grow_slower_than_cells():
    looked, visited = [], []
    for n in (2000, 8000, 32000):
        v = clustered(n, clusters=n // 50)
        cells = n // 50
        tree = pivot_tree.plant(v[np.random.default_rng(0).permutation(n)[:cells]], int(cells ** 0.5))
        branch, top_angle, cell, angle = pivot_tree.place(v, tree)
        radius, reach = np.zeros(cells), np.zeros(len(tree.tops))
        np.maximum.at(radius, cell, angle)
        np.maximum.at(reach, branch, top_angle)
        tree = tree._replace(rows=np.bincount(cell, minlength=cells), radius=radius, reach=reach)
        asked = v[:200]
        floor = np.sort(asked @ v.T, axis=1)[:, -10]
        row, col, angles = pivot_tree.visits(asked, floor, tree)
        met = set(zip(row.tolist(), col.tolist()))
        for q in range(200):  # no cell of a true neighbour is missed
            assert all((q, cell[x]) in met for x in np.argsort(-(asked[q] @ v.T))[:10])
        looked.append(angles / 200)
        visited.append(len(row) / 200)
    # 16 times the rows and cells
    assert looked[2] < 10 * looked[0] and visited[2] < 10 * visited[0]


def test_nothing(spark):
    df = frame(spark, clustered(20))
    assert pivot_tree.tree_topk(as_queries(df.limit(0)), df, 3).count() == 0
    assert pivot_tree.tree_topk(as_queries(df), df.limit(0), 3).count() == 0
    assert pivot_tree.tree_topk(as_queries(df), df.limit(1), 3).count() == 20
