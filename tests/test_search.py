import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscout.operators import encode, prefixes, search
from tabscout.functions.vectors import hash_encode


def vectors(spark, m, ids=None):
    ids = ids or list(range(len(m)))
    kind = "string" if isinstance(ids[0], str) else "long"
    return spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in zip(ids, m)], f"table_id {kind}, embedding array<double>"
    )


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def brute(m, ids, k, exclude_self):
    s = np.round(m @ m.T, 6) + 0.0
    out = []
    for i, q in enumerate(ids):
        order = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if not (exclude_self and i == j))[:k]
        out += [(q, r + 1, t, -v) for r, (v, t) in enumerate(order)]
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r["rank"], r.table_id, round(r.score, 6) + 0.0) for r in df.collect())


def as_queries(df):
    return df.select(F.col("table_id").alias("query_id"), "embedding")


@pytest.fixture(scope="module")
def skewed():
    """A third of the vectors are the same one, the rest lies in a few clusters."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8))
    near = centres[rng.integers(0, 5, 200)] + 0.1 * rng.normal(size=(200, 8))
    same = np.repeat(centres[:1], 100, axis=0)
    return unit(np.vstack([near, same]))


@pytest.mark.parametrize("exclude_self", [True, False])
def test_scan_equals_brute_force(spark, skewed, exclude_self):
    df = vectors(spark, skewed).repartition(5)
    got = rows(search.scan_topk(as_queries(df), df, 7, exclude_self))
    assert got == brute(skewed, list(range(300)), 7, exclude_self)


@pytest.mark.parametrize("ids", [None, [f"t{i:03d}" for i in range(300)]])
def test_cells_equal_brute_force_with_a_hot_cell(spark, skewed, ids):
    df = vectors(spark, skewed, ids)
    got = search.cell_topk(
        as_queries(df), df, 7, exclude_self=True, n_pivots=6, block_rows=40, query_block_rows=50, seed_rows=20
    )
    assert rows(got) == brute(skewed, ids or list(range(300)), 7, True)


def test_k_larger_than_the_corpus(spark, skewed):
    df = vectors(spark, skewed[:5])
    assert rows(search.cell_topk(as_queries(df), df, 10, n_pivots=2)) == brute(skewed[:5], list(range(5)), 10, False)


def test_empty_sides(spark, skewed):
    df = vectors(spark, skewed[:5])
    for make in (search.scan_topk, search.cell_topk, search.exact_topk):
        assert make(as_queries(df).limit(0), df, 3).count() == 0
        assert make(as_queries(df), df.limit(0), 3).count() == 0


def test_zero_vectors(spark, skewed):
    m = skewed.copy()
    m[::7] = 0.0
    df = vectors(spark, m)
    assert rows(search.cell_topk(as_queries(df), df, 5, n_pivots=4)) == brute(m, list(range(300)), 5, False)


def test_large_query_sets_are_not_broadcast(spark, skewed, monkeypatch):
    df = vectors(spark, skewed)
    monkeypatch.setattr(search, "scan_topk", lambda *a, **k: pytest.fail("broadcast"))
    assert search.exact_topk(as_queries(df), df, 3, broadcast_values=8 * 299, n_pivots=4).count() == 900


@pytest.mark.parametrize("centres", ["sample", "kmeans"])
def test_approximate_hits_are_true_scores(spark, skewed, centres):
    df = vectors(spark, skewed)
    found = search.approx_topk(as_queries(df), df, 5, n_probe=2, n_pivots=6, centres=centres)
    exact = {(q, t): s for q, _, t, s in brute(skewed, list(range(300)), 300, False)}
    for q, _, t, s in rows(found):
        assert exact[(q, t)] == s
    recall = search.recall_against(found, search.scan_topk(as_queries(df), df, 5), 5)
    assert 0.2 < recall.agg(F.avg("recall")).first()[0] <= 1


def test_similar_tables_do_not_replace_invalid_hits(spark):
    m = unit(np.array([[1, 0], [1, 0.1], [1, 0.2], [1, 0.3], [0, 1]], dtype=float))
    df = vectors(spark, m)
    valid = spark.createDataFrame([(0,), (2,), (3,), (4,)], "table_id long")
    got = [(r.table_id, r["rank"]) for r in search.similar_tables(df, valid, 2).filter("query_id = 0").collect()]
    assert got == [(2, 1)]  # 1 is invalid, 3 was not among the k + 1 hits


def test_pair_evidence(spark):
    tables = spark.createDataFrame([
        ("a", ["user_id", "name"], ["7", "x"]), ("b", ["name", "user_id"], ["y", "7"]), ("c", ["name"], ["x"]),
        ("d", ["other"], ["1"]), ("e", ["name"], None), ("f", ["name"], [""]),
    ], "table_id string, columns array<string>, first_row array<string>")
    pairs = spark.createDataFrame([("a", x) for x in "bcdef"], "query_id string, table_id string")
    got = {r.table_id: r.evidence for r in search.pair_evidence(pairs, tables).collect()}
    assert got == {
        "b": "shared_columns:name,user_id | potential_fk:user_id | value_match:user_id=7",
        "c": "shared_columns:name | value_match:name=x", "d": "embedding_similarity_only",
        "e": "embedding_similarity_only", "f": "shared_columns:name",
    }


def test_prefixes(spark):
    dbs = spark.createDataFrame([("a",), ("ab",), ("x-y",)], "db string")
    names = spark.createDataFrame([("ab_t",), ("x_y_m_v1",), ("zzz",), ("ab",)], "name string")
    got = sorted((r.db, r.name) for r in prefixes.prefix_join(names, dbs).collect())
    assert got == [("a", "ab"), ("a", "ab_t"), ("ab", "ab"), ("ab", "ab_t")]
    longest = {r.name: r.db for r in prefixes.longest_prefix(names, dbs).collect()}
    assert longest == {"ab_t": "ab", "x_y_m_v1": "x-y", "zzz": None, "ab": None}


def test_encoder_hook_equals_default(spark):
    df = spark.createDataFrame([(1, "Foo bar, foo"), (2, ""), (3, None)], "id int, text string")

    def factory():
        from tabscout.functions.vectors import hash_texts
        return lambda texts: hash_texts(texts, 16)

    hooked = {r.id: r.embedding for r in encode.encode_with(df, factory).collect()}
    plain = {r.id: r.v for r in df.select("id", hash_encode("text", 16).alias("v")).collect()}
    for i in plain:
        assert np.allclose(hooked[i], plain[i], atol=1e-6)
    assert abs(np.linalg.norm(plain[1]) - 1) < 1e-9 and not any(plain[2])


def test_mean_pool(spark):
    df = spark.createDataFrame([("t", ["foo", "bar"]), ("t", ["foo"]), ("u", [])], "t string, cells array<string>")
    got = {r.t: r.embedding for r in encode.mean_pool(df, ["t"], dim=8).collect()}
    one = {r.text: np.array(r.v) for r in spark.createDataFrame([("foo",), ("bar",)], "text string").select("text", hash_encode("text", 8).alias("v")).collect()}
    assert np.allclose(got["t"], (2 * one["foo"] + one["bar"]) / 3)


def test_rows_without_a_whole_vector_take_no_part(spark):
    bad = [(100, None), (101, [1.0]), (102, [None, 1.0])]
    good = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.6, 0.8])]
    df = spark.createDataFrame(good + bad, "table_id long, embedding array<double>")
    for options in ({}, {"broadcast_values": 0}):
        got = search.exact_topk(as_queries(df), df, 2, exclude_self=True, **options).collect()
        assert sorted((r.query_id, r["rank"], r.table_id) for r in got) == [(0, 1, 2), (0, 2, 1), (1, 1, 2), (1, 2, 0), (2, 1, 1), (2, 2, 0)]


def test_blocks_are_copied_by_a_join(spark):
    """No corpus row is exploded to query blocks that do not visit its cell."""
    rng = np.random.default_rng(5)
    df = vectors(spark, unit(rng.normal(size=(200, 4))))
    found = search.cell_topk(as_queries(df), df, 3, n_pivots=4, query_block_rows=16)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    right = plan[plan.index("FlatMapCoGroupsInArrow"):].split("RepartitionByExpression")[2]
    assert "Generate" not in right and "Join" in right


def test_texts_in_any_script(spark):
    texts = ["größe und weite", "Поиск таблиц", "表 検索 二", "جدول بحث", "under_score 12"]
    df = spark.createDataFrame(enumerate(texts), "table_id long, text string")
    got = {r.table_id: np.array(r.embedding) for r in df.select("table_id", hash_encode("text").alias("embedding")).collect()}
    assert all(np.linalg.norm(v) == pytest.approx(1) for v in got.values())
    same = spark.createDataFrame([(0, "GRÖSSE, GRÖẞE größe"), (1, "größe")], "table_id long, text string")
    a, b = [np.array(r.e) for r in same.select(hash_encode("text").alias("e")).collect()]
    assert a @ b > 0.3


def test_queries_read_stored_cells(spark):
    """Neither queries nor tables are copied per pair of blocks; several cells, blocks and pieces, ties and equal rows."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 8))
    x[300:500] = x[0]  # a cell of equal rows
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [f"t{i:04d}" for i in range(len(x))]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "table_id string, embedding array<double>").repartition(3)
    queries = vectors.selectExpr("table_id as query_id", "embedding").unionByName(
        spark.createDataFrame([(None, x[1].tolist())], "query_id string, embedding array<double>"))
    found = search.exact_topk(queries, vectors, 7, exclude_self=True, broadcast_values=0, n_pivots=9, block_rows=64, query_block_rows=50)
    plan = found._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "Join" not in plan
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.table_id, r.score))
    score = np.round(x @ x.T, 6) + 0.0
    assert set(got) == set(ids)
    for i, name in enumerate(ids):
        best = sorted((-score[i, j], ids[j]) for j in range(len(x)) if j != i)[:7]
        assert sorted(got[name]) == [(n + 1, t, pytest.approx(-s)) for n, (s, t) in enumerate(best)]
    twice = search.exact_topk(queries.unionByName(queries), vectors, 7, exclude_self=True, broadcast_values=0, n_pivots=9)
    one = [r for r in twice.where("query_id = 't0001'").orderBy("rank").collect()]
    assert [r["rank"] for r in one] == list(range(1, 8)) and [r.table_id for r in one[:4]] == [sorted(got["t0001"])[0][1]] * 4


def test_tiles_give_the_best_of_a_block_and_bound_what_is_held(monkeypatch):
    """Ties, own ids and limits across tiles; no product is larger than a tile."""
    rng = np.random.default_rng(5)
    c = np.round(rng.standard_normal((3000, 8)), 1)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    c[1000:2000] = c[:1000]  # every score twice
    ids = np.array([f"t{i}" for i in rng.permutation(3000)])
    q, q_ids = c[::7], ids[::7]
    scores = np.round(q @ c.T, search.DIGITS) + 0.0
    want = []
    for i, own in enumerate(q_ids):
        order = [j for j in np.lexsort((ids, -scores[i])) if ids[j] != own][:10]
        want += [(i, ids[j], scores[i, j]) for j in order]
    sizes, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda s, *a, **b: sizes.append(s.shape) or partition(s, *a, **b))
    for chunk, tile in ((1 << 21, 8192), (6400, 64), (1000, 100)):
        monkeypatch.setattr(search, "_CHUNK", chunk)
        monkeypatch.setattr(search, "_TILE", tile, raising=False)
        for floor in (None, np.array([w[2] for w in want[9::10]])):
            row, table, score = search._join(search._select(q_ids, q, ids, c, 10, True, floor))
            order = np.lexsort((table, -score, row))
            assert [(r, t) for r, t, _ in want] == list(zip(row[order].tolist(), table[order].tolist()))
            assert np.allclose([w[2] for w in want], score[order], atol=1e-9)
        assert all(n * width <= chunk and width <= tile for n, width in sizes)
        sizes.clear()
