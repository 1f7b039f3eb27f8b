import math

import pytest

from tabscout.operators import ranking

# query -> (ranking, relevant)
CASES = {
    "two": (["a", "x", "b"], {"a", "b"}), "late": (["x", "a"], {"a"}), "ndcg": (["x", "a", "b"], {"a", "b"}),
    "half": (["a", "x"], {"a", "b"}), "none": (["a"], set()), "miss": (["x", "y"], {"a"}),
    "twice": (["a", "a", "b"], {"a", "b"}), "unranked": ([], {"a"}),
}


@pytest.fixture(scope="module")
def scored(spark):
    ranks = [(q, i + 1, t) for q, (r, _) in CASES.items() for i, t in enumerate(r)]
    gold = [(q, t) for q, (_, g) in CASES.items() for t in g]
    rankings = spark.createDataFrame(ranks, "query_id string, rank int, table_id string")
    qrels = spark.createDataFrame(gold, "query_id string, table_id string")
    queries = spark.createDataFrame([(q,) for q in CASES], "query_id string")
    judged = ranking.judge(rankings, qrels)
    counted = ranking.relevant_counts(queries, qrels)
    out = ranking.per_query(judged, counted, ks=(1, 3, 5), ndcg_ks=(3,), mrr_k=1)
    return {r.query_id: r for r in out.collect()}, judged, counted


def test_average_precision(scored):
    ap = {q: r.ap for q, r in scored[0].items()}
    assert ap["two"] == pytest.approx((1 + 2 / 3) / 2)
    assert ap["none"] is None and ap["miss"] == 0 and ap["unranked"] == 0
    assert ap["twice"] == pytest.approx((1 + 1 + 1) / 2)  # a repeated hit counts again


def test_reciprocal_rank(scored):
    rr = {q: r.rr for q, r in scored[0].items()}
    assert rr["late"] == 0.5 and rr["none"] == 0 and rr["miss"] == 0 and rr["two"] == 1
    assert scored[0]["late"].rr_1 == 0 and scored[0]["two"].rr_1 == 1


def test_ndcg(scored):
    got = scored[0]["ndcg"].ndcg_3
    assert got == pytest.approx((1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3)))
    assert scored[0]["none"].ndcg_3 == 0


def test_precision_recall_f1(scored):
    r = scored[0]["half"]
    assert (r.precision_5, r.recall_5) == (0.2, 0.5) and r.f1_5 == pytest.approx(0.285714, abs=1e-6)
    assert scored[0]["twice"].precision_3 == pytest.approx(2 / 3)  # a set, so repeats count once
    assert scored[0]["none"].recall_5 == 0 and scored[0]["none"].f1_5 == 0


def test_containment(scored):
    assert scored[0]["half"].containment_5 == 0 and scored[0]["none"].containment_5 == 1
    assert scored[0]["two"].containment_3 == 1 and scored[0]["two"].containment_1 == 0


def test_averages(scored):
    row = ranking.evaluate(scored[1], scored[2], ["ap", "rr", "recall_1"]).first()
    aps = [r.ap for r in scored[0].values() if r.ap is not None]
    assert row.map == pytest.approx(sum(aps) / len(aps), abs=1e-6)
    assert row.mrr == pytest.approx(sum(r.rr for r in scored[0].values()) / len(CASES), abs=1e-6)
    empty = ranking.evaluate(scored[1].limit(0), scored[2].limit(0), ["ap", "rr"]).first()
    assert empty.map == 0 and empty.mrr == 0


def test_metrics_stay_in_range(scored):
    for r in scored[0].values():
        for m in ("rr", "ndcg_3", "precision_5", "recall_5", "f1_5"):
            assert 0 <= r[m] <= 1 or (m == "ndcg_3" and r.query_id == "twice")


def test_class_relevance(spark):
    classes = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, class string")
    ranks = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (3, 1, 1)], "query_id long, rank int, table_id long")
    hits = sorted((r.query_id, r.table_id, r.hit) for r in ranking.judge_by_class(ranks, classes).collect())
    assert hits == [(1, 2, True), (1, 3, False), (3, 1, False)]
    assert {r.query_id: r.n_relevant for r in ranking.class_counts(classes).collect()} == {1: 1, 2: 1, 3: 0}


def test_architecture(spark):
    df = spark.createDataFrame([("Qwen3",), ("BGE-large",), ("e5-base",), ("mpnet",)], "model string")
    got = {r.model: (r.architecture, r.parameters) for r in ranking.with_architecture(df).collect()}
    assert got == {"Qwen3": ("Decoder-Only", "7B"), "BGE-large": ("Hybrid", "335M"),
                   "e5-base": ("Decoder-Only", "7B"), "mpnet": ("Bidirectional", "110M")}


def test_reports(spark):
    ranks = spark.createDataFrame([("q", 1, "t1")], "query_id string, rank int, table_id string")
    queries = spark.createDataFrame([("q", "text")], "query_id string, query string")
    qrels = spark.createDataFrame([("q", f"t{i:04d}") for i in range(2500)], "query_id string, table_id string")
    rows = ranking.rankings_report(ranks, queries, "d").collect()
    assert [tuple(r) for r in rows] == [("d", "q", "text", 1, "t1")]
    relevant = ranking.relevance_report(queries, qrels.union(qrels), "d").collect()
    assert sorted(r.relevant for r in relevant) == [f"t{i:04d}" for i in range(2500)]
    assert [r.relevant for r in ranking.relevance_report(queries, qrels.limit(0), "d").collect()] == [None]
