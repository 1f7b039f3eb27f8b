from itertools import combinations

import pytest
from conftest import SF, make_corpus
from pyspark.sql import functions as F

from tabscout.operators import samples
from tabscout.plans.corpora import order_corpus
from tabscout.plans.strategies import STRATEGIES, build_samples
from tabscout.session import written

A = ["a"]
ROW = [["1"]]


@pytest.fixture(scope="module")
def corpus(spark):
    """Database 'hot' holds a third of the tables; one database has a single table."""
    tables = [("hot", f"h{i}", A, ROW, []) for i in range(21)]
    tables += [(f"d{i % 9}", f"t{i}", A, ROW, []) for i in range(40)]
    tables += [("single", "s", A, ROW, []), ("hot", "empty", A, [], [])]
    return written(make_corpus(spark, tables), "corpus")


def names_of(corpus):
    out = {}
    for r in corpus.filter(F.size("rows") > 0).collect():
        out.setdefault(r.database_name, []).append(r.table_name)
    return out


def test_all_pairs_once(corpus):
    got = samples.positive_pairs(samples.index(corpus)).collect()
    want = {(d, frozenset(p)) for d, ts in names_of(corpus).items() for p in combinations(ts, 2)}
    assert {(r.database_name, frozenset((r.table_a, r.table_b))) for r in got} == want
    assert len(got) == len(want) and {r.label for r in got} == {0.5}


def test_pair_space_states_all_pairs(corpus):
    got = samples.pair_space(corpus).collect()
    assert sum(r.n_pairs for r in got) == sum(len(t) * (len(t) - 1) // 2 for t in names_of(corpus).values())


def test_drawn_pairs_are_distinct_and_even(corpus):
    got = samples.positive_pairs(samples.index(corpus), partners_per_table=3).collect()
    keys = [(r.database_name, frozenset((r.table_a, r.table_b))) for r in got]
    assert len(set(keys)) == len(keys)
    hot = [r for r in got if r.database_name == "hot"]
    uses = {}
    for r in hot:
        uses[r.table_b] = uses.get(r.table_b, 0) + 1
    assert max(uses.values()) <= 3


def test_one_negative_per_database(corpus):
    got = samples.negative_pairs(samples.index(corpus)).collect()
    assert sorted(r.database_name for r in got) == sorted(names_of(corpus))
    names = names_of(corpus)
    for r in got:
        assert r.other_db != r.database_name
        assert r.table_a in names[r.database_name] and r.table_b in names[r.other_db]


def test_pairs_state_all(corpus):
    got = samples.pairs(corpus).collect()
    names = names_of(corpus)
    ranges = [r for r in got if r.table_b is None]
    assert sum(r.n_pairs for r in ranges) == sum(len(t) * (len(t) - 1) // 2 for t in names.values())
    assert all(r.last_partner - r.first_partner + 1 == r.n_pairs for r in ranges)
    assert len(got) - len(ranges) == len(names)


def test_pairs_of_anchors(corpus):
    ix = samples.index(corpus)
    got = samples.pairs_of(ix, ix.tables.where("tab_ord = 0")).collect()
    assert len(got) == sum(len(t) - 1 for t in names_of(corpus).values())
    texts = samples.pair_texts(corpus, samples.negative_pairs(ix).withColumnsRenamed({"database_name": "db_a", "other_db": "db_b"}))
    assert all(r.text_a == f"[TABLE]{r.table_a} [ROWS][ROW] a:1" for r in texts.collect())


def test_counted_cosines(spark, monkeypatch):
    import numpy as np

    from tabscout.operators import losses

    rng = np.random.default_rng(1)
    rows = [("hot", f"t{i}", rng.normal(size=4).tolist()) for i in range(50)] + [("hot", "zero", [0.0] * 4), ("one", "x", [1.0] * 4)]
    rows += [(f"d{i % 5}", f"u{i}", rng.normal(size=4).tolist()) for i in range(17)]
    want = {}
    for i, (d, _, v) in enumerate(rows):
        for e, _, w in rows[:i]:
            if d == e:
                n = np.linalg.norm(v) * np.linalg.norm(w)
                c = round(float(np.dot(v, w) / n if n else 0.0), 6) + 0.0
                want[c] = want.get(c, 0) + 1
    vectors = spark.createDataFrame(rows, "database_name string, table_name string, embedding array<double>")
    for size in (2048, 7):
        monkeypatch.setattr(losses, "BLOCK_TABLES", size)
        got = {r.cosine: r.w for r in losses.same_database_cosines(vectors).collect()}
        assert sum(got.values()) == sum(want.values())
        assert sorted(got) == pytest.approx(sorted(want), abs=2e-6)


def test_split_sizes(corpus):
    ids = written(samples.self_pairs(corpus).select("database_name", "table_name"), "ids")
    placed = written(samples.shuffled(ids, ids.columns), "placed")
    n = placed.count()
    got = {r.split: r["count"] for r in samples.split(placed).groupBy("split").count().collect()}
    assert got == {"train": int(0.9 * n), "val": n - int(0.9 * n)}
    few = samples.shuffled(written(ids.limit(5), "few"), ids.columns)
    got = samples.split(few, at_least_one=True).filter("split = 'val'").count()
    assert got == 1


def test_triplets(corpus):
    names = names_of(corpus)
    for fk in (True, False):
        got = samples.triplets(corpus, 50, fk_positives=fk).collect()
        assert len(got) == 50 and len({r.attempt for r in got}) == 50
        for r in got:
            assert r.positive in names[r.db] and r.positive != r.anchor
            assert r.negative_db != r.db and r.negative in names[r.negative_db]
            assert r.db != "single"


def test_fk_rules(spark):
    tables = [
        ("d", "a", A, ROW, ["b", "b", "missing", "hollow"]), ("d", "b", A, ROW, []), ("d", "self", A, ROW, ["self"]),
        ("d", "hollow", A, [], []), ("e", "x", A, ROW, []),
    ]
    corpus = written(make_corpus(spark, tables), "corpus")
    targets = sorted((r.table_name, r.reference_table) for r in samples.fk_targets(corpus).collect())
    assert targets == [("a", "b"), ("a", "b"), ("a", "hollow"), ("self", "self")]
    lists = {r.table_name: r.targets for r in samples.fk_lists(corpus).collect()}
    assert lists == {"a": ["b", "b"], "self": ["self"]}
    for r in samples.triplets(corpus, 40).collect():
        if r.anchor == "a":
            assert r.positive == "b"
        if r.anchor == "self":
            assert r.positive == "self"


def test_one_database_gives_nothing(spark):
    corpus = written(make_corpus(spark, [("d", f"t{i}", A, ROW, []) for i in range(4)]), "corpus")
    assert samples.triplets(corpus, 10).count() == 0
    assert samples.negative_pairs(samples.index(corpus)).count() == 0


def test_views_drawn_per_attempt(corpus):
    ids = samples.triplets(corpus, 60, fk_positives=False, views=["full", "schema"])
    rows = samples.triplet_texts(corpus, ids).collect()
    assert len(rows) == 60 and {r.view for r in rows} == {"full", "schema"}
    for r in rows:
        assert r.anchor_text.startswith("[DB]" if r.view == "full" else "[TABLE]")
        assert r.positive_text.startswith("[DB]") and r.negative_text.startswith("[DB]")


def test_smart_batches_are_sorted(corpus):
    rows = samples.smart_batches(samples.triplet_texts(corpus, samples.triplets(corpus, 50, fk_positives=False))).collect()
    rows.sort(key=lambda r: r.position)
    keys = [(r.anchor_text[:60], r.attempt) for r in rows]
    assert keys == sorted(keys) and [r.position for r in rows] == list(range(50))
    assert [r.batch for r in rows] == [i // 16 for i in range(50)]


def test_masking_keeps_the_whole_text(spark):
    words = [f"w{i}" for i in range(1300)]
    df = spark.createDataFrame([("d", "t", " ".join(words)), ("d", "blank", "  ")], "database_name string, table_name string, text string")
    got = sorted(samples.mask_tokens(df).collect(), key=lambda r: r.window)
    assert [len(r.tokens) for r in got] == [512, 512, 276]
    tokens = [t for r in got for t in r.tokens]
    labels = [t for r in got for t in r.labels]
    chosen = [i for i, x in enumerate(labels) if x is not None]
    assert 0.1 < len(chosen) / 1300 < 0.2
    assert all(labels[i] == words[i] for i in chosen)
    assert all(tokens[i] == words[i] for i in range(1300) if labels[i] is None)
    assert 0.6 < sum(tokens[i] == "[MASK]" for i in chosen) / len(chosen) < 0.95


def test_sample_per_group(spark):
    df = spark.createDataFrame([(i % 4, i) for i in range(100)], "g int, i int")
    got = samples.sample_per_group(df, ["g"], ["i"], 3).groupBy("g").count().collect()
    assert all(r["count"] == 3 for r in got) and len(got) == 4


def test_sample(spark):
    df = spark.range(300)
    got = {r.id for r in samples.sample(df, ["id"], 40).collect()}
    assert len(got) == 40 and got != set(range(40))
    assert samples.sample(df, ["id"], 1000).count() == 300


def test_first_databases(corpus):
    got = samples.first_databases(corpus, 2).select("database_name").distinct().collect()
    assert {r[0] for r in got} == {"d0", "d1"}


@pytest.mark.parametrize("name", list(STRATEGIES))
def test_every_strategy_builds(corpus, name):
    for df in build_samples(corpus, name, target_triplets=20).values():
        assert df.count() > 0


def test_unknown_strategy(corpus):
    with pytest.raises(ValueError):
        build_samples(corpus, "nope")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plans_have_no_cross_join(spark):
    corpus = written(order_corpus(spark, SF), "corpus")
    for df in (samples.triplets(corpus, 100), samples.pairs(corpus)):
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_line_limit_is_applied_before_the_shuffle(spark):
    text = plan(order_corpus(spark, SF))
    assert text.count("WindowGroupLimit") >= 2 and "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_triplets_are_drawn_in_rounds(spark, monkeypatch):
    """Half of the databases have one table, so that attempts fail; no more are drawn than the target takes."""
    corpus = make_corpus(spark, [
        (f"d{i}", f"t{j}", ["a"], [["x"]], []) for i in range(40) for j in range(1 if i % 2 else 3)
    ])
    drawn, whole = [], samples.written

    def counted(df, name):
        out = whole(df, name)
        if name == "attempts":
            drawn.append(out.agg(F.max("attempt")).first()[0])
        return out

    monkeypatch.setattr(samples, "written", counted)
    rows = lambda n: [tuple(r) for r in samples.triplets(corpus, n).orderBy("attempt").collect()]
    some = rows(1000)
    assert len(some) == 1000 and drawn[-1] < 2500  # of 3000 that may be drawn
    assert some[:300] == rows(300) and some == rows(1500)[:1000]
    assert rows(0) == []


def test_first_by_cuts_without_a_shuffle_of_rows(spark):
    df = written(spark.range(1000).where("id % 3 <> 1").selectExpr("id * 7 AS at", "cast(id AS string) AS text"), "places")
    places = sorted(r["at"] for r in df.collect())
    for n in (0, 1, 100, 666, 667, 668, 2000):
        got = samples.first_by(df, "at", n, bucket_rows=64)
        assert sorted(r["at"] for r in got.collect()) == places[:n]
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
