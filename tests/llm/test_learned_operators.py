"""The quality field, the learned partitions, the pipeline and the registered queries."""
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tabscout.llm import golay, linecrf, partitions, queries, shingles

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    good = labels == 1
    return (order[good].mean() - (good.sum() - 1) / 2) / (~good).sum()


def test_field_on_held_out_documents(spark):
    got = queries.QUERIES["op8_line_crf"](spark, SF2).collect()
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF2, "labels").collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    y = np.array([labels[r.doc_id] for r in held])
    assert auc(np.array([r.score for r in held]), y) > 0.97
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 4])
    good, step = rng.normal(size=8), rng.normal(size=(2, 2))
    p, _ = linecrf.Chains(lengths).marginals(good, step)
    at = 0
    for n in lengths:
        total, sums = 0.0, np.zeros(n)
        for code in range(2 ** n):
            y = [code >> k & 1 for k in range(n)]
            weight = np.exp(sum(good[at + k] * y[k] for k in range(n)) + sum(step[a, b] for a, b in zip(y, y[1:])))
            total += weight
            sums += weight * np.array(y)
        assert np.allclose(p[at:at + n], sums / total)
        at += n


def test_field_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "x\n\ny", "b"), (None, "z " * 5000, "c"), (3, "l\n" * 3000, "d")],
                                 "doc_id bigint, text string, _score string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = linecrf.with_scores(docs, none, F.lit(True), "q").collect()
    assert len(got) == 5 and all(r.q == pytest.approx(0.5) for r in got)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (None, 1), (3, None), (3, 0)], "doc_id bigint, quality int")
    kept = linecrf.good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert linecrf.good_documents(docs.limit(0), labels).count() == 0


def neighbours(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if j != i][:k]
    return out


def check(got, want, least):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    recalls = []
    for q, best in want.items():
        mine = sorted(by.get(q, []), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(best) + 1))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        recalls.append(len({r.vec_id for r in mine} & {v for v, _ in best}) / max(1, len(best)))
    assert set(by) <= set(want) and np.mean(recalls) >= least


@pytest.mark.parametrize("hot", [0, 2000])
def test_partitions_recall(spark, hot):
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.normal(size=(60, 16))[rng.integers(0, 60, 6000)] + 0.4 * rng.normal(size=(6000, 16)), np.ones((hot, 16))))
    ids = rng.permutation(len(x)) + 1
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>")
    check(partitions.search(df, F.col("vec_id") % 20 == 0).collect(), neighbours(ids, x, 20), 0.9)


def test_partitions_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0], 1), (40, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1),
            (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0], 1), (None, [1.0, 1.0], 1), (60, [-1.0, 0.0], 1), (80, [], 1), (9, [0.5, 0.5], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rep int")
    got = partitions.search(df, F.col("vec_id") % 20 == 0)
    best = [(r.query_id, r["rank"], r.vec_id, r.score) for r in got.orderBy("query_id", "rank").collect()]
    assert best == [
        (20, 1, 40, 1.0), (20, 2, 1, 0.5), (20, 3, 9, 0.5), (20, 4, 60, -1.0),
        (40, 1, 20, 1.0), (40, 2, 1, 0.5), (40, 3, 9, 0.5), (40, 4, 60, -1.0),
        (60, 1, 1, -0.5), (60, 2, 9, -0.5), (60, 3, 20, -1.0), (60, 4, 40, -1.0)]
    assert partitions.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert partitions.search(df.where("vec_id in (2, 3)"), F.col("vec_id") % 20 == 0).count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1000, 8))
    part = partitions.balanced_parts(partitions.nearest(x, np.arange(1000), 10), 7)
    assert np.bincount(part, minlength=7).max() <= np.ceil(1000 / 7 * 1.1)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before, counts = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns
        counts.append(after.count())
        before = after
    assert docs.count() > counts[0] > counts[1] >= counts[2] > 0
    assert corpus_pipeline.run(spark, SF).count() == counts[3]


def by_jaccard(rows, words=5, least=0.8):
    """Smallest id of every component, by comparing all with all."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and (sets[i] == sets[j] or both >= least * (len(sets[i]) + len(sets[j]) - both)):
                label = [label[j] if x == label[i] else x for x in label]
    group = {}
    for (i, _), x in zip(rows, label):
        group.setdefault(x, []).append(i)
    return sorted((min((i for i in g if i is not None), default=None) for g in group.values()), key=str)


def test_near_dedup_stage(spark, monkeypatch):
    rng = np.random.default_rng(5)
    text = lambda n: [f"w{k}" for k in rng.integers(0, 3000, n)]
    rows = [(1000, None), (1001, ""), (1002, " \n "), (1003, "one two"), (1004, "ONE two"), (None, "no id at all"), (None, "no id at all"),
            (7, "one two three four five six"), (7, "one two three four five seven"), (None, "one two")]
    for g in range(40):  # pairs on both sides of the limit
        base = text(int(rng.integers(40, 300)))
        rows.append((len(rows), " ".join(base)))
        for _ in range(3):
            other = list(base)
            for k in rng.integers(0, len(base), max(1, len(base) * int(rng.integers(1, 5)) // 100)):
                other[k] = f"x{len(rows)}"
            rows.append((len(rows), " ".join(other)))
    base = text(120)
    for n in range(120):  # one large group
        other = list(base)
        for k in rng.integers(0, 120, int(rng.integers(0, 6))):
            other[k] = f"y{n}"
        rows.append((5000 + n, " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = by_jaccard(rows)
    assert sorted((r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()), key=str) == want
    monkeypatch.setattr(shingles, "SPLIT", 3)
    monkeypatch.setattr(shingles, "NEAR", 1)
    assert sorted((r.doc_id for r in shingles.deduplicate(df).collect()), key=str) == want
    assert shingles.deduplicate(df.limit(0)).count() == 0
    named = df.selectExpr("*", "1 as _kept", "2 as _of", "3 as node", "4 as least", "5 as _row")
    assert sorted((r.doc_id for r in shingles.deduplicate(named).collect()), key=str) == want


def test_near_dedup_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in rng.integers(0, 3000, 800)]
    rows = [(0, " ".join(base)), (1, " ".join(base)), (2, " ".join(base[:-1])), (3, " ".join(base[1:])), (4, None), (5, "one two")]
    rows += [(10 + n, " ".join(f"w{k}" for k in rng.integers(0, 3000, 300))) for n in range(20)]
    ids = [shingles.shingle_ids(t, 5) for _, t in rows]
    fp = {i: golay.majority(x) for (i, _), x in zip(rows, ids)}
    near = {(a, b) for a in fp for b in fp if a < b and ((fp[a] ^ fp[b]) & ((1 << 64) - 1)).bit_count() <= 3}
    assert {(0, 1), (0, 2), (0, 3)} <= near and all(b < 4 for _, b in near)
    nodes = spark.createDataFrame(list(fp.items()), "node bigint, fp bigint")
    pairs = [(r.a, r.b) for r in shingles.simhash_pairs(nodes).collect()]
    assert {x for p in pairs for x in p} == {0, 1, 2, 3}

    # A sketch differs in no more bits than the sets in hashes.
    bits = [np.unpackbits(np.frombuffer(shingles._sketch(x), np.uint8)) for x in ids]
    assert all((a != b).sum() <= len(np.setxor1d(x, y)) for a, x in zip(bits, ids) for b, y in zip(bits, ids))
    # Fingerprints link what no shingle of a prefix does.
    monkeypatch.setattr(shingles, "_possible", lambda a, b, similarity: F.lit(False))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in shingles.deduplicate(df).collect()} == set(fp) - {1, 2, 3}


def test_near_dedup_stage_on_data(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted((r.doc_id for r in shingles.deduplicate(docs).collect()), key=str) == by_jaccard(rows)


def test_registered():
    ours = {q.split("_")[0] for q in entry.queries() if q.startswith("op")}
    assert ours == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()
