import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscout.operators import epochs, losses, runs


def log(spark, values):
    return spark.createDataFrame([(r, i + 1, float(v)) for r, vs in values.items() for i, v in enumerate(vs)],
                                 "run string, epoch long, val_loss double")


@pytest.mark.parametrize("block", [3, 65536])
def test_early_stop(spark, block):
    df = log(spark, {"a": [5, 4, 6, 6, 6, 6, 6, 3], "b": [3, 2, 1]})
    out = epochs.early_stop(epochs.progress(df, block_rows=block), block_rows=block)
    got = {r.run: (r.epochs, r.best_val_loss, r.early_stopped) for r in epochs.run_summary(out).collect()}
    assert got == {"a": (7, 4.0, True), "b": (3, 1.0, False)}


def test_equal_loss_is_no_improvement_and_perplexity_is_capped(spark):
    got = epochs.progress(log(spark, {"a": [2, 2, 40]})).orderBy("epoch").collect()
    assert [r.waited for r in got] == [0, 1, 2] and [r.improved for r in got] == [True, False, False]
    assert got[2].perplexity == pytest.approx(math.exp(30))


def record(spark, n, seconds):
    return spark.createDataFrame([("d", "m", n, float(seconds), float(seconds), float(seconds), 1.0, 64)],
                                 "dataset string, model string, embeddings_count long, total_time_seconds double, "
                                 "encoding_inference_time_seconds double, indexing_time_seconds double, "
                                 "embeddings_size_mb double, embedding_dimension int")


def test_zero_counts_and_times_are_null(spark):
    r = runs.finalise(record(spark, 0, 0)).first()
    assert r.throughput_embeddings_per_sec is None and r.avg_time_per_embedding_ms is None
    assert runs.efficiency(record(spark, 0, 0)).first().overall_throughput_per_sec is None
    r = runs.finalise(record(spark, 10, 4)).first()
    assert (r.throughput_embeddings_per_sec, r.avg_time_per_embedding_ms, r.storage_per_1k_embeddings_mb) == (2.5, 400.0, 100.0)


def test_model_types(spark):
    df = spark.createDataFrame([(m, 10, 1.0) for m in ("baseline_x", "unsupervised_v6", "supervised_v1", "hybrid", "z")],
                               "model string, processed_tables long, throughput_embeddings_per_sec double")
    got = [r.model_type for r in runs.classify(df).collect()]
    assert got == ["baseline", "unsupervised", "supervised", "hybrid", "other"]


def test_last_run_wins_in_pivot(spark):
    df = spark.createDataFrame([("d", "m", 1.0, "2024-01-01"), ("d", "m", 2.0, "2024-02-01"), ("e", "n", 3.0, "2024-01-01")],
                               "dataset string, model string, v double, timestamp_end string")
    got = {r.dataset: (r.m, r.n) for r in runs.pivot(df, "v", ["m", "n"]).collect()}
    assert got == {"d": (2.0, None), "e": (None, 3.0)}


def test_inventory(spark):
    df = spark.createDataFrame([("ds_m_v1", 1, 2), ("plain", 1, 2), ("My_Test_x", 1, 2)],
                               "collection string, embeddings long, dimension int")
    got = {r.collection: (r.dataset, r.model) for r in runs.inventory(df).collect()}
    assert got == {"ds_m_v1": ("ds", "m_v1"), "plain": ("plain", "unknown"), "My_Test_x": ("test", "My_Test_x")}


def test_reconcile_and_status(spark):
    one = lambda *d: spark.createDataFrame([(x,) for x in d], "dataset string")
    got = {r.dataset: (r.tables, r.vectors, r.matches) for r in runs.reconcile(one("a", "a", "b"), one("a", "a", "c")).collect()}
    assert got == {"a": (2, 2, True), "b": (1, 0, False), "c": (0, 1, False)}
    docs = spark.createDataFrame([("a", "x", 2), ("admin", "y", 1)], "dataset string, collection string, n long")
    got = {r.dataset: (r.documents, r.loaded) for r in runs.load_status(one("a", "admin", "z"), docs).collect()}
    assert got == {"a": (2, True), "admin": (0, False), "z": (0, False)}


def test_correlation_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.uniform(-1, 1, 500), 2)
    y = np.where(x + rng.normal(size=500) > 0, 0.5, 0.0)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "cosine double, label double")
    got = losses.similarity_correlation(df.groupBy("cosine", "label").agg(F.count(F.lit(1)).alias("w"))).first()

    def ranks(v):
        order = np.sort(v)
        return np.array([(np.searchsorted(order, a) + np.searchsorted(order, a, "right") + 1) / 2 for a in v])

    assert got.n == 500 and got.pearson == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-6)
    assert got.spearman == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1], abs=1e-6)


def test_losses_against_numpy(spark):
    rng = np.random.default_rng(1)
    a, p = rng.normal(size=(20, 4)), rng.normal(size=(20, 4))
    df = spark.createDataFrame([(i, a[i].tolist(), p[i].tolist()) for i in range(20)],
                               "position long, anchor array<double>, positive array<double>")
    got = losses.in_batch_loss(df, batch_size=8).first()
    u = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    total = 0
    for s in range(0, 20, 8):
        z = 20 * u(a[s:s + 8]) @ u(p[s:s + 8]).T
        total += (np.log(np.exp(z).sum(axis=1)) - np.diag(z)).sum()
    assert got.n == 20 and got.loss == pytest.approx(total / 20, abs=1e-5)
