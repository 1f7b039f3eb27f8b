import random

import pandas as pd
from pyspark.sql import functions as F

from tabscout.functions.hashing import h
from tabscout.operators.numbering import buckets_for, hash_bucket, number_sorted, number_within, running


def hot_rows(n=3000):
    """Group 'hot' holds a third of all rows."""
    rnd = random.Random(1)
    return [("hot" if i % 3 == 0 else f"g{rnd.randrange(200)}", i, rnd.random()) for i in range(n)]


def test_number_within_hot_group(spark):
    df = spark.createDataFrame(hot_rows(), "g string, i long, v double").withColumn("x", h(F.col("i")))
    got = number_within(df, ["g"], hash_bucket(F.col("x"), 16), ["x", "i"], "ord", size="n").toPandas()
    want = got.sort_values(["x", "i"]).groupby("g").cumcount()
    assert (got["ord"] == want.reindex(got.index)).all()
    assert (got["n"] == got.groupby("g")["i"].transform("size")).all() and len(got) == 3000


def test_number_all_rows(spark):
    df = spark.range(2000).withColumn("x", h(F.col("id")))
    got = number_within(df, [], hash_bucket(F.col("x"), 256), ["x"], "ord").orderBy("x").toPandas()
    assert list(got["ord"]) == list(range(2000))


def test_number_sorted_with_one_hot_key(spark):
    df = spark.createDataFrame([("same" if i % 3 else f"k{i % 50:02d}", i) for i in range(2000)], "k string, i long")
    got = number_sorted(df, [F.col("k"), F.col("i")], "ord", partitions=7).toPandas().sort_values(["k", "i"])
    assert list(got["ord"]) == list(range(2000))


def test_running_blocks(spark):
    pdf = pd.DataFrame(hot_rows(1500), columns=["g", "i", "v"])
    pdf["pos"] = pdf.groupby("g").cumcount()
    df = spark.createDataFrame(pdf)
    for how, fn in (("min", "cummin"), ("max", "cummax"), ("sum", "cumsum")):
        got = running(df, ["g"], "pos", "v", how, "r", block_rows=7).toPandas().sort_values(["g", "pos"])
        want = getattr(got.groupby("g")["v"], fn)()
        assert (abs(got["r"] - want) < 1e-9).all()
    before = running(df, ["g"], "pos", "v", "min", "r", inclusive=False, block_rows=7).toPandas().sort_values(["g", "pos"])
    want = before.groupby("g")["v"].cummin().groupby(before["g"]).shift()
    assert (before["r"].fillna(-1) == want.fillna(-1)).all()


def test_buckets_follow_the_rows():
    assert buckets_for(0) == 16 and buckets_for(1 << 20) == 16
    assert buckets_for((1 << 26) + 1) == 2048 and buckets_for(10**12) >= 10**12 / (1 << 16)


def test_more_buckets_than_rows_need(spark):
    df = spark.range(500).withColumn("x", h(F.col("id")))
    got = number_within(df, [], hash_bucket(F.col("x"), 4096), ["x"], "ord").orderBy("x").toPandas()
    assert list(got["ord"]) == list(range(500))


def test_rows_of_a_python_reader_are_not_broadcast(spark):
    """Their estimated size is that of the reader's input, a few paths."""
    def read(batches):
        for pdf in batches:
            for i in pdf["id"]:
                yield pd.DataFrame({"g": [f"a{i}"] * 50, "b": [j // 10 for j in range(50)], "i": list(range(50))})

    rows = spark.range(4).mapInPandas(read, "g string, b long, i long")
    got = number_within(rows, ["g"], F.col("b"), ["i"], "ord")
    assert [r.ord for r in got.orderBy("g", "i").collect()] == list(range(50)) * 4
    got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_sorted_rows_are_stored_once_and_not_shuffled_again(spark):
    df = spark.range(500).selectExpr("id % 7 AS k", "id")
    got = number_sorted(df, ["k", "id"], "ord")
    rows = [(r.k, r.id) for r in got.orderBy("ord").collect()]
    assert rows == sorted(rows) and len(rows) == 500
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ExistingRDD" not in plan
