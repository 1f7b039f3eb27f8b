"""Appends that skip stored ids, next to a set."""
import hashlib
import random

import pytest

from tabscout.schemas import VECTOR_SCHEMA
from tabscout.sources import upserts


def points(spark, ids, n=1, dataset="d"):
    rows = [(hashlib.md5(str(i).encode()).hexdigest(), dataset, "m", "db", str(i), ["a"], n, "c", [0.5]) for i in ids]
    return spark.createDataFrame(rows, VECTOR_SCHEMA)


def stored(spark, path):
    return sorted((r.dataset, r.table_name, r.num_rows) for r in upserts.read(spark, path).collect())


def test_appends_like_a_set(spark, tmp_path):
    path, want = str(tmp_path / "v"), {}
    deal = random.Random(2)
    for turn in range(4):
        ids = [deal.randrange(120) for _ in range(60)]
        upserts.append(points(spark, ids, turn), path)
        for i in ids:
            want.setdefault(str(i), turn)
    upserts.append(points(spark, [1, 2], 9, "001"), path)
    assert stored(spark, path) == sorted([("d", i, n) for i, n in want.items()] + [("001", "1", 9), ("001", "2", 9)])
    assert upserts.append(points(spark, list(map(int, want)), 8), path) is None
    assert len(upserts.committed(spark, path)) == 5


def test_only_touched_buckets_are_read(spark, tmp_path, monkeypatch):
    path, asked = str(tmp_path / "v"), []
    upserts.append(points(spark, range(200)), path, digits=2)
    real = upserts.stored_ids
    monkeypatch.setattr(upserts, "stored_ids", lambda *a: asked.append((a[3], real(*a))) or asked[-1][1])
    fresh = [i for i in range(1000, 1200)]
    upserts.append(points(spark, fresh), path, digits=2)
    assert not asked  # no bit of any new id is set: nothing stored is opened
    upserts.append(points(spark, [7, 5000, 5001]), path, digits=2)
    (buckets, frame), = asked
    assert buckets == [("d", "m", hashlib.md5(b"7").hexdigest()[:2])]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan[plan.index("PartitionFilters"):] and "ReadSchema: struct<point_id:string>" in plan
    assert {r.bucket for r in frame.collect()} == {buckets[0][2]} and frame.count() < 10
    assert len(stored(spark, path)) == 402


def test_two_overlapping_writers(spark, tmp_path):
    path = str(tmp_path / "v")
    upserts.append(points(spark, [1]), path)

    def other():
        upserts.append(points(spark, [2, 3, 4], 7), path)
        upserts.append(points(spark, [5], 7), path)

    upserts.append(points(spark, [1, 3, 4, 5, 6], 8), path, before_commit=other)
    assert stored(spark, path) == [("d", "1", 1), ("d", "2", 7), ("d", "3", 7), ("d", "4", 7), ("d", "5", 7), ("d", "6", 8)]


def test_a_number_is_given_once(spark, tmp_path):
    path = str(tmp_path / "v")
    assert upserts.claim(spark, path, 0, "a") and not upserts.claim(spark, path, 0, "b")
    assert upserts.claim(spark, path, 1, "b") and upserts.committed(spark, path) == ["a", "b"]


def test_what_was_never_committed_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "v")

    def dies():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        upserts.append(points(spark, [1, 2]), path, before_commit=dies)
    assert stored(spark, path) == []
    upserts.append(points(spark, [2, 3]), path)
    assert stored(spark, path) == [("d", "2", 1), ("d", "3", 1)]
    upserts.append(points(spark, []), path)
    assert len(upserts.committed(spark, path)) == 1
