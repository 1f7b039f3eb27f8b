"""Threshold joins and hard negatives next to all scores."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscout.llm import negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, uid int, v string, anchor int, block string"


def vectors():
    deal = np.random.default_rng(3)
    centres = deal.normal(size=(6, 12))
    out = []
    for i in range(700):
        v = centres[i % 6] + deal.normal(size=12)
        out.append((i, (v / np.linalg.norm(v)).tolist(), int(deal.integers(0, 4))))
    nan, inf = float("nan"), float("inf")
    out += [
        (800, None, 1), (801, [0.1, None], 1), (802, [nan] * 12, 2), (803, [inf] * 12, 2), (804, [0.0] * 12, 0), (900, [0.0] * 12, 3),
        (1000, [0.5, 0.25], 1), (1001, [], 2), (1100, [], 2), (None, out[5][1], 0), (None, out[5][1], 1), (805, out[6][1], None),
        (1200, out[7][1], 9), (600, out[100][1], 2), (600, out[100][1], 2), (1300, [-x for x in out[8][1]], 2), (1400, [1e300] * 2, 1), (806, [1e307], 1),
    ]
    return out


def by_hand(rows, every):
    kept = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        kept.append((vec_id, label, [math.floor(256 * x) for x in v]))
    out = []
    for a, (anchor, label, v) in enumerate(kept):
        if anchor is None or anchor % every:
            continue
        scored = [(min(max(sum(x * y for x, y in zip(v, w)), -2**63), 2**63 - 1), vec_id, other == label)
                  for b, (vec_id, other, w) in enumerate(kept) if a != b]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for score, positive, _ in [s for s in scored if s[2]][:5]:
            found = [s for s in scored if not s[2] and 80 * score <= 100 * s[0] <= 100 * score][:5]
            out += [(anchor, positive, rank, s[1], score, s[0]) for rank, s in enumerate(found, 1)]
    return out


def mined(df, every=100, **options):
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.prepared(df, F.col("vec_id") % every == 0, relabel), **options)


@pytest.mark.parametrize("every, block, shares", [(100, 1 << 15, negatives.SHARES), (20, 32, (4, 1)), (100, 700, (1,))])
def test_hard_negatives(spark, monkeypatch, every, block, shares):
    monkeypatch.setattr(negatives, "SHARES", shares)
    df = spark.createDataFrame([(*r, 1, "v", 2, "b") for r in vectors()], SCHEMA).repartition(3)
    got = sorted(map(repr, map(tuple, mined(df, every, block=block).collect())))
    want = sorted(map(repr, by_hand(vectors(), every)))
    assert len(want) > 60 and got == want


def test_hard_negatives_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mined(empty).count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1, 1, "v", 2, "b"), (1, [1.0], None, 1, "v", 2, "b")], SCHEMA)
    assert mined(alone).count() == 0


def test_index_finds_all_and_skips_some():
    deal = np.random.default_rng(4)
    rows = np.floor(256 * deal.normal(size=(3000, 24)) * np.linspace(1, 0.02, 24))
    queries = rows[:50]
    scores = queries @ rows.T
    for share in (0.9, 0.5, 0.0, -5.0):
        t = share * np.sqrt((queries ** 2).sum(axis=1)) * 900
        index = negatives.Index(rows)
        q, r, s = index.at_least(queries, t)
        want = np.argwhere(scores >= t[:, None])
        assert sorted(zip(q.tolist(), r.tolist())) == sorted(map(tuple, want.tolist())) and (s == scores[q, r]).all()
        if share > 0:
            assert index.seen < scores.size * index.groups * 2 / 3  # partial products that bounds saved
