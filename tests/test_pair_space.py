"""Seeded shuffle and split of implicit pairs."""
import numpy as np
import pytest

from tabscout.operators import pair_space, samples
from conftest import make_corpus


@pytest.mark.parametrize("total", [1, 2, 3, 7, 97, 1000, 72510, 104729])
def test_permutation_is_one_to_one_and_inverts(total):
    order = pair_space.Permutation(total, 7)
    ranks = np.arange(total)
    at = order.positions(ranks)
    assert sorted(at.tolist()) == ranks.tolist()
    assert (order.ranks(at) == ranks).all()
    if total > 1000:  # no trace of the order before
        assert abs(np.corrcoef(ranks, at)[0, 1]) < 0.02 and np.mean(np.diff(at) == 1) < 0.01
        assert (order.positions(ranks) != pair_space.Permutation(total, 8).positions(ranks)).mean() > 0.9


def test_permutation_of_a_huge_space():
    order = pair_space.Permutation(10 ** 17 + 3)
    ranks = np.array([0, 1, 2, 10 ** 9, 10 ** 17, 10 ** 17 + 2])
    at = order.positions(ranks)
    assert len(set(at.tolist())) == 6 and at.min() >= 0 and at.max() < order.total and (order.ranks(at) == ranks).all()


def test_anchor_of_every_rank():
    for n in (2, 3, 10, 57):
        want = [(i, j) for i in range(n) for j in range(i + 1, n)]
        i, j = pair_space.anchor_of(np.arange(len(want)), np.full(len(want), n))
        assert list(zip(i.tolist(), j.tolist())) == want
    n = 3_000_000_000  # ranks of some 4.5e18
    rank = np.array([0, n - 2, n - 1, n * (n - 1) // 2 - 1])
    i, j = pair_space.anchor_of(rank, np.full(4, n))
    assert list(zip(i.tolist(), j.tolist())) == [(0, 1), (0, n - 1), (1, 2), (n - 2, n - 1)]


@pytest.fixture(scope="module")
def space(spark):
    tables = [(f"db{d}", f"t{d}_{t}", ["c"], [["1"]], []) for d, n in enumerate([40, 1, 2, 0, 7, 3]) for t in range(n)]
    tables.append(("db0", "empty", ["c"], [], []))
    return pair_space.pair_space(samples.index(make_corpus(spark, tables)), 3)


@pytest.mark.parametrize("block", [1 << 16, 5])
def test_shuffle_split_and_reader_agree(space, monkeypatch, block):
    monkeypatch.setattr(pair_space, "BLOCK", block)
    rows = [tuple(r) for r in pair_space.shuffled_pairs(space).collect()]
    assert space.positives == 780 + 1 + 21 + 3 and space.negatives == 5
    assert sorted(r[0] for r in rows) == list(range(space.order.total))
    positive = [frozenset((r[2], r[4])) for r in rows if r[5] == 0.5]
    assert len(set(positive)) == len(positive) == space.positives and all(r[1] == r[3] for r in rows if r[5] == 0.5)
    assert sorted(tuple(r) for r in pair_space.pairs_at(space, 0, 10 ** 6).collect()) == sorted(rows)
    part = [tuple(r) for r in pair_space.pairs_at(space, 100, 116).collect()]
    assert sorted(part) == sorted(r for r in rows if 100 <= r[0] < 116)
    cut = int(0.9 * space.order.total)
    counts = {(r.table_name, r.kind): (r.n_pairs, r.n_train) for r in pair_space.split_counts(space).collect()}
    assert sum(n for n, _ in counts.values()) == space.order.total and sum(t for _, t in counts.values()) == cut
    for (name, kind), (n, train) in counts.items():
        own = [r for r in rows if r[2] == name and (r[5] == 0.5) == (kind == "positive")]
        assert n == len(own) and train == sum(r[0] < cut for r in own)


def test_empty_space(spark):
    nothing = pair_space.pair_space(samples.index(make_corpus(spark, [("a", "t", ["c"], [["1"]], [])])), 3)
    assert nothing.order.total == 0
    assert pair_space.shuffled_pairs(nothing).count() == 0 == pair_space.pairs_at(nothing, 0, 10).count()
    assert pair_space.split_counts(nothing).count() == 0
