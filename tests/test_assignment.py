"""Assignments solved together have the totals that all permutations have."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreframe.functions import lists


def best_total(gain):
    n, m = gain.shape
    gain = gain if n <= m else gain.T
    return max(sum(gain[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(gain.shape[1]), gain.shape[0]))


def check(gains, totals):
    for gain, pairs, total in zip(gains, lists.best_assignments(gains), totals, strict=True):
        assert len(pairs) == len({r for r, _ in pairs}) == len({c for _, c in pairs}) == min(gain.shape)
        assert sum(gain[r, c] for r, c in pairs) == pytest.approx(total)


@pytest.mark.parametrize("kind", ["any", "sparse", "negative", "equal rows", "zero"])
def test_many_shapes_together(kind):
    rng = np.random.default_rng(len(kind))
    gains = []
    for _ in range(150):
        gain = rng.random(rng.integers(1, 7, 2)).round(1)
        if kind == "sparse":
            gain[rng.random(gain.shape) < 0.7] = 0
        elif kind == "negative":
            gain -= 0.5
        elif kind == "equal rows":
            gain[:] = gain[0]
        elif kind == "zero":
            gain[:] = 0
        gains.append(gain)
    check(gains, [best_total(g) for g in gains])


def test_order_and_batches_do_not_matter(monkeypatch):
    rng = np.random.default_rng(3)
    gains = [rng.random(rng.integers(1, 12, 2)) for _ in range(60)]  # no ties
    whole = lists.best_assignments(gains)
    assert [lists.best_assignment(g) for g in gains] == whole
    monkeypatch.setattr(lists, "TOGETHER", 1)
    assert lists.best_assignments(gains[::-1])[::-1] == whole


def test_long_lists_fall_into_components():
    """2,000 entries in shuffled blocks of three: the total is that of the blocks."""
    rng = np.random.default_rng(5)
    blocks = [rng.random((3, 3)) for _ in range(667)]
    gain = np.zeros((2001, 2001))
    for k, block in enumerate(blocks):
        gain[3 * k : 3 * k + 3, 3 * k : 3 * k + 3] = block
    gain = gain[rng.permutation(2001)][:, rng.permutation(2001)]
    check([gain], [sum(best_total(b) for b in blocks)])


def test_nulls_and_empty_matrices(spark):
    rows = [(1, [[0.0, 1.0], [1.0, 0.5]]), (2, []), (3, None), (4, [[]]), (5, [[0.25]])]
    df = spark.createDataFrame(rows, "k int, m array<array<double>>").coalesce(1)
    got = {r.k: r.t for r in df.select("k", F.col("m")).withColumn("t", lists.best_pairs("m")["total"]).collect()}
    assert got == {1: 2.0, 2: 0.0, 3: None, 4: 0.0, 5: 0.25}
