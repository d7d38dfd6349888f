"""Exact products against brute force: pruning, ties, copies and odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfgrade.llm import top_products as tp

SCHEMA = "vec_id long, embedding array<float>, score long, block int"


def by_hand(rows, k=5):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    if not ok:
        return []
    size = max({len(v) for _, v in ok}, key=lambda n: (sum(len(v) == n for _, v in ok), -n))
    ok = [(i, v) for i, v in ok if len(v) == size]
    m = np.array([v for _, v in ok], np.int64)
    out = []
    for a, (i, v) in enumerate(ok):
        if i % 50 == 0:
            s = m @ m[a]
            best = sorted((-s[b], j) for b, (j, _) in enumerate(ok) if b != a)[:k]
            out += [(i, r + 1, j, int(-x)) for r, (x, j) in enumerate(best)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in tp.top_products(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, **more).collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(tp, "BLOCK", 64)
    monkeypatch.setattr(tp, "QUERIES", 7)


def test_random_vectors_of_all_lengths(spark, small):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (600, 40)) * rng.exponential(1, (600, 1)) * np.linspace(2, 0.05, 40)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    assert run(spark, rows) == by_hand(rows)


def test_copies_ties_and_odd_rows(spark, small):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, -0.5, 0.25, 0.0] if i % 3 else [float(c) for c in rng.integers(-2, 3, 4)]) for i in range(300)]
    rows += [(300, None), (350, []), (400, [1.0, None, 0.0, 0.0]), (450, [float("nan"), 0.0, 0.0, 0.0]), (500, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    rows += [(550, [0.0, 0.0, 0.0, 0.0]), (600, [1.0, 2.0, 3.0]), (100, [1.0, -0.5, 0.25, 0.0]), (7, [3.0, 0.0, 0.0, 0.0])]
    assert run(spark, rows) == by_hand(rows)


def test_each_length_has_its_products(spark, small):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(0, 1, (3, 20, 40)[i % 7 % 3])]) for i in range(900)]
    rows += [(950, [1.0, 2.0]), (1001, [1.0])]  # alone in their lengths
    want = [r for n in (3, 20, 40) for r in by_hand([(i, v) for i, v in rows if len(v) == n])]
    assert len({r[0] for r in want}) == 18 and run(spark, rows) == sorted(want)


def test_few_rows(spark):
    assert run(spark, []) == [] and run(spark, [(0, None)]) == []
    assert run(spark, [(0, [1.0, 0.0])]) == []
    assert run(spark, [(0, [1.0, 0.0]), (3, [0.5, 1.0])]) == by_hand([(0, [1.0, 0.0]), (3, [0.5, 1.0])])


def test_pruning_leaves_most_vectors_out():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(0, 1, (2000, 48)) * rng.exponential(1, (2000, 1)) * np.linspace(2, 0.02, 48))
    turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    some = tp.Candidates(np.arange(2000), np.arange(2000), x, turn)
    q = x[::100]
    full = [s for _, s in some.best(np.arange(0, 2000, 100), q, np.full(20, -np.inf), turn, 5)]
    least = np.array([s[-1] for s in full])
    assert all((s == f).all() for (_, s), f in zip(some.best(np.arange(0, 2000, 100), q, least, turn, 5), full))
    need = (least / np.sqrt((q**2).sum(axis=1))).min()
    assert (some.norms >= need).mean() < 0.9
