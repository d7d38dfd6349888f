"""Fingerprints, bit-sliced links and groups against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfgrade.llm import simhash
from shelfgrade.llm.components import connected_components
from tests.llm.brute import fingerprint, roots


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_forest(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flipped = [base[:30] ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64) for _ in range(k)]) for k in range(1, 7)]
    x = np.concatenate([base, base[:5], *flipped])
    want = roots({int(v) for v in x}, lambda a, b: (a ^ b).bit_count() <= radius)
    a, b = simhash.forest(x, radius, queries=16)
    pairs = {(int(p), int(q)) for p, q in zip(a, b)}
    assert roots({int(v) for v in x}, lambda p, q: (p, q) in pairs or (q, p) in pairs) == want


def test_links_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)  # read when the plan is made
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = set(base)
    for b in base[:10]:
        values |= {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(12)}
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    pairs = {frozenset((e.a % 2**64, e.b % 2**64)) for e in edges}
    want = roots(values, lambda a, b: (a ^ b).bit_count() <= 3)
    assert all((a ^ b).bit_count() <= 3 or want[a] == want[b] for a, b in map(tuple, pairs))
    assert roots(values, lambda a, b: frozenset((a, b)) in pairs) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (3, 9), (9, 3), (200, 7), (201, 7), (202, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(101, 161)} | {9: 3, 200: 7, 201: 7, 202: 7}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def rows():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdé") for _ in range(5)) for _ in range(400)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 40, 300]))) for _ in range(60)]
    near = [t + " tail" for t in texts[:40]] + [t.upper() for t in texts[:5] if t.isascii()]
    texts += near + ["same text here now"] * 40 + [None, "", " \t", "one", "ONE", "x " * 30000, "x\x0bx x x"]
    return [(i + 1, t, "fp", 0) for i, t in enumerate(texts)] + [(None, "same text here now", "n", 1), (3, texts[2], "again", 0), (3, "other", "again", 0)]


def test_near_copies(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, fp string, component_id long").repartition(5)
    got = simhash.near_copies(df.drop("fp", "component_id"), "doc_id").withColumn("fp", simhash.hex_of(F.col("fp"))).collect()
    prints = [(r[0], fingerprint(r[1])) for r in data]
    group = roots({f for _, f in prints}, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, f in prints:
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    want = sorted((i or 0, f"{f:016x}", least[group[f]]) for i, f in prints)
    assert sorted((r.doc_id or 0, r.fp, r.component_id) for r in got) == want
    kept = simhash.first_copies(df, "doc_id")
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect())
    # Document 3 stands for its own group; its other text has a group of its own.
    assert ids == sorted(list(least.values()))
    assert simhash.near_copies(df.limit(0), "doc_id").count() == 0
