"""Scores, bounds and ranks against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from shelfgrade.llm import ranked_search
from tests.llm.brute import ascii_lower

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(ascii_lower(text))


def plain(docs, items, k):
    counted = [(key, Counter(terms(text))) for key, text in docs]
    n_docs = sum(1 for _, c in counted if c)
    all_terms = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, c in counted:
            part = 25 + (75 * sum(c.values()) * n_docs) // all_terms if all_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * part)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return Counter(out)


def corpus():
    rnd = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("wor", "Te", "é", "zz", "ab1") for b in range(60)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [" ".join(rnd.choices(vocabulary, weights, k=rnd.choice([1, 3, 20, 80, 300]))) for _ in range(250)]
    texts += [texts[3]] * 40 + [texts[4].upper(), None, "", " .,-", "zz1 " * 20_000, "once-seen_word", " ".join(f"long{i}" for i in range(20_000))]
    docs = [(i + 1, t) for i, t in enumerate(texts)] + [(None, texts[3]), (2, texts[1]), (2, "zz1 zz2")]
    items = [(f"i{i}", " ".join(rnd.choices(vocabulary, weights, k=rnd.choice([1, 5, 30])))) for i in range(30)]
    items += [("null", None), ("none", "?!"), ("unknown", "neverseen"), ("i1", "zz1, zz1 ZZ2"), (None, "once seen word"), ("copy", texts[3]), ("long", " ".join(f"long{i}" for i in range(500)))]
    return docs, items


@pytest.mark.parametrize("block_items, first, room", [(256, 32, 4), (7, 2, 1)])
def test_ranks(spark, monkeypatch, block_items, first, room):
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", block_items)
    monkeypatch.setattr(ranked_search, "FIRST", first)  # small: many waves
    monkeypatch.setattr(ranked_search, "ROOM", room)
    docs, items = corpus()
    df = spark.createDataFrame([(*d, "x", 1.0) for d in docs], "doc_id long, text string, key string, score double").repartition(4)
    asked = spark.createDataFrame([(*i, 3) for i in items], "item_id string, text string, hash int")
    got = Counter(map(tuple, ranked_search.ranked_search(df, "doc_id", asked, "item_id", k=10).collect()))
    assert got == plain(docs, items, 10)


def test_bounds_hold():
    rnd = random.Random(1)
    docs = [[f"t{rnd.randrange(600)}".encode() for _ in range(rnd.choice([1, 30, 400]))] + [b"often"] * rnd.choice([0, 300]) for _ in range(50)]
    items = [[f"t{rnd.randrange(700)}".encode() for _ in range(12)] + [b"often"] for _ in range(20)]
    hashes = ranked_search._Hashes()
    frequency = Counter(hashes[t] - 2**64 * (hashes[t] >= 2**63) for own in docs for t in set(own))
    block = ranked_search.Block(items, frequency, len(docs), sum(map(len, docs)))
    close = 0
    for own in docs:
        folded = ranked_search.sketches_of(*np.unique(ranked_search.term_hashes(own, hashes), return_counts=True))[None]
        bounds = block.bounds(folded, np.array([len(own)]), block.matrix())[0]
        scores = [block.score(block.counts(own), len(own), q) for q in range(len(items))]
        assert all(b >= s for b, s in zip(bounds, scores))
        close += sum(b <= 1.01 * s for b, s in zip(bounds, scores) if s)
    assert close > 300


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "text")], "item_id string, text string")
    columns = ["item_id", "rank", "doc_id", "score"]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.select("doc_id", docs.text.substr(1, 0).alias("text")), items)):
        found = ranked_search.ranked_search(d, "doc_id", i, "item_id")
        assert found.columns == columns and found.count() == 0
