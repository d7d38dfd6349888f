"""Shingle sets, filters and groups against brute force."""

import random

import numpy as np
import pytest

from shelfgrade.llm import jaccard
from tests.llm.brute import ascii_lower, roots


def shingles(text, n=3):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def linked(a, b):
    return bool(a and b) and 100 * len(a & b) >= 90 * len(a | b)


def altered(words, rnd, times):
    words = list(words)
    for _ in range(times):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return words


def rows():
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdé") for _ in range(4)) for _ in range(300)]
    texts = []
    for length in (40, 60, 150, 400, 1000):
        for _ in range(4):
            base = [rnd.choice(vocabulary) for _ in range(length)]
            texts.append(base)
            texts += [altered(base, rnd, rnd.choice([1, 1, 2, length // 50 + 1])) for _ in range(8)]
            texts.append(base[: int(length * 0.92)])
            texts.append(base[: int(length * 0.9) + 1])
    passage = [rnd.choice(vocabulary) for _ in range(120)]  # shared by many unlike texts
    texts += [passage + [rnd.choice(vocabulary) for _ in range(rnd.choice([15, 40, 100]))] for _ in range(30)]
    out = [" ".join(t) for t in texts]
    out += [out[0]] * 30 + [out[0].upper(), out[1].replace(" ", "\x0b\t ")]
    out += [None, "", " \t\r\n", "one", "ONE", "one two", "two one", "one two three", "x " * 30000, "x x x", "é é a b c"]
    return [(i + 1, t) for i, t in enumerate(out)] + [(None, out[0]), (None, None), (5, out[4]), (5, "other words than those")]


def expected(data):
    sets = [shingles(t) for _, t in data]
    group = roots(range(len(data)), lambda a, b: linked(sets[a], sets[b]))
    least = {}
    for at, (key, _) in enumerate(data):
        if key is not None:
            least[group[at]] = min(key, least.get(group[at], key))
    return sorted(((key or 0), len(sets[at]), least.get(group[at]) or 0) for at, (key, _) in enumerate(data))


@pytest.mark.parametrize("block, short", [(1024, 8), (4, 2)])
def test_groups(spark, monkeypatch, block, short):
    monkeypatch.setattr(jaccard, "BLOCK", block)  # read when the plan is made
    monkeypatch.setattr(jaccard, "SHORT", short)
    data = [(*r, "a", 7) for r in rows()]
    df = spark.createDataFrame(data, "doc_id long, text string, _text string, component_id int").repartition(5)
    got = jaccard.similar_groups(df, "doc_id", keep=["_text", "component_id"])
    assert got.columns == ["doc_id", "_text", "n_shingles", "component_id"]
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got.collect()) == expected(rows())


def test_no_rows_and_no_sets(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert jaccard.similar_groups(df.limit(0), "doc_id").count() == 0
    assert sorted(map(tuple, jaccard.similar_groups(df, "doc_id").collect())) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("whole", [False, True])
def test_filters_keep_all_links(whole):
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 2**63, 120, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rnd.permutation(120)[: rnd.integers(100, 121)]], rnd.integers(0, 2**63, rnd.integers(0, 8), dtype=np.uint64)])) for _ in range(90)]
    sets = sorted(sets, key=len)
    n = np.array([len(s) for s in sets])
    cells = np.stack([np.minimum(np.bincount((s >> np.uint64(57)).astype(int), minlength=128), 255).astype(np.uint8) for s in sets])
    # Every pair shares this list at place 0, so only length and suffix filters act.
    a, b = jaccard.candidates(n, np.zeros(len(n), int), cells, np.arange(len(n)), whole)
    pairs = {(int(x), int(y)) for x, y in zip(a, b)}
    plain = [set(s.tolist()) for s in sets]
    links = {(i, j) for i in range(90) for j in range(i + 1, 90) if linked(plain[i], plain[j])}
    assert links
    if whole:
        assert links <= pairs
    else:
        near = roots(range(90), lambda i, j: (i, j) in pairs)
        assert len(pairs) < 90 and all(near[i] == near[j] for i, j in links)


def test_two_thirds_of_the_rows_are_copies(spark):
    """Copies cost one row of the sets, and their rows are dealt over the tasks of the last join."""
    from shelfgrade.operators.joins import hot_keys

    data = [(i, "the same text in all of these rows" if i % 3 else f"text {i} has words {i + 1} of {i + 2} its own") for i in range(6000)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(df, "doc_id").collect()}
    assert got == {i: 1 if i % 3 else i for i in range(6000)}
    assert hot_keys(df, ["text"]).count() == 1


def test_likely_rows_hold_all_that_are_asked_for(spark):
    rows = spark.range(20_000).selectExpr("id", "xxhash64(id) AS h")
    asked = rows.where("id % 50 = 0")
    passed = {r.id for r in jaccard._likely(rows, asked, "h").collect()}
    assert {i for i in range(0, 20_000, 50)} <= passed and len(passed) < 600
    assert jaccard._likely(rows, asked.limit(0), "h").count() == 0


@pytest.mark.parametrize("held", [1 << 20, 2000])
def test_near_misses_make_no_rows_of_pairs(spark, monkeypatch, held):
    """Texts that pass the filters and do not link are counted in their list; only forests are written."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(1000)]
    texts = [altered(base, rnd, 11) for _ in range(60)]  # two of them overlap by about 0.88
    texts += [t[:-1] + ["last"] for t in texts[::5]]
    data = [(i, " ".join(t)) for i, t in enumerate(texts)]
    asked = []
    verified = jaccard._verified
    monkeypatch.setattr(jaccard, "HELD", held, raising=False)
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, bodies: asked.append(pairs.count()) or verified(pairs, bodies))
    got = jaccard.similar_groups(spark.createDataFrame(data, "doc_id long, text string").repartition(4), "doc_id").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected(data)
    assert len({r.component_id for r in got}) > 10
    assert len(asked) == 1  # the forests' pairs, and no others after them
