"""Phrase and proximity matches against brute force."""

import random

import pytest

from shelfgrade.llm import decontaminate
from tests.llm.brute import hits, windows

@pytest.fixture(scope="module")
def data():
    rnd = random.Random(8)
    vocab = ["the", "of", "Où", "x1", "éa", "zz", "q", "lorem", "ipsum", "dolor"] + [f"w{i}" for i in range(40)]
    weights = [40, 30, 20] + [3] * 47
    prose = lambda n: " ".join(rnd.choices(vocab, weights, k=n))
    items = [(i, prose(rnd.choice([1, 2, 3, 4, 6, 14]))) for i in range(12)] + [(3, prose(5)), (None, "null id item here"), (20, None), (21, ""), (22, "!!"), (23, "absentword the of"), (24, "the the the the the the")]
    docs = []
    for i in range(60):
        text = prose(rnd.randrange(0, 60))
        if i % 3 == 0:
            text += ". " + (rnd.choice(items)[1] or "").upper() + "\n" + prose(5)
        docs.append((i, text))
    passage = items[5][1]
    docs += [(100 + i, f"a{i} {passage}; {passage} b") for i in range(30)] + [(200, None), (201, ""), (None, passage), (7, passage), (7, passage), (202, "the " * 3000 + passage)]
    return docs, items


def test_contamination(spark, data):
    docs, items = data
    df = spark.createDataFrame([(i, t, 5, "clash") for i, t in docs], "doc_id long, text string, pos long, term string").repartition(4)
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, win long")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r.n_items, tuple(r["items"])) for r in decontaminate.contamination(df, bench, ["doc_id"], size=6).collect())
    wins = windows(items, 6)
    want = []
    for key, text in docs:
        hit, found, n = hits(text, wins)
        want.append((-1 if key is None else key, n, len(hit), len(found), tuple(sorted(found))))
    assert got == sorted(want)
    assert {r.n_hit for r in decontaminate.contamination(df, bench.limit(0), ["doc_id"]).collect()} == {0}
    assert decontaminate.contamination(df.limit(0), bench, ["doc_id"]).count() == 0


@pytest.mark.parametrize("slop", [0, 2])
def test_proximity(spark, data, slop):
    docs, items = [d for d in data[0] if d[0] not in (None, 7)], data[1]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = decontaminate.build_index(df, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"], size=4)
    ids = {r.doc: r.doc_id for r in index.postings.where("term = 0").collect()}
    found, scratch = decontaminate.window_matches(index, slop)
    anchors = {r.win: r.off for r in index.steps.where("rank = 1").collect()}
    texts = {r.win: tuple(x.item for x in index.items.where(f"win = {r.win}").collect()) for r in index.windows.collect()}
    got = {(ids[r.doc], texts[r.win], r.n, r.start) for r in found.collect()}
    # The windows by their items, as brute force knows no numbers.
    wins = {}
    for r in index.steps.collect():
        wins.setdefault(r.win, {})[r.off] = r.term
    terms = {}
    for r in index.postings.where("term > 0").collect():
        terms.setdefault(ids[r.doc], {})[r.pos] = r.term
    want = set()
    for doc, at in terms.items():
        for win, offs in wins.items():
            for pos, term in at.items():
                if term == offs[anchors[win]]:
                    start = pos - anchors[win]
                    if start >= -slop and all(any(at.get(start + o + d) == t for d in (range(-slop, slop + 1) if o != anchors[win] else [0])) for o, t in offs.items()):
                        want.add((doc, texts[win], len(offs), start))
    assert got == want and got
    for path in scratch:
        decontaminate.release(spark, path)
    index.release()
