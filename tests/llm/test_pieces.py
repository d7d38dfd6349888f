"""Segmentations against all segmentations, and round trips."""

import itertools
import os
import random

import numpy as np
import pytest

from shelfgrade.llm import pieces, queries

pytestmark = pytest.mark.skipif(not os.path.exists(queries.PIECES), reason="no vocabulary file here")
ODD = ["", " ", "   ", "\n", "▁", " ▁ ", "a▁b", "\0", "\t\r\n x", "😀😀", "é" * 5, "ﬁ x", "a" * 12, "  the  end ", "<s>", "<0x41>", "  ￿"]


@pytest.fixture(scope="module")
def vocab():
    return pieces.Vocabulary(queries.PIECES)


def all_scores(vocab, word):
    if word == pieces.BLANK:
        return [vocab.unknown]
    ending, out = pieces.arcs(vocab, word.replace(" ", pieces.BLANK)), []

    def back(end, score):
        if end == 0:
            out.append(score)
        for start, one, _ in ending[end]:
            back(start, score + one)

    back(len(ending) - 1, 0.0)
    return sorted(out, reverse=True)


def swapped(ids, swaps):
    out = list(ids)
    for at, removed, new in sorted(swaps, reverse=True):
        out[at : at + removed] = new
    return out


def words_of(text):
    return pieces.WORD.findall(" " + text)


def test_words_are_whole(vocab):
    for text in ODD:
        assert "".join(words_of(text)) == " " + text


def test_search_against_all_paths(vocab):
    rnd = random.Random(2)
    words = {w for t in ODD if len(t) < 13 for w in words_of(t)} | {"".join(rnd.choice("abehtn é😀") for _ in range(rnd.randrange(1, 9))) for _ in range(150)}
    for word in {w for t in words for w in pieces.WORD.findall(t)}:
        best = all_scores(vocab, word)
        found = pieces.n_best(vocab, word, 6)
        assert [s for s, _ in found] == best[:6]
        assert len({i for _, i in found}) == len(found)
        solved = pieces.Solved()
        solved.add(vocab, [word])
        assert solved.score[0] == best[0]
        assert solved.loss[0] == (best[0] - best[1] if len(best) > 1 else np.inf)
        assert b"".join(vocab.raw[i] for i in solved.flat).decode() == word


def test_texts_against_products_of_words(vocab):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab the\n▁é") for _ in range(rnd.randrange(12))) for _ in range(60)] + ODD[:12]
    for text, (ids, score, more) in zip(texts, pieces.encode_texts(vocab, texts, 5)):
        # Sums over the words' best few are enough for the sums' best few.
        sums = sorted((sum(p) for p in itertools.product(*(all_scores(vocab, w)[:5] for w in words_of(text)))), reverse=True)
        assert [score, *(s for s, _ in more)] == sums[:5]
        for s, swaps in more:
            new = swapped(ids, swaps)
            assert pieces.decode_ids(vocab, new) == text and new != list(ids)
        assert pieces.decode_ids(vocab, ids) == text


def test_long_words_go_the_same_way(vocab, monkeypatch):
    word = "".join(random.Random(1).choice("abcdefgh") for _ in range(60))
    short = next(pieces.encode_texts(vocab, [word], 3))
    monkeypatch.setattr(pieces, "LONG", 10)
    long = next(pieces.encode_texts(vocab, [word], 3))
    assert short[1] == long[1] and [s for s, _ in short[2]] == [s for s, _ in long[2]]


def test_encode_and_decode(spark, vocab, monkeypatch):
    monkeypatch.setattr(pieces, "CHARS", 500)
    texts = [None, *ODD, "same text"] + ["same text"] * 5 + ["w" * 5000 + " x " * 4000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    encoded = pieces.encode(df.withColumnRenamed("ids", "own"), "text", ["doc_id", "own"], queries.PIECES)
    rows = {r.doc_id: r for r in encoded.collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        r = rows[i]
        assert r.n_pieces == len(r.ids) and pieces.decode_ids(vocab, r.ids) == (text or "")
        assert r.score == sum(vocab.scores[k] if k in set(vocab.ids.values()) else 0 for k in r.ids) or any(vocab.raw[k] and k in vocab.bytes.values() for k in r.ids)
        assert all(a.score <= r.score for a in r.alternatives)
    back = pieces.decode(encoded, "ids", ["doc_id"], queries.PIECES)
    assert {r.doc_id: r.decoded for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert pieces.encode(df.limit(0), "text", ["doc_id"], queries.PIECES).count() == 0


def test_query_round_trip(spark):
    rows = queries.op5_pieces(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(r.round_trip for r in rows)
    assert all(len(r.next_scores) == 2 and r.score >= r.next_scores[0] >= r.next_scores[1] for r in rows if r.n_pieces > 20)
