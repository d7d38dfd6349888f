"""Rank-order profiles against a plain version, and accuracy on rows that were not learned."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfgrade.llm import langid, queries

FOLDER = "/root/testdata/sf0.01"


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        out.update(w)
        padded = f" {w} "
        out.update((padded[i : i + 2]) for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    if not words:
        return out
    # Between two words one blank, so a run of two holds it once at each side; the same as padding.
    return out


def number(gram):
    n = 0
    for c in gram:
        n = n << 21 | ord(c)
    return n


@pytest.mark.parametrize("text", ["", "12 !", "a", "Über  die Brücke-geht  2 Ärzte", "don't", "日本語 text", "x\ud800y", "😀 ok"])
def test_grams(text):
    values, counts = langid.grams(text, langid.letter_table())
    clean = text.encode("utf-32-le", "replace").decode("utf-32-le")
    assert dict(zip(values.tolist(), counts.tolist())) == {number(g): n for g, n in plain_grams(clean).items()}


def distance(own, profile, size):
    place = {g: i for i, g in enumerate(profile)}
    return sum(min(size, abs(place[g] - i)) if g in place else size for i, g in enumerate(own))


def test_nearest_against_plain_distance():
    profiles = {"b": [1, 2, 3, 4], "a": [4, 3, 2, 1], "c": []}
    known = langid.Profiles(profiles, 4)
    import numpy as np

    for own in ([1, 2, 3], [4], [9, 8], [3, 4, 1], [2]):
        want = min(sorted(profiles), key=lambda k: distance(own, profiles[k], 4))
        name, score = known.nearest(np.array(own))
        assert name == want and score == pytest.approx(1 - distance(own, profiles[want], 4) / (4 * len(own)))


def test_learn_and_predict(spark):
    texts = {"en": "the quick brown fox jumps over the lazy dog and then the other one", "de": "der schnelle braune fuchs springt über den faulen hund und dann noch einer"}
    rows = [(i, texts[lang][i % 7 :], lang, 0.1) for i in range(60) for lang in texts] + [(900, "the the", None, 0.1), (901, None, "en", 0.1), (902, "", "xx", 0.1), (903, "...", "de", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    profiles = langid.learn(df, "doc_id", "text", "lang", per_language=1000)
    total = Counter()
    for i, text, lang, _ in rows:
        if lang == "en":
            total.update(number(g) for g in plain_grams(text or "").elements())
    assert profiles["en"] == [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))][: langid.SIZE]
    asked = spark.createDataFrame([(1, "the dog over there"), (2, "über den hund"), (3, None), (4, " 12 "), (5, "dog " * 40000)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(asked, "text", profiles, ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["en", "de", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.predict(asked, "text", langid.learn(df.limit(0), "doc_id", "text", "lang"), ["doc_id"]).collect()} == {"und"}


def test_held_out_accuracy(spark):
    got = queries.op6_language(spark, FOLDER)
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got.count() == truth.count() and held > 0.95
