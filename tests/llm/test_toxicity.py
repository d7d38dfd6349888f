"""The convolutional classifier: folding, pooling over whole texts, learning and thresholds."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfgrade.llm import text as text_module
from shelfgrade.llm import toxicity

BAD = ["vile", "scummy", "wretch"]


def text(rnd, label, lang):
    words = [rnd.choice("abcdefgh") + rnd.choice("aeiou") + rnd.choice("lmnrst") + rnd.choice(["", "a", "en"]) for _ in range(rnd.choice([1, 8, 60, 200]))]
    if label:
        words.insert(rnd.randrange(len(words) + 1), rnd.choice(BAD) + ("" if lang == "en" else rnd.choice(["o", "e", "u"])))
    return " ".join(words)


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.random() < 0.25, rnd.choice(["en", "fr"])) for i in range(900)]
    docs = [(i, text(rnd, y, lang), lang, 0.5) for i, y, lang in rows]
    docs += [(900, None, "en", 0.0), (901, "", None, 0.0), (902, "fine " * 30000 + "scummy", "xx", 0.0), (902, "fine " * 30000 + "scummy", "xx", 0.0), (None, "vile", "en", 0.0)]
    labels = [(i, 0, int(y)) for i, y, _ in rows if i < 600] + [(5, 0, None), (None, 0, 1), (0, 0, int(rows[0][1]))]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, score double").repartition(4),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        {i: int(y) for i, y, _ in rows},
    )


def test_words_are_those_of_the_ranges_and_looked_up(spark):
    # Every character but surrogates, alone between letters and beside others.
    codes = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343")
    chars = codes.repartition(8).select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    lined = chars.select(F.concat(F.lit("aZ"), "c", F.lit("9 "), "c", "c").alias("text")).unionByName(spark.createDataFrame([(None,), ("",), ("A-b_c",)], "text string"))
    plain = F.regexp_extract_all(text_module.ascii_lower(F.coalesce("text", F.lit(""))), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    assert lined.where(~plain.eqNullSafe(text_module.words(F.col("text")))).isEmpty()
    # The class lists its ASCII characters one by one: one range is left.
    assert text_module.WORD.count("-") == 1


def test_learns_and_scores_whole_texts(tables, monkeypatch):
    monkeypatch.setattr(toxicity, "PART", 1000)
    docs, labels, truth = tables
    model = toxicity.train(docs, labels, "doc_id", "text", "lang", "toxic")
    got = toxicity.score(docs.drop("score"), model, "text", "lang", ["doc_id"]).collect()
    assert len(got) == docs.count()
    right = [r.predicted == truth[r.doc_id] for r in got if r.doc_id is not None and 600 <= r.doc_id < 900]
    assert np.mean(right) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[902].predicted == 1 and by[None].predicted == 1  # the last of 30,001 words; no key
    assert by[900].score == by[901].score < 0.3
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    # The same rows in another order fit the same model.
    assert toxicity.train(docs.orderBy(F.desc("doc_id")), labels, "doc_id", "text", "lang", "toxic") == model


def test_fits_one_row_a_key(tables, monkeypatch):
    docs, labels, _ = tables

    def count(batches):
        keys = [k for b in batches for k in b.column("order").to_pylist()]
        yield pa.RecordBatch.from_pydict({"model": [f"{len(keys)} {len(set(keys))}".encode()]})

    more = docs.where("doc_id = 5").crossJoin(docs.sparkSession.range(400)).selectExpr("doc_id", "concat(text, ' ', id) AS text", "lang", "score")
    repeated = docs.unionByName(more)
    model = toxicity.train(repeated, labels, "doc_id", "text", "lang", "toxic")
    assert toxicity.train(repeated.orderBy(F.desc("text")), labels, "doc_id", "text", "lang", "toxic") == model
    monkeypatch.setattr(toxicity, "_train", count)
    assert toxicity.train(repeated, labels, "doc_id", "text", "lang", "toxic") == b"600 600"


def test_scores_without_labels(tables):
    docs, labels, _ = tables
    model = toxicity.train(docs, labels.limit(0), "doc_id", "text", "lang", "toxic")
    assert {r.predicted for r in toxicity.score(docs, model, "text", "lang", ["doc_id"]).collect()} == {0}
    assert toxicity.score(docs.limit(0), model, "text", "lang", ["doc_id"]).count() == 0


def test_scores_equal_convolution_by_hand(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 2**48, n) for n in (0, 1, 2, 3, 50, 0, 7)]
    labels = np.array([0, 1, 0, 1, 0, 0, 1], np.float32)
    model = toxicity.fit(texts, labels, epochs=1, updates=1)
    monkeypatch.setattr(toxicity, "CHUNK", 5)
    got = toxicity.scores(toxicity.fold(model), np.concatenate(texts), np.array([len(t) for t in texts]))
    for t, score in zip(texts, got):
        words = [np.concatenate([model["table"][k][(h >> 16 * k) & 0xFFFF] for k in range(3)]) for h in t] + [np.zeros(24)] * 3
        peaks = []
        for w, width in enumerate(toxicity.WIDTHS):
            rows = [sum(x @ model["conv"][:, c] for x, c in zip(words[i : i + width], [c for v, _, c in toxicity._slices() if v == width])) for i in range(max(1, len(t)))]
            peaks.append(np.max(rows, axis=0) + model["bias"][w * 8 : w * 8 + 8])
        logit = np.maximum(np.concatenate(peaks), 0) @ model["out"] + model["base"]
        assert score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-5)


def test_threshold():
    scores, labels = np.array([0.9, 0.8, 0.6, 0.5, 0.2]), np.array([1, 1, 0, 1, 0])
    assert toxicity.best_threshold(scores, labels, cases=1) == pytest.approx(0.35)
    assert toxicity.best_threshold(scores, labels) == 0.3


def test_every_labelled_row_is_fitted(spark):
    """Each of many toxic words stands in few texts, so that a model of some of the rows misses words."""
    rnd = random.Random(3)
    vile = [f"{a}{b}zz{c}" for a in "bcdfg" for b in "aeiou" for c in "kq"]
    rows = [(i, text(rnd, 0, "en") + (f" {vile[i // 4 % len(vile)]}" if i % 4 == 0 else ""), "en") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, *_ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, "doc_id", "text", "lang", "toxic", 400)
    asked = spark.createDataFrame([(i, f"{text(rnd, 0, 'en')} {w}", "en") for i, w in enumerate(vile)], docs.schema)
    clean = spark.createDataFrame([(i, text(rnd, 0, "en"), "en") for i in range(50)], docs.schema)
    caught = toxicity.score(asked, model, "text", "lang", ["doc_id"]).agg(F.avg("predicted"), F.avg("flagged")).first()
    wrong = toxicity.score(clean, model, "text", "lang", ["doc_id"]).agg(F.avg("predicted"), F.avg("flagged")).first()
    assert min(caught) > 0.9 and max(wrong) < 0.1
    assert toxicity.train(docs.orderBy(F.desc("doc_id")), labels, "doc_id", "text", "lang", "toxic", 400) == model
