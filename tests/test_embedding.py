"""Dense text vectors against singular vectors of the whole matrix."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from shelfgrade.operators import embedding, learning
from shelfgrade.staging import scope, stage

TOPICS = ["milk sugar cocoa hazelnut palm", "tuna olive salt water tomato", "wheat yeast rye flour barley"]


def texts(n=90):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        words = TOPICS[i % 3].split()
        picked = list(rng.choice(words, 6)) + [f"w{rng.integers(40)}" for _ in range(2)]
        rows.append((i, " ".join(picked), i % 3))
    return [*rows, (n, None, 0), (n + 1, "", 0), (n + 2, "a . !", 0), (n + 3, "milk " * 60_000, 0), (n + 3, "milk " * 60_000, 0)]


@pytest.fixture(scope="module")
def corpus(spark):
    with scope(spark):
        yield stage(spark.createDataFrame(texts(), "id long, text string, label int").repartition(5), "corpus").frame


def matrix(spark, corpus, size):
    rows = corpus.select("id", embedding.word_buckets("text", size).alias("b")).orderBy("id").collect()
    n = sum(bool(r["b"]) for r in rows)
    occurs = np.bincount([b for r in rows for b in set(r["b"])], minlength=size)
    weights = [math.log((n + 1) / (o + 1)) + 1 if o else 0.0 for o in occurs]
    out = np.zeros((len(rows), size))
    for i, r in enumerate(rows):
        for b in set(r["b"]):
            out[i, b] = (1 + math.log(r["b"].count(b))) * weights[b]
        if r["b"]:
            out[i] /= math.sqrt(sum(out[i] ** 2))
    return out


def test_directions_are_those_of_the_whole_matrix(spark, corpus):
    whole = matrix(spark, corpus, 64)
    model = embedding.fit_directions(corpus, dims=5, size=64, passes=6, extra=10, tasks=3)
    assert np.allclose(model.directions.T @ model.directions, np.eye(5), atol=1e-9)
    _, values, right = np.linalg.svd(whole, full_matrices=False)
    assert model.share == pytest.approx((values[:5] ** 2).sum() / (values**2).sum(), abs=1e-3)
    # The first three directions span the same space.
    assert np.linalg.svd(right[:3] @ model.directions)[1].min() > 0.999


def test_a_pass_more_captures_no_less_and_random_directions_much_less(spark, corpus):
    shares = [embedding.fit_directions(corpus, dims=4, size=64, passes=p, extra=0).share for p in (1, 2, 4)]
    whole = matrix(spark, corpus, 64)
    chance = np.linalg.qr(np.random.default_rng(1).standard_normal((64, 4)))[0]
    assert shares[0] <= shares[1] + 1e-9 <= shares[2] + 2e-9
    assert shares[2] > 3 * ((whole @ chance) ** 2).sum() / (whole**2).sum()


def test_vectors_of_all_texts(spark, corpus):
    model = embedding.fit_directions(corpus, dims=8, size=64)
    got = embedding.embed_texts(corpus, model).orderBy("id").collect()
    assert len(got) == len(texts()) and {len(r["embedding"]) for r in got} == {8}
    projected = matrix(spark, corpus, 64) @ model.directions
    for row, want in zip(got, projected):
        length = np.linalg.norm(want)
        assert np.allclose(row["embedding"], want / length if length else want, atol=1e-5)
    assert [sum(map(abs, r["embedding"])) for r in got[90:93]] == [0, 0, 0]
    # Texts of a topic are nearer to each other than to the rest.
    v = np.array([r["embedding"] for r in got[:90]])
    near = v @ v.T
    same = np.equal.outer(np.arange(90) % 3, np.arange(90) % 3)
    assert near[same].mean() > 2 * near[~same].mean()


def test_full_width_by_default_and_a_saved_model(spark, corpus):
    model = embedding.fit_directions(corpus)
    assert model.directions.shape == (4096, 384)
    assert np.allclose(model.directions.T @ model.directions, np.eye(384), atol=1e-8)
    assert model.share == pytest.approx(1.0)  # fewer texts than directions
    with scope(spark):
        saved = stage(model.table(spark), "directions").frame
        again = embedding.TextDirections.from_table(saved)
    assert np.array_equal(again.directions, model.directions) and np.array_equal(again.weights, model.weights)


def test_empty_table_and_bad_parameters(spark):
    empty = spark.createDataFrame([], "id long, text string")
    model = embedding.fit_directions(empty, dims=3, size=16)
    assert model.share == 0.0 and np.allclose(model.directions.T @ model.directions, np.eye(3))
    assert embedding.embed_texts(empty, model).count() == 0
    unseen = spark.createDataFrame([(1, "never seen")], "id long, text string")
    assert embedding.embed_texts(unseen, model).first()["embedding"] == [0.0, 0.0, 0.0]
    for wrong in ({"dims": 0}, {"dims": 17, "size": 16}, {"passes": 0}):
        with pytest.raises(ValueError):
            embedding.fit_directions(empty, **{"dims": 3, "size": 16, **wrong})


def test_the_logistic_model_learns_from_the_vectors(spark, corpus):
    with scope(spark):
        known = corpus.where("id < 90")
        model = embedding.fit_directions(known, dims=8, size=256)
        rows = stage(embedding.embed_texts(known, model), "vectors").frame.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
        scored = learning.score_classes(learning.train_logistic(rows, "label"), rows, ["0", "1", "2"])
        assert scored.where("predicted = cast(label as string)").count() == 90


def test_texts_are_weighed_in_blocks_and_a_pass_multiplies_matrices(spark, corpus, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    weights = np.where(rng.random(32) < 0.2, 0.0, rng.random(32) + 1)
    lists = [None, [], [0] * 9, *[rng.integers(0, 32, rng.integers(1, 40)).tolist() for _ in range(30)]]
    monkeypatch.setattr(embedding, "BLOCK", 32 * 4)
    whole = np.zeros((len(lists), 32))
    done = 0
    for at, rows in embedding._unit_texts(pa.array(lists, pa.list_(pa.int32())).slice(0), weights):
        assert len(rows) <= 4
        whole[done : done + len(rows), at] = rows
        done += len(rows)
    assert done == len(lists)
    for got, words in zip(whole, lists):
        want = np.bincount(words or [], minlength=32).astype(float)
        want[want > 0] = 1 + np.log(want[want > 0])
        want *= weights
        assert np.allclose(got, want / (np.linalg.norm(want) or 1))


def test_words_found_beforehand_give_the_same_vectors(spark, corpus):
    with scope(spark):
        words = stage(corpus.select("id", embedding.word_buckets("text", 64).alias("found")), "words").frame
        one, two = embedding.fit_directions(corpus, dims=5, size=64), embedding.fit_directions(words, dims=5, size=64, buckets="found")
        assert np.allclose(one.weights, two.weights) and one.share == pytest.approx(two.share, abs=1e-4)
        got = embedding.embed_texts(words, one, buckets="found").orderBy("id").select("embedding").collect()
        want = embedding.embed_texts(corpus, one).orderBy("id").select("embedding").collect()
        assert np.allclose([r[0] for r in got], [r[0] for r in want], atol=1e-6)
