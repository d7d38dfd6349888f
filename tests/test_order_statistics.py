import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from shelfgrade.operators import order_statistics, sampling
from shelfgrade.operators.order_statistics import exact_quantiles, staged_columns
from shelfgrade.staging import scope

PROBS = [0.0, 0.25, 0.5, 0.99, 1.0]


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    n = 6000
    hot = np.where(rng.random(n) < 0.4, 2.5, np.round(rng.lognormal(1, 2, n), 4))
    sparse = np.where(rng.random(n) < 0.3, np.nan, rng.normal(0, 1, n))
    group = np.where(rng.random(n) < 0.6, "big", np.where(rng.random(n) < 0.5, "mid", "low")).astype(object)
    group[:40] = None
    return hot, sparse, group


@pytest.fixture(scope="module")
def data(spark, skewed):
    rows = [(g, float(h), float(s)) for h, s, g in zip(*skewed)]
    return staged_columns(spark.createDataFrame(rows, "g string, hot double, sparse double"), ["hot", "sparse"], ["g"])


def test_global_quantiles(data, skewed):
    got = exact_quantiles(data, ["hot", "sparse"], PROBS).first()
    assert np.allclose(got["hot"], np.quantile(skewed[0], PROBS))
    assert np.allclose(got["sparse"], np.nanquantile(skewed[1], PROBS))


def test_group_quantiles(data, skewed):
    got = {r["g"]: r for r in exact_quantiles(data, ["hot", "sparse"], PROBS, ["g"]).collect()}
    assert set(got) == {"big", "mid", "low", None}
    hot, sparse, group = skewed
    for g, row in got.items():
        mask = np.array([x == g for x in group])
        assert np.allclose(row["hot"], np.quantile(hot[mask], PROBS))
        assert np.allclose(row["sparse"], np.nanquantile(sparse[mask], PROBS))


def test_column_without_values(spark):
    empty = staged_columns(spark.createDataFrame([("a", None, 1.0), ("a", None, 2.0)], "g string, v double, w double"), ["v", "w"], ["g"])
    row = exact_quantiles(empty, ["v", "w"], [0.5], ["g"]).first()
    assert row["v"] is None and row["w"] == [1.5]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(5000).select(
        F.col("id").cast("string").alias("key"), (F.col("id") / 3).cast("int").alias("lead"), "id",
        F.when(F.col("id") < 3000, "hot").when(F.col("id") < 3003, "tiny").otherwise("other").alias("label"),
    )
    return df


def test_split_takes_the_first_of_each_class(rows):
    split = sampling.stratified_split(rows, "label", "key")
    assert split.columns == [*rows.columns, "is_test"]
    place, digest = sampling.shuffled("key", sampling.SPLIT_SEED)
    of_class = Window.partitionBy("label").orderBy(place, digest, "key")
    want = rows.withColumn("rank", F.row_number().over(of_class)).where("rank <= CASE label WHEN 'hot' THEN 600 WHEN 'tiny' THEN 1 ELSE 399 END")
    assert sorted(r.key for r in split.where("is_test").collect()) == sorted(r.key for r in want.collect())
    shares = {r["label"]: r["n"] for r in split.where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert shares == {"hot": 600, "other": 399, "tiny": 1}


def test_sample_is_exact_and_repeatable(rows):
    many = rows.crossJoin(rows.sparkSession.range(4).select(F.col("id").alias("copy"))).withColumn("key", F.concat("key", F.lit("-"), "copy"))
    a = sampling.sample_rows(many, 12_000, "key")
    b = sampling.sample_rows(many, 12_000, "key")
    assert a.count() == 12_000
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert sampling.sample_rows(rows, 12_000, "key").count() == 5000
    first = sampling.first_rows(many, 11_000, ["lead", "key"])
    assert first.count() == 11_000
    assert first.exceptAll(many.orderBy("lead", "key").limit(11_000)).isEmpty()


def test_plain_split_share(rows):
    n = sampling.plain_split(rows, "key").where("is_test").count()
    assert 850 < n < 1150


@pytest.mark.parametrize("changed", ["named_struct('lo', t.hi, 'hi', t.hi)", "named_struct('lo', t.lo, 'hi', t.lo)", "named_struct('lo', -2D, 'hi', -1D)"])
def test_an_interval_that_misses_its_rank_is_an_error(spark, monkeypatch, changed):
    real = order_statistics._intervals
    fields = "'_slot', t._slot, '_measure', t._measure, 'target', t.target, 'n', t.n, 'position', t.position"
    moved = changed.replace("named_struct(", f"named_struct({fields}, ")
    monkeypatch.setattr(order_statistics, "_intervals", lambda *a: real(*a).withColumn("_targets", F.expr(f"transform(_targets, t -> {moved})")))
    with scope(spark):
        data = order_statistics.staged_columns(spark.range(5000).withColumn("v", F.col("id") * 1.0), ["v"])
        with pytest.raises(Exception, match="does not hold position"):
            order_statistics.exact_quantiles(data, ["v"], [0.37])
