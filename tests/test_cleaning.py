import pytest
from pyspark.sql import functions as F

from shelfgrade.operators import cleaning as step
from shelfgrade.operators.dedup import first_per_key, merge_old_wins
from shelfgrade.plans import profiles
from shelfgrade.staging import stage

RAW = "at int, code string, product_name string, brands string, nutriscore_grade string, sugars_100g string, salt_100g string, additives_n string"


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        (1, "k1", "Un", " acme ", "x", "1", "0", "1"),  # first of its code, invalid grade
        (2, "k1", "Un bis", "acme", "a", "2", "0", "2"),
        (3, None, "Null 1", None, " B ", "abc", "0", "x"),
        (4, None, "Null 2", "o'neil", "b", "4", "0", "3.7"),
        (5, "k2", None, "b", "c", "5", "0", "1"),
        (6, "k3", "Trois", "b", "e", "NaN", "0", None),
        (7, "k4", "Quatre", "b", "d", "-7", "0", "2"),
    ]
    return spark.createDataFrame(rows, RAW)


def table(df, *columns):
    return [tuple(r) for r in df.orderBy("at").select("at", *columns).collect()]


FEATURES = ("sugars_100g", "salt_100g", "additives_n")


def test_strict_takes_the_first_row_before_validity(raw):
    done = profiles.clean_strict(raw, ["at"], features=FEATURES)
    # No row of grade b or e has a sugar value, so both take the median of the filled column.
    assert table(done.frame, "nutriscore_grade", "brands", "nutriscore_label", "sugars_100g") == [
        (3, "b", "Inconnu", 1, -7.0), (6, "e", "B", 4, -7.0), (7, "d", "B", 3, -7.0),
    ]
    assert [r[0] for r in table(done.frame)] == [3, 6, 7]
    assert (done.rows_read, done.rows_kept, done.rows_removed) == (7, 3, 4)
    assert done.frame.where("categories_en <> 'Uncategorized'").count() == 0


def test_batch_filters_first_and_keeps_grades_as_written(raw):
    done = profiles.clean_batch(raw, ["at"], features=FEATURES[:2])
    assert [r[0] for r in table(done.frame)] == [2, 4, 6, 7]
    assert "categories_en" not in done.frame.columns
    assert table(done.frame, "additives_n", "brands")[1] == (4, 3, "o'neil")


def test_basic_keeps_fractions_of_counts(raw):
    done = profiles.clean_basic(raw, ["at"], features=FEATURES)
    assert [r[0] for r in table(done.frame)] == [6, 7]
    assert dict(done.frame.dtypes)["additives_n"] == "double"


def test_region_filters_then_fills_then_deduplicates(spark):
    rows = [
        (1, "n", "b", "A", "France", "1"),
        (2, "n", "b", "a", "en:france,Spain", None),
        (3, "m", "b", "a", "Spain", "9"),
        (4, "m", None, "e", "BELGIUM", None),
        (5, "o", "b", "unknown", "Canada", "3"),
        (6, "p", "b", "b", None, "3"),
        (7, "q", "b", " c ", "Canada", "3"),
    ]
    df = spark.createDataFrame(rows, "at int, product_name string, brands string, nutriscore_grade string, countries_en string, sugars_100g string")
    out = profiles.clean_region(df, ["at"], features=["sugars_100g"])
    assert table(out, "nutriscore_grade", "sugars_100g", "nutriscore_label") == [(1, "a", 1.0, 0), (4, "e", 1.0, 4)]
    capped = profiles.clean_region(df, ["at"], features=["sugars_100g"], max_rows=2)
    assert [r[0] for r in table(capped)] == [1]


def test_empty_input_is_refused(spark):
    with pytest.raises(ValueError):
        profiles.clean_strict(spark.createDataFrame([], RAW), ["at"])


def test_group_then_global_median(spark):
    rows = [("a", 1.0, None), ("a", 3.0, None), ("a", None, None), ("e", None, None), ("b", 9.0, None), (None, None, None)]
    data = stage(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "at int, g string, v double, w double"))
    out = step.fill_group_median(data, "g", ["v", "w"])
    # Group medians 2 and 9; the filled column is 1, 3, 2, 9 with median 2.5.
    assert [r["v"] for r in out.orderBy("at").collect()] == [1.0, 3.0, 2.0, 2.5, 9.0, 2.5]
    assert out.where("w IS NOT NULL").count() == 0


def test_clip_bounds(spark):
    rows = [(0.0, None, -5.0)] * 199 + [(7.0, None, 1.0)]
    data = stage(spark.createDataFrame(rows, "zeros double, nothing double, below double"))
    bounds = step.clip_bounds(data, ["zeros", "nothing", "below"])
    assert bounds == {"zeros": 0.0, "nothing": None, "below": -5.0}
    out = step.clip_outliers(data.frame, bounds)
    assert out.agg(F.max("zeros"), F.max("nothing"), F.min("below"), F.max("below")).first() == (0.0, None, -5.0, 0.0)
    plain = step.clip_outliers(data.frame, bounds, swap=False)
    assert plain.agg(F.min("below"), F.max("below")).first() == (0.0, 0.0)


def test_dedup_treats_null_keys_as_equal(raw):
    assert [r[0] for r in table(first_per_key(raw, ["code"], ["at"]))] == [1, 3, 5, 6, 7]
    assert first_per_key(raw, ["no_such_column"], ["at"]).count() == 7


def test_dedup_limits_rows_before_the_shuffle(raw):
    plan = first_per_key(raw, ["code"], ["at"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_merge_prefers_old(spark):
    old = spark.createDataFrame([(9, "n", "b", 1)], "at int, product_name string, brands string, only_old int")
    new = spark.createDataFrame([(1, "n", "b"), (2, "n", None)], "at int, product_name string, brands string")
    out = merge_old_wins(old, new, ["product_name", "brands"], ["at"])
    assert table(out, "only_old") == [(2, None), (9, 1)]


def test_cleaned_rows_stay_as_they_are(raw):
    once = profiles.clean_strict(raw, ["at"], features=FEATURES).frame
    again = step.add_label(step.default_texts(step.parse_counts(once)))
    assert table(again, "brands", "additives_n", "nutriscore_label") == table(once, "brands", "additives_n", "nutriscore_label")


def test_numbers_are_parsed_before_the_rows_are_shuffled(spark):
    raw = spark.createDataFrame([("1", "n", "a", "10", "5"), ("1", "m", "a", "9", "x")], "code string, product_name string, nutriscore_grade string, at string, energy_100g string")
    early = dict(profiles._numbers_first(raw, ["energy_100g", "at"], "code", ["at"]).dtypes)
    assert early["energy_100g"] == "double" and early["at"] == "string"  # the order stays that of texts
    assert profiles._numbers_first(raw, ["energy_100g"], "ean", ["at"]) is raw
    done = profiles.clean_strict(raw, ["at"], features=["energy_100g"])
    assert [(r["product_name"], r["energy_100g"]) for r in done.data.frame.collect()] == [("n", 5.0)]
