import os

import pytest
from pyspark.sql import functions as F

from shelfgrade.operators import messages
from shelfgrade.operators.substitutes import find_substitutes
from shelfgrade.plans import profiles
from shelfgrade.staging import scope, scratch_root, stage

PRODUCTS = "code string, product_name string, brands string, categories_en string, nutriscore_grade string, energy_100g double"
ROWS = [(str(i), f"name{i % 7} part", "Brand", ["Snacks, x", "Snacks", None][i % 3], "abcde"[i % 5], float(i)) for i in range(60)]


@pytest.fixture
def folders(spark):
    root = scratch_root(spark).removeprefix("file:")
    os.makedirs(root, exist_ok=True)
    return lambda: set(os.listdir(root))


def test_scope_drops_all_but_what_is_kept(spark, folders):
    before = folders()
    with scope(spark):
        with scope(spark) as keep:
            stage(spark.range(3))
            kept = keep(stage(spark.range(5)))
        assert kept.count() == 5 and len(folders() - before) == 1
    assert folders() == before
    with pytest.raises(ZeroDivisionError), scope(spark) as keep:
        keep(stage(spark.range(3)))
        1 / 0
    assert folders() == before


def test_operators_leave_only_what_their_result_reads(spark, folders):
    products = spark.createDataFrame(ROWS, PRODUCTS)
    before = folders()
    with scope(spark):
        assert find_substitutes(products, ["code"]).count()
        # The product table and the lists.
        assert len(folders() - before) == 2
        done = profiles.clean_strict(products.withColumn("energy_100g", F.col("energy_100g").cast("string")), ["code"], features=["energy_100g"])
        assert done.frame.count() == done.rows_kept == 60
    assert folders() == before


def test_keyword_match_shuffles_no_searched_text(spark):
    products = spark.createDataFrame([(i, f"Doc {i}", "b", "a", "word" * 5 + f" token{i % 9}") for i in range(50)], "doc_id int, product_name string, brands string, nutriscore_grade string, body string")
    asked = spark.createDataFrame([(1, "token3 please"), (2, "word")], "conv_id int, message string")
    shown = ("product_name", "nutriscore_grade")
    words = asked.select("conv_id", F.explode(F.split("message", " ")).alias("word"))
    hits = messages.keyword_hits(words, products, ["doc_id"], brand="body", shown=shown)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "body" not in plan
    assert {r["word"] for r in hits.collect()} == {"token3", "word"}
