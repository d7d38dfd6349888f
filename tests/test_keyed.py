"""Tables written by key: look-ups read a small part of them."""

import pytest
from pyspark.sql import functions as F

from shelfgrade.sources.keyed import lookup_keys, rows_scanned, write_keyed

ROWS = 40_000


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    # Even keys, one of them for a quarter of all rows, and rows without a key; in no order.
    key = F.when(F.col("id") % 4 == 1, 888).when(F.col("id") % 997 == 0, None).otherwise(F.col("id") * 2)
    rows = spark.range(0, ROWS, 1, 7).select(key.cast("string").alias("code"), "id").orderBy(F.hash("id"))
    where = str(tmp_path_factory.mktemp("keyed") / "t")
    write_keyed(rows, where, "code", ["id"], rows_per_group=1000, files=8)
    return where


def test_present_and_absent_keys_read_little(spark, path):
    for value, want in (("1604", [802]), ("80000x", []), ("1605", []), ("", [])):
        found = lookup_keys(spark, path, "code", [value])
        assert [r["id"] for r in found.collect()] == want
        assert rows_scanned(lookup_keys(spark, path, "code", [value])) < ROWS / 20
    assert rows_scanned(spark.read.parquet(path).where("id >= 0")) == ROWS


def test_bloom_filters_rule_out_what_bounds_cannot(spark, path):
    # Keys that lie between those of a row group, and are absent.
    absent = [str(2 * i + 1) for i in range(600, 620)]
    assert sum(rows_scanned(lookup_keys(spark, path, "code", [v])) for v in absent) < ROWS / 20


def test_several_repeated_and_missing_keys(spark, path):
    got = lookup_keys(spark, path, "code", ["1604", None, "1604", "1608", "none"]).orderBy("id").collect()
    assert [r["id"] for r in got] == [802, 804]
    assert lookup_keys(spark, path, "code", []).count() == lookup_keys(spark, path, "code", [None]).count() == 0
    assert lookup_keys(spark, path, "code", ["888"]).count() == ROWS / 4 + 1
    with pytest.raises(ValueError):
        lookup_keys(spark, path, "code", list(map(str, range(1001))))


def test_all_rows_are_kept_also_without_a_key(spark, path, tmp_path):
    table = spark.read.parquet(path)
    assert table.count() == ROWS and table.where("code IS NULL").count() > 0
    empty = spark.createDataFrame([], "code string, id long")
    write_keyed(empty, f"{tmp_path}/e", "code")
    assert lookup_keys(spark, f"{tmp_path}/e", "code", ["1"], empty.schema).count() == 0


def test_a_look_up_opens_only_files_around_its_keys(spark, path):
    assert len(spark.read.parquet(path).inputFiles()) == 8
    assert len(lookup_keys(spark, path, "code", ["1604"]).inputFiles()) == 1
    # A number is compared as a number, which the ranges of strings do not tell: all files are read.
    assert [r["id"] for r in lookup_keys(spark, path, "code", [1604]).collect()] == [802]
