"""Stored gram index: the rows of a scan, from a small part of the files."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfgrade.functions.text import contains
from shelfgrade.sources import gram_index
from shelfgrade.sources.gram_index import candidates, find_containing, postings_of, write_gram_index
from shelfgrade.sources.keyed import rows_scanned

WORDS = ["Crème", "brûlée", "100%", "a_b", "Ring", "STRASSE", "straße", "x", "été", "😀b"]
TERMS = ["ring", "RING", "%", "_", "é", "a_b", "100% ", "xq", "x", "strasse", "straße", "😀", "😀b", "crème brûlée", "no such text", "w1234 ", "w1234", "end.", ".", "\n", "ab\nc"]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    words = F.array(*[F.lit(w) for w in WORDS])
    one = words[(F.hash("id") % 5 + 4).cast("int")]
    text = F.concat(one, F.lit(" "), F.when(F.col("id") % 50 == 0, F.lit("crème brûlée")).otherwise(F.lit("plain")), F.concat(F.lit(" w"), "id"), F.lit(" end."))
    text = F.when(F.col("id") == 7, None).when(F.col("id") == 8, "").when(F.col("id") == 9, "ab\nc").when(F.col("id") == 10, "x").when(F.col("id") == 11, "xQ").otherwise(text)
    df = spark.range(0, 8000, 1, 5).select("id", text.alias("a.b"), F.reverse(text).alias("other"), F.lit(1).alias("_row"))
    path = str(tmp_path_factory.mktemp("grams") / "t")
    write_gram_index(df, path, ["a.b", "other"], rows_per_group=200, block=256, files=3)
    return df, path


@pytest.mark.parametrize("term", TERMS)
def test_rows_are_those_of_a_scan(spark, rows, term):
    df, path = rows
    want = {r["id"] for r in df.where(contains("a.b", term)).collect()}
    found = find_containing(spark, path, {"a.b": term})
    assert found.columns == df.columns
    got = [r["id"] for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_several_columns(spark, rows):
    df, path = rows
    both = {"a.b": "ring", "other": "éeL"}
    want = df.where(contains("a.b", "ring") & contains("other", "éel")).count()
    assert find_containing(spark, path, both).count() == want
    either = {"a.b": "w77 ", "other": "87w"}
    want = df.where(F.coalesce(contains("a.b", "w77 "), F.lit(False)) | F.coalesce(contains("other", "87w"), F.lit(False))).count()
    assert find_containing(spark, path, either, any_of=True).count() == want > 1
    assert find_containing(spark, path, {"a.b": ""}).count() == find_containing(spark, path, {}).count() == 8000
    with pytest.raises(ValueError):
        find_containing(spark, path, {"none": "x"}).count()


def test_rare_terms_read_little(spark, rows):
    _, path = rows
    lists = spark.read.parquet(f"{path}/grams-1")
    assert rows_scanned(find_containing(spark, path, {"a.b": "w1234 "})) <= 400
    assert rows_scanned(postings_of(spark, path, "a.b", "xq ")) < lists.count() / 3
    assert candidates(spark, path, "a.b", "end.") is None
    assert candidates(spark, path, "a.b", "w1234 ").count() < 60


def test_lists_are_short_and_sorted(spark, rows):
    _, path = rows
    lists = spark.read.parquet(f"{path}/grams-1")
    assert lists.where("n > 256 OR rows <> array_sort(rows) OR n <> size(array_distinct(rows))").isEmpty()
    assert lists.where("n > 200").count() > 5


def test_many_candidates_are_joined(spark, rows, monkeypatch):
    df, path = rows
    monkeypatch.setattr("shelfgrade.sources.gram_index.LISTED", 10)
    assert find_containing(spark, path, {"a.b": "crème brûlée"}).count() == df.where(contains("a.b", "crème brûlée")).count() > 100


def test_empty_table(spark, rows, tmp_path):
    df, _ = rows
    write_gram_index(df.where("id < 0"), f"{tmp_path}/e", ["other"])
    assert find_containing(spark, f"{tmp_path}/e", {"other": "ring"}).count() == 0


def test_postings_are_written_without_a_shuffle(spark, rows, tmp_path, monkeypatch):
    plans, write = [], gram_index.write_sorted

    def seen(df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(df, *more)

    monkeypatch.setattr(gram_index, "write_sorted", seen)
    write_gram_index(rows[0].limit(500), f"{tmp_path}/t", ["a.b", "other"], block=64)
    assert len(plans) == 2 and not any("Exchange" in p for p in plans)


def grams_by_hand(texts):
    out = {}
    for row, text in texts.items():
        for i in range(len(text)):
            out.setdefault(text[i : i + 3], set()).add(row)
    return out


@pytest.mark.parametrize("held", [1, 60, 1 << 21])
def test_lists_of_batches_that_go_back(held, monkeypatch):
    # A later part of a file first, a batch that ends inside a block, another file, and one long text.
    monkeypatch.setattr(gram_index, "HELD", held)
    order = [*range(70, 90), *range(40, 70), *range(1 << 33, (1 << 33) + 5), 3, 2]
    texts = {r: f"é{r % 7}😀 ab" * (30 if r == 75 else 1) for r in order}
    batches = [pa.RecordBatch.from_pydict({"row": pa.array(part, pa.int64()), "text": [texts[r] for r in part]}) for part in (order[:13], order[13:35], [], order[35:])]
    got, seen = {}, set()
    for b in gram_index._lists(32)(batches):
        for p in b.to_pylist():
            assert p["rows"] == sorted(set(p["rows"])) and p["n"] == len(p["rows"]) and 0 <= p["rows"][0] <= p["rows"][-1] < 32
            assert (p["gram"], p["block"]) not in seen
            seen.add((p["gram"], p["block"]))
            got.setdefault(p["gram"], set()).update(p["block"] + r for r in p["rows"])
    assert got == grams_by_hand(texts)


def test_more_characters_than_numbers_hold(monkeypatch):
    texts = ["".join(map(chr, range(0x4E00 + 3000 * i, 0x4E00 + 3000 * (i + 1)))) for i in range(6)] * 3000
    import numpy as np

    short = [t[i % 2900 : i % 2900 + 4] for i, t in enumerate(texts)] + ["".join(map(chr, range(0x20000, 0x2A000)))]
    lists = list(gram_index._postings_from(np.arange(len(short)), short))
    got = {}
    for b in lists:
        for p in b.to_pylist():
            got.setdefault(p["gram"], set()).update(p["block"] + r for r in p["rows"])
    assert got == grams_by_hand(dict(enumerate(short)))
