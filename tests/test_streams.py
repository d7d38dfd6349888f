"""Counted batches, figures of batches, and the upsert table in buckets."""

import json
import os

import pytest
from pyspark.sql import functions as F

from shelfgrade.streaming import buckets, counted, figures, sinks

SCHEMA = "id long, name string"


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def land(spark, folder, name, first, last, groups=None):
    rows = spark.range(first, last, 1, 1).select("id", F.concat(F.lit("n"), "id").alias("name"))
    writer = rows.write
    if groups:
        writer = writer.option("parquet.block.size", groups)
    writer.parquet(f"{folder}/in/{name}")


def take(spark, folder, size, schema=SCHEMA):
    stream = counted.counted_stream(spark, f"{folder}/in", schema, size)
    counted.drain(sinks.append_stream(stream, f"{folder}/out", f"{folder}/offsets", processingTime="0 seconds"))


def test_batches_have_the_counted_rows_and_go_on_after_a_restart(spark, folder):
    land(spark, folder, "1", 0, 7)
    land(spark, folder, "2", 7, 9)
    with figures.batch_figures(spark, f"{folder}/figures", held=2):
        take(spark, folder, 4)
        take(spark, folder, 4)  # nothing new
        land(spark, folder, "3", 9, 9)  # an empty file
        land(spark, folder, "4", 9, 20)
        take(spark, folder, 4)
    got = figures.read_figures(spark, f"{folder}/figures").orderBy("batch").collect()
    assert [(r["batch"], r["rows"]) for r in got] == [(0, 4), (1, 4), (2, 1), (3, 4), (4, 4), (5, 3)]
    rows = spark.read.schema(SCHEMA).parquet(f"{folder}/out").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(i, f"n{i}") for i in range(20)]
    one = figures.throughput(figures.read_figures(spark, f"{folder}/figures")).first()
    assert (one["batches"], one["rows"], one["smallest"], one["largest"]) == (6, 20, 1, 4) and one["rows_per_second"] > 0


def test_more_batches_than_a_query_remembers(spark, folder):
    land(spark, folder, "1", 0, 230)
    with figures.batch_figures(spark, f"{folder}/figures", held=50):
        take(spark, folder, 2)
    got = figures.throughput(figures.read_figures(spark, f"{folder}/figures")).first()
    assert (got["batches"], got["rows"]) == (115, 230)


def test_a_batch_that_failed_is_read_again_alike(spark, folder):
    land(spark, folder, "1", 0, 10)
    seen = []

    def run(fail):
        def sink(batch, batch_id):
            seen.append((batch_id, sorted(r["id"] for r in batch.collect())))
            if fail and batch_id == 1:
                raise RuntimeError("lost")

        stream = counted.counted_stream(spark, f"{folder}/in", SCHEMA, 4)
        counted.drain(stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/offsets").trigger(processingTime="0 seconds").start())

    with pytest.raises(Exception, match="lost"):
        run(True)
    land(spark, folder, "2", 10, 11)
    run(False)
    assert seen == [(0, [0, 1, 2, 3]), (1, [4, 5, 6, 7]), (1, [4, 5, 6, 7]), (2, [8, 9, 10])]


def test_slices_over_row_groups_missing_columns_and_types(spark, folder):
    os.makedirs(f"{folder}/in")
    import pyarrow as pa
    from pyarrow import parquet

    table = pa.table({"name": [f"n{i}" for i in range(25)], "id": pa.array(range(25), pa.int32()), "more": [None] * 25})
    parquet.write_table(table, f"{folder}/in/1.parquet", row_group_size=4)
    reader = counted.CountedReader(f"{folder}/in", spark.createDataFrame([], "id long, name string, absent double").schema, 10)
    batches = list(reader.read(counted.Slice("1.parquet", 6, 19)))
    assert pa.Table.from_batches(batches).to_pylist() == [{"id": i, "name": f"n{i}", "absent": None} for i in range(6, 19)]
    assert list(reader.read(counted.Slice("1.parquet", 5, 5))) == []
    end = reader.latestOffset()
    assert end == reader.latestOffset() == {"file": "1.parquet", "row": 10, "files": 1, "rows": 10}
    assert reader.partitions(reader.initialOffset(), end) == [counted.Slice("1.parquet", 0, 10)]
    assert reader.latestOffset()["row"] == 20


def test_a_file_under_an_earlier_name_is_an_error(spark, folder):
    land(spark, folder, "5", 0, 3)
    take(spark, folder, 2)
    land(spark, folder, "4", 3, 4)
    with pytest.raises(Exception, match="rising"):
        take(spark, folder, 2)


def test_nothing_landed_yet(spark, folder):
    os.makedirs(f"{folder}/in")
    take(spark, folder, 2)
    assert spark.read.schema(SCHEMA).parquet(f"{folder}/out").count() == 0
    with pytest.raises(ValueError):
        counted.counted_stream(spark, f"{folder}/in", SCHEMA, 0)


ROW = "code string, v int, at int"


def files(folder):
    return {f"{d}/{f}" for d, _, names in os.walk(f"{folder}/t") for f in names if f.endswith(".parquet")}


def merge(spark, folder, number, rows, writer="w", n=8):
    buckets.merge_batch(spark.createDataFrame(rows, ROW), number, f"{folder}/t", ["code"], ["at"], n, writer)
    return sorted(map(tuple, buckets.read_buckets(spark, f"{folder}/t", ROW).collect()), key=repr)


def test_buckets_keep_the_latest_row_and_touch_only_their_own(spark, folder):
    assert buckets.read_buckets(spark, f"{folder}/t", ROW).count() == 0
    many = [(f"c{i}", i, 1) for i in range(40)] + [(None, 0, 1), (None, 5, 2)]
    got = merge(spark, folder, 0, many)
    assert len(got) == 41 and (None, 5, 2) in got
    before, version = files(folder), buckets.current_version(spark, f"{folder}/t")
    assert len(version["folders"]) == 8
    got = merge(spark, folder, 1, [("c3", 9, 5), ("c3", 8, 4), ("new", 1, 1)], n=99)  # the table's own number of buckets holds
    assert len(got) == 42 and ("c3", 9, 5) in got and before <= files(folder)
    after = buckets.current_version(spark, f"{folder}/t")
    assert sum(after["folders"][b] != f for b, f in version["folders"].items()) <= 2
    # An older version of a row changes nothing; of equal versions the later batch counts.
    got = merge(spark, folder, 2, [("c3", 1, 4), ("c4", 77, 1)])
    assert ("c3", 9, 5) in got and ("c4", 77, 1) in got


def test_a_batch_that_comes_again_does_nothing_but_a_new_writer_counts_anew(spark, folder):
    merge(spark, folder, 0, [("a", 1, 1)])
    held = files(folder)
    assert merge(spark, folder, 0, [("a", 2, 2)]) == [("a", 1, 1)] and files(folder) == held
    assert merge(spark, folder, 0, [("a", 3, 3)], "other") == [("a", 3, 3)]
    assert merge(spark, folder, 1, [], "other") == [("a", 3, 3)]
    assert buckets.drop_old_versions(spark, f"{folder}/t") == 1
    assert merge(spark, folder, 2, [("b", 1, 1)], "other") == [("a", 3, 3), ("b", 1, 1)]


def test_rows_written_without_a_version_are_not_read(spark, folder, monkeypatch):
    merge(spark, folder, 0, [("a", 1, 1)])

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(buckets, "_publish", lost)
        with pytest.raises(RuntimeError):
            merge(spark, folder, 1, [("a", 2, 2)])
    assert buckets.read_buckets(spark, f"{folder}/t", ROW).collect()[0]["v"] == 1
    assert merge(spark, folder, 1, [("a", 2, 2)]) == [("a", 2, 2)]


def test_a_stream_into_buckets(spark, folder):
    os.makedirs(f"{folder}/in")

    def run(name, rows):
        with open(f"{folder}/in/{name}", "w") as f:
            f.writelines(json.dumps(dict(zip(("code", "v", "at"), r))) + "\n" for r in rows)
        stream = spark.readStream.schema(ROW).json(f"{folder}/in")
        buckets.upsert_buckets(stream, f"{folder}/t", f"{folder}/offsets", ["code"], ["at"], 4).awaitTermination()
        return sorted(map(tuple, buckets.read_buckets(spark, f"{folder}/t", ROW).collect()))

    assert run("1", [("a", 1, 1), ("b", 2, 5), ("a", 9, 3)]) == [("a", 9, 3), ("b", 2, 5)]
    assert run("2", [("b", 7, 4), ("c", 1, 1)]) == [("a", 9, 3), ("b", 2, 5), ("c", 1, 1)]
