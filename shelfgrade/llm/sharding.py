"""Shards under a byte limit by extendible hashing.

A row's address is 60 bits of its key's hash, then 60 bits of a hash of its place in the staged table.
The directory starts with one bucket; a bucket over the limit splits on the next bit, until each bucket
fits or holds one row. Rows of one hot key share their first 60 bits and are split by the others, so
that a key with a third of all rows costs some more bits and no over-full shard.

The splits are not made one by one over the data: byte sums of fine cells are taken in one aggregate
(``slack`` bits finer than the limit needs), and the sums of all coarser prefixes come from the cells.
Only cells that are still too large are read again, ``step`` bits deeper. The directory maps each cell to
its bucket, and rows find their shard by joining it.

Defined results: a missing text has no bytes; a missing key counts as the empty text; a single row over
the limit has a shard of its own; repeated rows are rows like all others; an empty table has no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from shelfgrade.staging import release, stage

from .text import bit_text, hex_bits

KEY_BITS = 60
BITS = 120


def _prefix(depth: int) -> Column:
    """The first ``depth`` bits of the address as text."""
    if depth <= KEY_BITS:
        return bit_text(F.shiftright("_key", KEY_BITS - depth), F.lit(depth))
    return F.concat(
        bit_text(F.col("_key"), F.lit(KEY_BITS)), bit_text(F.shiftright("_place", BITS - depth), F.lit(depth - KEY_BITS))
    )


def _cut(text: str, n: Column) -> Column:
    return F.substring(F.col(text), F.lit(1), n)


def _split(cells: DataFrame, top: int, depth: int, limit: int):
    """Buckets of the tree between two depths: all nodes, and those where splitting ends."""
    nodes = (
        cells.select(F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("d"), "cell", "bytes", "rows")
        .groupBy(_cut("cell", F.col("d")).alias("shard"), F.col("d").alias("depth"))
        .agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
    )
    large = (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    split = nodes.where(large).select(F.col("shard").alias("parent"), (F.col("depth") + 1).alias("depth"))
    ends = nodes.where(~large).withColumn("parent", _cut("shard", F.col("depth") - 1))
    below = ends.where(F.col("depth") > top).join(split, ["parent", "depth"], "left_semi").select(nodes.columns)
    return nodes, large, ends.where(F.col("depth") == top).select(nodes.columns).unionByName(below)


def assign_shards(df: DataFrame, key: str, size: Column, limit: int, keep=(), slack: int = 2, step: int = 8) -> DataFrame:
    """``keep`` columns, n_bytes, shard (its bits), depth, shard_bytes and shard_rows of every row."""
    spark = df.sparkSession
    numbered = stage(
        df.select(*keep, F.coalesce(size, F.lit(0)).cast("long").alias("n_bytes"), hex_bits(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("_key"), F.monotonically_increasing_id().alias("_id")),
        "rows",
    ).frame
    rows = numbered.withColumn("_place", hex_bits(F.md5(F.col("_id").cast("string")))).drop("_id")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    top, depth = 0, min(KEY_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + slack)
    open_rows, depths, directories, scratch = rows, [], [], []
    while True:
        cells = stage(
            open_rows.groupBy(_prefix(depth).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows")), "cells"
        )
        nodes, large, ends = _split(cells.frame, top, depth, limit)
        if depth == BITS:
            ends = ends.unionByName(nodes.where(large & (F.col("depth") == depth)))
        known = stage(ends, "buckets")
        scratch += [cells.path, known.path]
        pointers = cells.frame.select("cell", F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("depth")).withColumn(
            "shard", _cut("cell", F.col("depth"))
        )
        directories.append(pointers.join(known.frame, ["shard", "depth"]).select("cell", "shard", "depth", "shard_bytes", "shard_rows"))
        depths.append(depth)
        left = stage(nodes.where(large & (F.col("depth") == depth)).select(F.col("shard").alias("_open")), "open")
        scratch.append(left.path)
        if depth == BITS or not left.rows:
            break
        open_rows = rows.join(left.frame, _prefix(depth) == F.col("_open"), "left_semi")
        top, depth = depth + 1, min(BITS, depth + step)
    directory = directories[0]
    for more in directories[1:]:
        directory = directory.unionByName(more)
    directory = stage(directory, "directory").frame
    for path in scratch:
        release(spark, path)
    found = rows.withColumn("cell", F.explode(F.array(*[_prefix(d) for d in depths])))
    return found.join(directory, "cell").select(*keep, "n_bytes", "shard", "depth", "shard_bytes", "shard_rows")


def write_shards(assigned: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder per shard; each shard is written by one task, as its size is bounded."""
    spark = assigned.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = assigned.withColumn("part", F.concat(F.lit("b"), shard)).drop(shard)
    named.repartition(tasks, "part").write.partitionBy("part").parquet(path)
