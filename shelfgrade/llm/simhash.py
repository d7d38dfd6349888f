"""Near copies by SimHash fingerprints, compared bit plane by bit plane.

A document's fingerprint takes the majority of each bit over the XXH64 hashes (seed 42) of its word
shingles. Fingerprints within ``radius`` bits are linked; a group is what links reach.

Equal fingerprints are folded first. ``radius`` changed bits leave two of ``radius + 2`` bit blocks
untouched, so each linked pair shares the bits of some pair of blocks: fingerprints meet in buckets
keyed by two blocks, about 25 bits. Buckets over ``BLOCK`` fingerprints are cut into parts by a hash, and
every two parts meet in a task of their own; no bucket is gathered whole. A task stores its
fingerprints as vertical bit planes, adds up the differing bits of many pairs at once in carry-save
counters (two words per counter for radius 3), and drops queries and columns as soon as all their pairs
are beyond the radius. It returns a spanning forest of the links it finds, not the links, so that a group
of n near copies costs n rows.

Defined results: a missing or empty text has fingerprint 0 and is linked like any other; a text with
fewer words than a shingle is one shingle; repeated rows are members like others; ``component_id`` is the
smallest key of the group (missing keys are passed over); an empty table has no groups.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from shelfgrade.staging import release, stage

from .components import connected_components

BITS = 64
BLOCK = 2048
PACK = 1024  # fingerprints of small buckets that are compared together
_FULL = np.uint64(2**64 - 1)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()  # of bytes: A-Z, and white space of ASCII
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), grams), np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(df: DataFrame, text: str, keep, shingle: int = 3) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed number."""
    kept = df.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in batch.column("_text").to_pylist()), np.uint64, batch.num_rows)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fps.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    schema = kept.drop("_text").schema.add("fp", "long")
    return kept.mapInArrow(run, schema)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def forest(fps: np.ndarray, radius: int = 3, queries: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that connect what links of at most ``radius`` bits connect."""
    x = np.unique(fps)
    n = len(x)
    words = -(-n // 64)
    bits = (x[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    planes = np.zeros((BITS, words * 8), np.uint8)
    packed = np.packbits(bits.astype(np.uint8).T, axis=1, bitorder="little")
    planes[:, : packed.shape[1]] = packed
    planes = planes.view(np.uint64)
    flips = np.where(bits == 1, _FULL, np.uint64(0))  # (n, 64)
    size = radius.bit_length()
    label = np.arange(n)
    for first in range(0, n, queries):
        rows = np.arange(first, min(n, first + queries))
        # Pairs with an earlier or the same fingerprint, and places beyond the last, count as too far.
        later = np.zeros((len(rows), words * 64), np.uint8)
        places = np.arange(words * 64)
        later[(places[None, :] <= rows[:, None]) | (places[None, :] >= n)] = 1
        over = np.packbits(later, axis=1, bitorder="little").view(np.uint64)
        columns = np.arange(first // 64, words)
        over = over[:, columns]
        start = 2**size - 1 - radius
        counters = [np.full(over.shape, _FULL if start >> k & 1 else 0, np.uint64) for k in range(size)]
        for b in range(BITS):
            carry = planes[b][columns][None, :] ^ flips[rows, b][:, None]
            for k in range(size):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if b % 8 == 7:
                near = over != _FULL
                alive, wide = near.any(axis=1), near.any(axis=0)
                if not alive.any():
                    rows = rows[:0]
                    break
                if alive.mean() < 0.8 or wide.mean() < 0.8:
                    rows, columns = rows[alive], columns[wide]
                    over, counters = over[alive][:, wide], [c[alive][:, wide] for c in counters]
        for row, far in zip(rows, over[: len(rows)]):
            hits = np.flatnonzero(np.unpackbits((~far).view(np.uint8), bitorder="little"))
            if len(hits):
                joined = np.unique(np.append(label[columns[hits // 64] * 64 + hits % 64], label[row]))
                if len(joined) > 1:
                    label[np.isin(label, joined[1:])] = joined[0]
    moved = np.flatnonzero(label != np.arange(n))
    return x[moved], x[label[moved]]


def _forests(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def out(fps):
        a, b = forest(fps.view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    def run(batches):
        held = np.empty(0, np.int64)
        last = None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("bucket", "lo", "hi")])
            fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(fps):
                continue
            new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if last is None or (keys[:, 0] != last).any():
                new = np.concatenate([[0], new])
            # Whole buckets are gathered until there are enough of them.
            done = 0
            for cut in new:
                if len(held) + cut - done >= PACK:
                    yield out(np.concatenate([held, fps[done:cut]]))
                    held, done = held[:0], cut
            held = np.concatenate([held, fps[done:]])
            last = keys[:, -1]
        if len(held):
            yield out(held)

    return run


def _bucket_keys(radius: int) -> Column:
    cuts = [round(BITS * i / (radius + 2)) for i in range(radius + 3)]
    block = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    keys = []
    for name, (i, j) in enumerate(combinations(range(radius + 2), 2)):
        high = F.shiftleft(block[i], cuts[j + 1] - cuts[j]).bitwiseOR(block[j])
        keys.append(F.shiftleft(F.lit(name).cast("long"), 48).bitwiseOR(high))
    return F.array(*keys)


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): edges over distinct fingerprints ``fp`` that connect all within ``radius`` bits."""
    buckets = fps.select("fp", F.explode(_bucket_keys(radius)).alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = buckets.join(shared, "bucket").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    # Part p meets each other part in a task of its own; a bucket of one part is one task's.
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: (p != F.col("part")) | (F.col("parts") == 1))
    met = placed.select("bucket", "fp", "part", F.explode(others).alias("other")).select(
        "bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "fp"
    )
    group = ["bucket", "lo", "hi"]
    return met.repartition(*group).sortWithinPartitions(*group).mapInArrow(_forests(radius), "a long, b long").distinct()


def _grouped(df: DataFrame, key: str, text: str, shingle: int, radius: int, keep=()):
    """The rows with their fingerprints, and per fingerprint its group's smallest key and first row."""
    spark = df.sparkSession
    columns = list(dict.fromkeys([key, *keep]))
    hashed = df.select(*columns, F.xxhash64(text).alias("_hash"), F.col(text).alias("_full"))
    rows = stage(with_fingerprints(hashed, "_full", [*columns, "_hash"], shingle), "fingerprints").frame
    place = F.struct(F.col(key).isNull().alias("missing"), F.col(key).alias("key"), F.col("_hash").alias("hash"))
    distinct = stage(rows.groupBy("fp").agg(F.min(key).alias("least"), F.min(place).alias("first")), "distinct")
    edges = stage(links(distinct.frame.select("fp"), radius), "links")
    roots = connected_components(edges.frame)
    members = stage(
        distinct.frame.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "members"
    )
    groups = members.frame.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
    named = stage(members.frame.select("fp", "root").join(groups, "root").drop("root"), "named").frame
    for path in (distinct.path, edges.path, members.path):
        release(spark, path)
    return rows, named


def near_copies(df: DataFrame, key: str, text: str = "text", shingle: int = 3, radius: int = 3, keep=()) -> DataFrame:
    """The key and ``keep`` columns of every row, its fp, and its group's component_id."""
    rows, named = _grouped(df, key, text, shingle, radius, keep)
    return rows.join(named.select("fp", "component_id"), "fp").drop("_hash")


def first_copies(df: DataFrame, key: str, text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of each group, the one with the smallest key; all columns stay as they are."""
    named = _grouped(df, key, text, shingle, radius)[1]
    first = named.select(F.struct("first.key", "first.hash").alias("_first")).distinct()
    # The other columns travel as one, so that no name can clash.
    rest = [c for c in df.columns if c not in (key, text)]
    mark = F.struct(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("hash")).alias("_first")
    others = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0)
    own = df.select(mark, others.alias("_rest"), F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    # Of repeated rows one stays; they meet in the partition that the join made.
    kept = own.join(first, "_first", "left_semi").dropDuplicates(["_first"])
    place = {key: "_key", text: "_text"}
    return kept.select(*[F.col(place[c] if c in place else f"_rest.`{c}`").alias(c) for c in df.columns])
