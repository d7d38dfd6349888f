"""A stored index for repeated "text contains term" searches.

``write_gram_index`` writes the rows, numbered, and for each searched column a table of postings: a row per
character gram and block of numbers, with the rows whose lower-cased text holds the gram, as sorted distances from
the first number of the block.
At every place of a text the gram is the next three characters, fewer at its end, so that a term of one or two
characters is the beginning of some gram. Each task writes its postings in order of the gram with bloom filters.

A search looks up the grams of the term, which reads a few row groups, intersects the lists of the rarest, reads the
row groups that hold the remaining numbers and compares the texts themselves. Results are exact. A term whose
grams are in a large part of the rows is looked for in all rows, as the index could not rule out much.

A block spans at most ``BLOCK`` numbers, all from one task of the write, so a gram that every text has is many short
lists, and lists meet block by block. A list is whole in the task that reads its rows, so nothing is shuffled: a file
holds all grams of its own rows, and a look-up reads the few pages of each file around its grams.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col, contains
from .keyed import write_sorted

# The tasks get these functions as code, and need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM = 3
BLOCK = 1 << 14
RAREST = 4  # lists that are intersected; the texts decide about the rest
LISTED = 1000  # row numbers that are pushed down as a list; more are joined
LARGE_SHARE = 0.2
ROWS_PER_GROUP = 10_000
LISTS_PER_GROUP = 1000
HELD = 1 << 21  # bytes of text whose grams a task holds at a time; a longer text is held alone


POSTINGS = "gram string, block long, rows array<int>, n long"


def _folders(path: str, at: int) -> str:
    return f"{path}/grams-{at}"


def _postings_from(rows: np.ndarray, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """Lists of the grams of some texts, in order of the gram; gram ends at the text's end are shorter."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) for t in texts])
    used = np.bincount(chars) > 0
    base, known = int(used.sum()) + 1, np.flatnonzero(used)
    if len(texts) > 1 and base**GRAM * len(texts) >= 1 << 63:
        for half in (slice(None, len(texts) // 2), slice(len(texts) // 2, None)):
            yield from _postings_from(rows[half], texts[half])
        return
    # A gram is a number with the characters as digits, 0 behind the end of the text.
    digits = np.cumsum(used)[chars]
    owner = np.repeat(np.arange(len(texts)), lengths)
    gram = digits
    for ahead in range(1, GRAM):
        gram = gram * base
        gram[:-ahead] += np.where(owner[ahead:] == owner[:-ahead], digits[ahead:], 0)
    which, at = np.divmod(np.unique(gram * len(texts) + owner), len(texts))
    starts = np.flatnonzero(np.diff(which, prepend=-1))
    found, ends = which[starts], np.append(starts, len(which))
    places = np.stack([found // base**k % base for k in reversed(range(GRAM))], axis=1)
    spelled = known[places[places > 0] - 1].astype(np.uint32).tobytes().decode("utf-32-le")
    cuts = np.append(0, np.cumsum((places > 0).sum(axis=1))).tolist()
    away = (rows[at] - rows[0]).astype(np.int32)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([spelled[a:b] for a, b in zip(cuts, cuts[1:])]),
            pa.array(np.full(len(found), rows[0], np.int64)),
            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(away)),
            pa.array(np.diff(ends).astype(np.int64)),
        ],
        names=["gram", "block", "rows", "n"],
    )


def _lists(block: int):
    """Postings of the rows of a task; a list spans ``block`` numbers at most, which rise.

    The numbers of a file rise, but a task may read a later part of it first.
    """

    def run(batches):
        held, size = [], 0  # pieces of one block

        def done():
            if held:
                rows, texts = np.concatenate([r for r, _ in held]), [t for _, piece in held for t in piece.to_pylist()]
                yield from _postings_from(rows, texts)
            held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            rows, texts = b.column("row").to_numpy(), b.column("text")
            sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
            parts = np.cumsum(sizes) // HELD
            cuts = np.flatnonzero((np.diff(rows // block) != 0) | (np.diff(rows) < 0) | (np.diff(parts) != 0)) + 1
            for first, last in zip([0, *cuts], [*cuts, len(rows)]):
                more = int(sizes[first:last].sum())
                if held and (held[0][0][0] // block != rows[first] // block or rows[first] < held[-1][0][-1] or size + more > HELD):
                    yield from done()
                size = more + (size if held else 0)
                held.append((rows[first:last], texts.slice(first, last - first)))
        yield from done()

    return run


def write_gram_index(df: DataFrame, path: str, columns: Sequence[str], rows_per_group: int = ROWS_PER_GROUP, block: int = BLOCK, files: int | None = None) -> None:
    """Write the table and an index of each of ``columns``, in at most ``files`` files a column.

    Missing and empty texts are in the table only.
    """
    spark = df.sparkSession
    number = "_row"
    while number in df.columns:
        number += "_"
    # The numbers of a file follow each other, so that bounds rule out most files and row groups.
    (
        df.withColumn(number, F.monotonically_increasing_id())
        .write.mode("overwrite")
        .option("parquet.block.row.count.limit", str(rows_per_group))
        .option("parquet.page.row.count.limit", str(max(1, rows_per_group // 10)))
        .parquet(f"{path}/rows")
    )
    rows = _rows(spark, path)
    for at, c in enumerate(df.columns):
        if c not in columns:
            continue
        held = rows.select(col(number).alias("row"), F.lower(col(c)).alias("text")).where("text <> ''")
        lists = held.mapInArrow(_lists(block), POSTINGS)
        # Distances of neighbours in a list are small: written as differences, a number takes about a byte.
        packed = {"parquet.writer.version": "v2", "parquet.enable.dictionary#rows.list.element": "false"}
        write_sorted(lists.coalesce(files) if files else lists, _folders(path, at), "gram", ["block"], LISTS_PER_GROUP, packed)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def _postings(spark: SparkSession, path: str, column: str) -> DataFrame:
    at = _rows(spark, path).columns.index(column)
    return spark.read.schema(POSTINGS).parquet(_folders(path, at))


def postings_of(spark: SparkSession, path: str, column: str, term: str) -> DataFrame:
    """The postings of the grams of a term; of all grams that begin with it, where it is shorter than a gram."""
    lists = _postings(spark, path, column)
    if len(term) < GRAM:
        return lists.where(F.col("gram").startswith(term))
    return lists.where(F.col("gram").isin(_whole_grams(term)))


def _whole_grams(term: str) -> list[str]:
    return list(dict.fromkeys(term[i : i + GRAM] for i in range(len(term) - GRAM + 1)))


def candidates(spark: SparkSession, path: str, column: str, term: str, all_rows: int | None = None) -> DataFrame | None:
    """``row``: numbers that may hold the lower-cased term; None where that is a large part of ``all_rows``."""
    limit = LARGE_SHARE * (_rows(spark, path).count() if all_rows is None else all_rows)
    lists = postings_of(spark, path, column, term)
    if len(term) < GRAM:
        held = lists.agg(F.sum("n")).first()[0] or 0
        return None if held > limit else _numbers(lists, F.col("rows")).distinct()
    # A row per gram of the term.
    counts = {r["gram"]: r["n"] for r in lists.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    wanted = sorted(_whole_grams(term), key=lambda g: (counts.get(g, 0), g))[:RAREST]
    if counts.get(wanted[0], 0) == 0:
        return lists.where(F.lit(False)).select(F.lit(0).cast("long").alias("row"))
    if counts[wanted[0]] > limit:
        return None
    # RAREST lists of a block at most.
    met = lists.where(F.col("gram").isin(wanted)).groupBy("block").agg(F.collect_list("rows").alias("each")).where(F.size("each") == len(wanted))
    common = F.aggregate(F.slice("each", 2, RAREST), F.col("each")[0], F.array_intersect)
    return _numbers(met, common)


def _numbers(lists: DataFrame, rows: Column) -> DataFrame:
    """``row``: the numbers of the rows in lists of distances."""
    return lists.select("block", F.explode(rows).alias("away")).select((F.col("block") + F.col("away")).alias("row"))


def find_containing(spark: SparkSession, path: str, terms: dict[str, str], any_of: bool = False) -> DataFrame:
    """The rows whose columns contain the terms as literal text in any case: all of them, or with ``any_of`` at least one.

    Empty terms are passed over; without any other the whole table is the result. Columns must be indexed.
    """
    rows = _rows(spark, path)
    number = rows.columns[-1]
    terms = {c: t for c, t in terms.items() if t}
    if not terms:
        return rows.drop(number)
    held = None
    for c, t in terms.items():
        found = F.coalesce(contains(c, t), F.lit(False))
        held = found if held is None else (held | found if any_of else held & found)
    all_rows = rows.count()  # from the footers
    offers = [candidates(spark, path, c, t.lower(), all_rows) for c, t in terms.items()]
    if any_of:
        narrowed = None if any(o is None for o in offers) else _union(offers)
    else:
        narrowed = _common([o for o in offers if o is not None])
    if narrowed is not None:
        rows = _numbered(rows, number, narrowed)
    return rows.where(held).drop(number)


def _union(offers: list[DataFrame]) -> DataFrame:
    out = offers[0]
    for o in offers[1:]:
        out = out.unionByName(o)
    return out.distinct()


def _common(offers: list[DataFrame]) -> DataFrame | None:
    if not offers:
        return None
    out = offers[0]
    for o in offers[1:]:
        out = out.join(o, "row", "left_semi")
    return out


def _numbered(rows: DataFrame, number: str, narrowed: DataFrame) -> DataFrame:
    """The rows with these numbers: few are pushed down to the files, many are joined."""
    few = [r["row"] for r in narrowed.limit(LISTED + 1).collect()]
    if len(few) > LISTED:
        return rows.join(narrowed.withColumnRenamed("row", number), number, "left_semi").select(*[col(c) for c in rows.columns])
    if not few:
        return rows.where(F.lit(False))
    near = col(number).between(min(few), max(few))
    return rows.where(near & col(number).isin(few))
