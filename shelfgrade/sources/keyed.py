"""Tables written for look-ups by key: sorted files with bloom filters of the key.

Files hold neighbouring keys, so the smallest and largest key of a file or row group rule most of them out, and the
bloom filter most of the rest when a key is absent. A look-up then reads a few row groups, whatever the table holds.
The smallest and largest key of each file also stand in a table of their own beside the files, so that a look-up opens only
files that may hold its keys, and not the footers of all.
Rows of one key stay together only as far as a file goes: a key with very many rows is spread over files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col
from .files import exists

ROWS_PER_GROUP = 100_000
LISTED = 1000  # keys that go into one filter
RANGES = "_ranges"  # the folder of that table; readers of the files pass over it


def write_keyed(df: DataFrame, path: str, key: str, order_by: Sequence[str] = (), rows_per_group: int = ROWS_PER_GROUP, files: int | None = None) -> None:
    """Write the table in order of ``key``. Rows without a key are kept; no look-up finds them.

    ``order_by`` breaks ties, and deals the rows of one key over files where there are too many for one.
    """
    order = [col(c) for c in (key, *order_by)]
    dealt = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    write_sorted(dealt, path, key, order_by, rows_per_group)
    written = df.sparkSession.read.schema(df.schema).parquet(path).select(F.col("_metadata.file_name").alias("name"), col(key).alias("key"))
    written.groupBy("name").agg(F.min("key").alias("least"), F.max("key").alias("most")).coalesce(1).write.parquet(f"{path}/{RANGES}")


def write_sorted(df: DataFrame, path: str, key: str, order_by: Sequence[str] = (), rows_per_group: int = ROWS_PER_GROUP, options: dict[str, str] | None = None) -> None:
    """Write each partition in order of ``key`` and ``order_by``, with bloom filters of the key."""
    (
        df.sortWithinPartitions(*[col(c) for c in (key, *order_by)])
        .write.mode("overwrite")
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{key}", str(rows_per_group))
        .option("parquet.block.row.count.limit", str(rows_per_group))
        .option("parquet.page.row.count.limit", str(max(1, rows_per_group // 10)))
        .options(**(options or {}))
        .parquet(path)
    )


def _files_holding(spark: SparkSession, path: str, wanted: Sequence) -> list[str] | None:
    """The files whose keys lie around one of the wanted; nothing where that is not known."""
    if not exists(spark, f"{path}/{RANGES}"):
        return None
    ranges = spark.read.parquet(f"{path}/{RANGES}")
    # A value of another type would be compared in another order than that of the ranges.
    kind = {"string": str, "tinyint": int, "smallint": int, "int": int, "bigint": int}.get(dict(ranges.dtypes)["least"])
    if kind is None or any(type(v) is not kind for v in wanted):
        return None
    around = F.exists(F.array(*[F.lit(v) for v in wanted]), lambda v: (F.col("least") <= v) & (F.col("most") >= v))
    return [f"{path}/{r['name']}" for r in ranges.where(around).select("name").collect()]


def lookup_keys(spark: SparkSession, path: str, key: str, values: Sequence, schema=None) -> DataFrame:
    """All rows under the given keys; the filter reaches the files as equalities, which bloom filters can answer.

    More than ``LISTED`` keys are better joined: as a list they would make a filter of that length.
    """
    if len(values) > LISTED:
        raise ValueError(f"at most {LISTED} keys in one look-up; join a table of keys instead")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    wanted = [v for v in dict.fromkeys(values) if v is not None]
    files = _files_holding(spark, path, wanted) if wanted else []
    table = reader.parquet(*(files or [path]))
    if not wanted or files == []:
        return table.where(F.lit(False))
    return table.where(col(key).isin(wanted) if len(wanted) > 1 else col(key) == F.lit(wanted[0]))


def rows_scanned(found: DataFrame) -> int:
    """Rows that the scans of a look-up hand to its filters, by running it and reading Spark's metrics.

    The rows found come to the driver: for results as short as those of a look-up.
    """
    plan = found._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total
