"""Tables of users and saved substitutes: conditional appends, deletion, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col
from ..staging import release, scope, stage
from .dedup import first_per_key


def number_rows(df: DataFrame, order_by: Sequence[str], start, name: str = "id") -> DataFrame:
    """Consecutive numbers from ``start`` in the given order, without a one-task sort.

    The rows are range-partitioned and written; a partition's first number follows from the
    row counts of the partitions before it, and rows are numbered within their partition.
    """
    order = [col(o) for o in order_by]
    ranged = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged").frame
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row per partition.
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stage(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before")), "offsets").frame
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        ranged.withColumn("_place", place)
        .join(offsets, "_part")
        .withColumn(name, F.lit(start) + F.col("_before") + F.col("_place") - 1)
        .drop("_part", "_before", "_place")
    )


def next_id(existing: DataFrame, name: str = "id") -> int:
    return existing.agg(F.coalesce(F.max(col(name)), F.lit(0)) + 1).first()[0]


def absent_rows(new: DataFrame, existing: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """New rows whose key is in neither table before them; the first of a batch counts."""
    return first_per_key(new, keys, order_by).join(existing.select(*[col(k) for k in keys]).distinct(), list(keys), "left_anti")


def append_if_absent(new: DataFrame, existing: DataFrame, keys: Sequence[str], order_by: Sequence[str], id_column: str = "id") -> DataFrame:
    """The rows to append, numbered on from the largest id."""
    added = absent_rows(new, existing, keys, order_by)
    return number_rows(added, order_by, next_id(existing, id_column), id_column)


def unique_on_any(new: DataFrame, existing: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """New rows that share none of several keys with the table or with an accepted row before them.

    Rows are taken in order, so a row that was refused blocks nobody. Each round accepts the
    rows that come first among the open ones for all their keys, and refuses the open rows that
    share a key with an accepted one; the first open row is always decided.

    The number of rounds is the length of the longest chain in which each row waits for the row
    before it; with few conflicts it is two or three. Rounds are written tables, and accepted rows
    are appended to one folder, so that neither lineage nor plan grows with the rounds. Rows
    without a key are given one of their own, which is nobody else's, so that they spread.
    """
    place = F.struct(*[col(o) for o in order_by])
    own = F.concat(F.lit("own "), F.to_json(place))
    named = {key: f"_key_{k}" for k, key in enumerate(keys)}
    for key in keys:
        new = new.join(existing.select(col(key)).distinct(), key, "left_anti")
    columns = new.columns
    spark = new.sparkSession
    with scope(spark) as keep:
        keyed = {name: F.when(col(key).isNotNull(), F.concat(F.lit("key "), col(key).cast("string"))).otherwise(own) for key, name in named.items()}
        open_ = stage(new.withColumns({"_place": place, **keyed}), "open")
        accepted = stage(open_.frame.select(*columns).limit(0), "accepted")
        while open_.rows:
            marked, first = open_.frame, F.lit(True)
            for name in named.values():
                # The minimum is taken in the map tasks first.
                leaders = open_.frame.groupBy(name).agg(F.min("_place").alias(f"{name}_first"))
                marked = marked.join(leaders, name)
                first = first & (F.col("_place") == F.col(f"{name}_first"))
            decided = stage(marked.withColumn("_accepted", first).select(*open_.frame.columns, "_accepted"), "round")
            winners = decided.frame.where("_accepted")
            winners.select(*columns).write.mode("append").parquet(accepted.path)
            rest = decided.frame.where("NOT _accepted").drop("_accepted")
            for name in named.values():
                rest = rest.join(winners.select(name), name, "left_anti")
            done, open_ = open_, stage(rest, "open")
            for path in (done.path, decided.path):
                release(spark, path)
        keep(accepted)
    return spark.read.schema(accepted.frame.schema).parquet(accepted.path)


def append_unique_any(new: DataFrame, existing: DataFrame, keys: Sequence[str], order_by: Sequence[str], id_column: str = "id") -> DataFrame:
    added = unique_on_any(new, existing, keys, order_by)
    return number_rows(added, order_by, next_id(existing, id_column), id_column)


def delete_keys(table: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table without the rows whose key is listed."""
    return table.join(doomed.select(*[col(k) for k in keys]).distinct(), list(keys), "left_anti")


def history(table: DataFrame, user, user_column: str = "user_id", saved_at: str = "saved_at", tie_break: Sequence[str] = ("id",)) -> DataFrame:
    """A user's rows, newest first."""
    return table.where(col(user_column) == F.lit(user)).orderBy(col(saved_at).desc(), *[col(t).desc() for t in tie_break])


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table."""
    counted = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name))
        counted = one if counted is None else counted.unionByName(one)
    return counted.groupBy().agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in tables])
