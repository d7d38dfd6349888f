"""First-wins and latest-wins rules.

``row_number() = 1`` over the key lets Spark keep one row per key in every map task
(WindowGroupLimit) before anything is shuffled, so a key held by a third of the rows
arrives as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col


def top_rows(df: DataFrame, keys: Sequence, order_by: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key; null keys are equal to each other."""
    name = rank or "_rank"
    place = F.row_number().over(Window.partitionBy(*[col(k) for k in keys]).orderBy(*order_by))
    kept = df.withColumn(name, place).where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, the first in the given order; whole rows where no key column exists."""
    present = [k for k in keys if k in df.columns]
    if not present:
        return df.dropDuplicates()
    return top_rows(df, present, [col(o).asc_nulls_last() for o in order_by], 1)


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    return top_rows(df, keys, [col(o).desc_nulls_last() for o in order_by], 1)


def merge_old_wins(old: DataFrame, new: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Both tables, one row per key; a row of the old table beats any of the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(
        new.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    return first_per_key(both, keys, ["_new", *order_by]).drop("_new")
