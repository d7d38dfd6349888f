"""Joins whose key may be hot on one side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from ..staging import stage

SPREAD = 32
HOT_SHARE = 0.002
HOT_LEAST = 1000


def join_spread(large: DataFrame, small: DataFrame, key: str, spread_by: Sequence[str], how: str = "inner", spread: int = SPREAD) -> DataFrame:
    """Join on ``key``, the rows of a key in ``large`` dealt over ``spread`` copies of its rows in ``small``.

    ``spread_by`` are columns of ``large`` that tell rows of a key apart. ``small`` is copied as a
    whole, so it should hold few rows per key, as a list or a count does.
    """
    salt = F.pmod(F.xxhash64(*[col(c) for c in spread_by]), F.lit(spread)).cast("int")
    copies = small.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return large.withColumn("_copy", salt).join(copies, [key, "_copy"], how).drop("_copy")


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE, least: int = HOT_LEAST) -> DataFrame:
    """The keys that hold more than ``share`` of the rows and more than ``least`` rows.

    There are at most ``1 / share`` of them (500), however large ``df`` is. Counts fold in the map tasks.
    """
    counted = stage(df.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("_rows")), "key-counts").frame
    total = counted.agg(F.sum("_rows")).first()[0] or 0
    return counted.where(F.col("_rows") > max(least, int(total * share))).drop("_rows")


def join_counted(large: DataFrame, small: DataFrame, keys: Sequence[str], spread_by: Sequence[str], how: str = "inner", hot: DataFrame | None = None, spread: int = SPREAD) -> DataFrame:
    """Join on ``keys``; only rows of ``small`` under a counted hot key are copied ``spread`` times.

    ``hot`` are the hot keys of ``large``, counted if not given; their number is bounded (``hot_keys``),
    so both sides look them up in a broadcast. Rows of other keys meet as in a plain join. Missing
    keys meet nothing.
    """
    hot = hot_keys(large, keys) if hot is None else hot
    marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    salt = F.pmod(F.xxhash64(*[col(c) for c in spread_by]), F.lit(spread)).cast("int")
    dealt = large.join(marked, list(keys), "left").withColumn("_copy", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    places = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    copies = small.join(marked, list(keys), "left").withColumn("_copy", F.explode(places)).drop("_hot")
    return dealt.join(copies, [*keys, "_copy"], how).drop("_copy")
