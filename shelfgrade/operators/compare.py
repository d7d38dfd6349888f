"""Pairs of products side by side, and the change a substitute brings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import COMPARED_SHAPE, FEATURES
from ..functions.numeric import relative_change, zero_if_missing
from ..functions.text import col
from .dedup import first_per_key


def _pair_rows(pairs: DataFrame, products: DataFrame, name: str, order_by, nutrients) -> DataFrame:
    """Both products of each pair; of several rows with one name the first counts."""
    named = first_per_key(products.where(col(name).isNotNull()), [name], order_by)

    def side(i):
        return named.select(
            col(name).alias(f"name_{i}"), *[zero_if_missing(c).alias(f"{c}_{i}") for c in nutrients]
        )

    return pairs.select("name_1", "name_2").join(side(1), "name_1").join(side(2), "name_2")


def _long(rows: DataFrame, nutrients: Sequence[str]) -> DataFrame:
    values = F.array(
        *[
            F.struct(F.lit(c).alias("nutrient"), col(f"{c}_1").alias("value_1"), col(f"{c}_2").alias("value_2"))
            for c in nutrients
        ]
    )
    return rows.select("name_1", "name_2", F.inline(values))


def compare_pairs(pairs: DataFrame, products: DataFrame, order_by: Sequence[str], nutrients: Sequence[str] = FEATURES, name: str = "product_name") -> DataFrame:
    """Per pair and nutrient both values and the better side; the lower value wins throughout."""
    long = _long(_pair_rows(pairs, products, name, order_by, nutrients), nutrients)
    return long.withColumn(
        "better",
        F.when(F.col("value_1") < F.col("value_2"), "1").when(F.col("value_2") < F.col("value_1"), "2").otherwise("="),
    )


def pair_shapes(pairs: DataFrame, products: DataFrame, order_by: Sequence[str], nutrients: Sequence[str] = COMPARED_SHAPE, name: str = "product_name") -> DataFrame:
    """Values relative to the larger of the two, or to 1 where both are smaller."""
    long = _long(_pair_rows(pairs, products, name, order_by, nutrients), nutrients)
    scale = F.greatest("value_1", "value_2", F.lit(1.0))
    return long.select(
        "name_1", "name_2", "nutrient", (F.col("value_1") / scale).alias("share_1"), (F.col("value_2") / scale).alias("share_2")
    )


def substitute_deltas(
    offers: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str] = ("energy_100g", "sugars_100g", "salt_100g"),
    prefix: str = "sub_",
    lower_is_better: bool = True,
) -> DataFrame:
    """Per offer and measure the change in percent, its direction and whether it is an improvement.

    No row where the original is zero or missing, or the change is under two percent.
    """
    values = F.array(
        *[
            F.struct(
                F.lit(m).alias("measure"),
                zero_if_missing(m).alias("original"),
                zero_if_missing(f"{prefix}{m}").alias("substitute"),
            )
            for m in measures
        ]
    )
    long = offers.select(*[col(k) for k in keys], F.inline(values))
    down = F.col("substitute") < F.col("original")
    return (
        long.withColumn("percent", relative_change("original", "substitute"))
        .where("percent IS NOT NULL")
        .withColumns(
            {
                "direction": F.when(down, "down").otherwise("up"),
                "improves": down == F.lit(lower_is_better),
            }
        )
    )
