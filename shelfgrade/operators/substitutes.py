"""Better-graded substitutes for every product at once.

Candidates are ordered by grade first, so the rows with a better grade than some product are
a prefix of the order. A list for a category therefore needs at most ``n`` rows of one name
and ``2 n`` rows in all: leaving out the asking product's own name takes away at most ``n``.
These short lists are built per category text, merged per asked category, and attached to the
products as one array; the big table is joined once, row for row, and never ranked.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import GRADES
from ..functions.grades import own_grade
from ..functions.text import col, first_category
from ..staging import scope, stage
from .dedup import top_rows
from .joins import join_spread
from .substring_join import join_containing, needle_table, text_table


@dataclass(frozen=True)
class Columns:
    name: str = "product_name"
    category: str = "categories_en"
    grade: str = "nutriscore_grade"
    energy: str = "energy_100g"


def _order(cols: Columns, tie_break: Sequence[str], prefix: str = "") -> list[Column]:
    names = [cols.grade, cols.energy, *tie_break]
    return [F.col(f"{prefix}`{c}`").asc_nulls_last() for c in names]


def find_substitutes(
    products: DataFrame,
    tie_break: Sequence[str],
    n: int = 3,
    payload: Sequence[str] = (),
    cols: Columns = Columns(),
    grades: Sequence[str] = GRADES,
) -> DataFrame:
    """Up to ``n`` substitutes per product, ranked by grade, energy (missing last), ``tie_break``.

    A substitute has a strictly better grade, another name, and a category text that contains
    the product's first category. Products with no such row, or without category, get the best
    rows of all categories instead (``source`` = overall); there the own name is allowed.
    Output: the product's ``tie_break`` columns, name and payload, ``position``, ``source`` and
    the substitute's columns prefixed ``sub_``.
    """
    spark = products.sparkSession
    with scope(spark) as keep:
        return _substitutes(products, tie_break, n, payload, cols, grades, keep)


def _substitutes(products, tie_break, n, payload, cols: Columns, grades, keep) -> DataFrame:
    carried = list(dict.fromkeys([*tie_break, cols.name, cols.category, cols.grade, cols.energy, *payload]))
    table = keep(stage(products.select(*[col(c) for c in carried]), "products"))
    asking = table.withColumns(
        {
            "_own": own_grade(cols.grade, grades),
            "_asked": F.nullif(F.lower(first_category(cols.category)), F.lit("")),
        }
    ).where(F.col("_own") != grades[0])

    better = table.where(col(cols.grade).isin(*grades[:-1]))
    lists = keep(stage(_category_lists(better, asking, tie_break, n, cols, carried), "lists"))
    offered = F.filter(
        F.coalesce(F.col("_list"), F.array().cast(lists.schema["_list"].dataType)),
        lambda s: (s[cols.grade] < F.col("_own")) & ~s[cols.name].eqNullSafe(col(cols.name)),
    )
    # Products without category have nothing to join; those of a popular one are dealt out.
    named = join_spread(asking.where("_asked IS NOT NULL"), lists, "_asked", tie_break, "left")
    nameless = asking.where("_asked IS NULL").withColumn("_list", F.lit(None).cast(lists.schema["_list"].dataType))
    answered = named.unionByName(nameless).withColumn("_offer", F.slice(offered, 1, n))

    overall = _best_overall(better, tie_break, n, cols, carried, lists.schema["_list"].dataType)
    fallback = F.filter(overall, lambda s: s[cols.grade] < F.col("_own"))
    none = F.size("_offer") == 0
    chosen = answered.withColumns(
        {
            "source": F.when(none, F.lit("overall")).otherwise(F.lit("category")),
            "_offer": F.when(none, fallback).otherwise(F.col("_offer")),
        }
    )
    exploded = chosen.select(*[col(c) for c in carried], "source", F.posexplode("_offer").alias("_at", "_sub"))
    return exploded.select(
        *[col(c) for c in carried],
        (F.col("_at") + 1).alias("position"),
        "source",
        *[F.col("_sub").getField(c).alias(f"sub_{c}") for c in carried],
    )


def _category_lists(better, asking, tie_break, n, cols: Columns, carried) -> DataFrame:
    """For every asked category the first ``2 n`` candidates, at most ``n`` of one name, as an array."""
    named = better.where(col(cols.name).isNotNull() & col(cols.category).isNotNull()).withColumn(
        "_text", F.lower(col(cols.category))
    )
    order = _order(cols, tie_break)
    short = top_rows(top_rows(named, ["_text", cols.name], order, n), ["_text"], order, 2 * n)
    # At most 2 n rows per category text.
    short = short.groupBy("_text").agg(F.collect_list(F.struct(*[col(c) for c in carried])).alias("_rows"))
    found = join_containing(needle_table(asking, "_asked"), text_table(short, "_text"))
    offered = found.select(F.col("needle").alias("_asked"), F.inline("_rows"))
    offered = top_rows(top_rows(offered, ["_asked", cols.name], order, n), ["_asked"], order, 2 * n, "_place")
    return offered.groupBy("_asked").agg(
        F.sort_array(F.collect_list(F.struct("_place", *[col(c) for c in carried]))).alias("_list")
    )


def _best_overall(better, tie_break, n, cols: Columns, carried, as_type) -> Column:
    """The ``n`` best rows of all, as a literal array."""
    best = better.select(*[col(c) for c in carried]).orderBy(*_order(cols, tie_break)).limit(n).collect()
    place = as_type.elementType.fieldNames()[0]
    rows = [
        F.struct(F.lit(i + 1).alias(place), *[F.lit(row[c]).alias(c) for c in carried])
        for i, row in enumerate(best)
    ]
    return F.array(*rows).cast(as_type)
