"""Ad-hoc SQL over given tables, and the preset questions as expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col
from ..staging import stage


@dataclass(frozen=True)
class Preset:
    """Rows that fit, or their counts per group; the first ``limit`` by ``order``, ties by key."""

    show: tuple[str, ...]
    where: Column | None = None
    largest: str | None = None
    count: str | None = None
    limit: int | None = None


def presets() -> dict[str, Preset]:
    """Thresholds and lengths are those of the published dashboard."""
    return {
        "top_sugar": Preset(("product_name", "brands", "nutriscore_grade", "sugars_100g"), largest="sugars_100g", limit=10),
        "grade_dist": Preset(("nutriscore_grade",), count="n"),
        "no_additives": Preset(("product_name", "brands", "energy_100g"), (F.col("additives_n") == 0) & (F.col("nutriscore_grade") == "a"), limit=20),
        "worst_brands": Preset(("brands",), F.col("nutriscore_grade") == "e", largest="n_bad", count="n_bad", limit=10),
        "high_fiber": Preset(("product_name", "fiber_100g", "nutriscore_grade"), F.col("fiber_100g") > 5, largest="fiber_100g", limit=15),
    }


def run_preset(products: DataFrame, preset: Preset, tie_break: Sequence[str]) -> DataFrame:
    """Answer of a preset. Groups are their own tie-break."""
    rows = products if preset.where is None else products.where(preset.where)
    shown, ties = list(preset.show), list(tie_break)
    if preset.count:
        rows = rows.groupBy(*[col(c) for c in shown]).agg(F.count(F.lit(1)).alias(preset.count))
        shown, ties = [*shown, preset.count], shown
    order = [col(preset.largest).desc_nulls_last()] if preset.largest else []
    rows = rows.orderBy(*order, *[col(t) for t in ties])
    return (rows if preset.limit is None else rows.limit(preset.limit)).select(*[col(c) for c in shown])


def run_sql(spark: SparkSession, query: str, args: dict | None = None, evaluate: bool = True, **tables: DataFrame) -> DataFrame:
    """Answer of a query over the given tables; a faulty query answers with one ``error`` row.

    Tables stand in braces (``FROM {products}``) and are known to this query only; values are passed as
    named parameters (``:name``), not written into the text. The answer is computed once and
    stored, so that an error while it runs is an error row as well; ``evaluate=False`` leaves it lazy.
    """
    try:
        answer = spark.sql(query, args=args or {}, **tables)
        return stage(answer, "answer").frame if evaluate else answer
    except (PySparkException, Py4JJavaError) as error:
        return spark.createDataFrame([(str(error),)], "error string")
