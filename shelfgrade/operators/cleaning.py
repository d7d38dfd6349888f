"""Cleaning steps. Each takes and returns a DataFrame and skips columns that do not exist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_BRAND, DEFAULT_CATEGORY, GRADE_LABELS, GRADES, REGION_PATTERN
from ..functions import numeric, text
from ..functions.grades import grade_label
from ..functions.text import col
from ..schema import ensure_column
from ..staging import Staged, stage
from .order_statistics import exact_quantiles


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def drop_missing(df: DataFrame, required: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=present(df, required))


def normalize_grades(df: DataFrame, grade: str = "nutriscore_grade") -> DataFrame:
    return df.withColumn(grade, text.normalize_grade(grade))


def keep_domain(df: DataFrame, column: str = "nutriscore_grade", domain: Sequence[str] = GRADES, any_case: bool = False) -> DataFrame:
    value = F.lower(col(column)) if any_case else col(column)
    return df.where(value.isin(*domain))


def keep_regions(df: DataFrame, column: str = "countries_en", pattern: str = REGION_PATTERN) -> DataFrame:
    if column not in df.columns:
        return df
    return df.where(F.lower(col(column)).rlike(pattern))


def parse_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    types = dict(df.dtypes)
    return df.withColumns(
        {c: numeric.number(c, types[c] == "string") for c in present(df, columns)}
    )


def parse_counts(df: DataFrame, columns: Sequence[str] = ("additives_n",)) -> DataFrame:
    types = dict(df.dtypes)
    return df.withColumns(
        {c: numeric.count_or_zero(c, types[c] == "string") for c in present(df, columns)}
    )


def clip_bounds(data: Staged, columns: Sequence[str], upper: float = 0.99) -> dict[str, float | None]:
    """Upper clip bound of every column, from one aggregate over the staged table."""
    found = exact_quantiles(data, columns, [upper]).first()
    return {c: (found[c][0] if found is not None and found[c] else None) for c in columns}


def clip_outliers(df: DataFrame, bounds: dict[str, float | None], low: float = 0.0, swap: bool = True) -> DataFrame:
    """Limit the columns to [low, bound]; a column without values only has the lower limit.

    A bound under ``low`` (nearly all values negative) swaps the two limits, or with
    ``swap=False`` leaves ``low`` as the only value.
    """
    limits = {c: (low, high) if high is None or high >= low or not swap else (high, low) for c, high in bounds.items()}
    return df.withColumns({c: numeric.clip(c, *limits[c]) for c in bounds})


def global_medians(data: Staged, columns: Sequence[str]) -> dict[str, float | None]:
    return clip_bounds(data, columns, 0.5) if columns else {}


def fill_values(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    known = {c: v for c, v in values.items() if v is not None}
    return df.withColumns({c: F.coalesce(col(c), F.lit(v)) for c, v in known.items()}) if known else df


def fill_group_median(data: Staged, by: str, columns: Sequence[str]) -> DataFrame:
    """Missing values from the median of the row's group, then from the median of the filled column.

    The medians are a table of one row per group, joined without a hint: its files are
    measured, so it is broadcast only if it is small. The second statistic is computed only
    for columns in which a whole group has no value.
    """
    df = data.frame
    columns = list(columns)
    medians = stage(
        exact_quantiles(data, columns, [0.5], [by])
        .where(col(by).isNotNull())
        .select(col(by).alias("_group"), *[F.get(col(c), F.lit(0)).alias(f"_median_{c}") for c in columns]),
        "medians",
    ).frame
    filled = df.join(medians, col(by) == F.col("_group"), "left").withColumns(
        {c: F.coalesce(col(c), F.col(f"`_median_{c}`")) for c in columns}
    ).select(*[col(c) for c in df.columns])
    open_ = medians.agg(*[F.max(F.col(f"`_median_{c}`").isNull()).alias(c) for c in columns]).first()
    rest = [c for c in columns if open_[c] or open_[c] is None]
    return fill_values(filled, global_medians(data.derive(filled), rest))


def default_texts(df: DataFrame, brand: str = "brands", category: str | None = "categories_en", title: bool = True) -> DataFrame:
    """Brand and category defaults; a missing column is created."""
    if brand in df.columns:
        df = df.withColumn(brand, text.text_default(brand, DEFAULT_BRAND, title))
    elif title:
        df = ensure_column(df, brand, DEFAULT_BRAND)
    if category:
        df = ensure_column(df, category, DEFAULT_CATEGORY)
        df = df.withColumn(category, F.coalesce(col(category), F.lit(DEFAULT_CATEGORY)))
    return df


def add_label(df: DataFrame, grade: str = "nutriscore_grade", label: str = "nutriscore_label", drop_unknown: bool = True, labels=GRADE_LABELS) -> DataFrame:
    df = df.withColumn(label, grade_label(grade, labels))
    return df.where(col(label).isNotNull()) if drop_unknown else df
