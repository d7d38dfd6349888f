"""Search, exclusion and key look-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ALLERGENS
from ..functions.text import col, contains, contains_any


def search(
    df: DataFrame,
    term: str | None = None,
    category: str | None = None,
    grade: str | None = None,
    exclude: Sequence[str] = (),
    limit: int | None = 100,
    tie_break: Sequence[str] = ("code",),
    name: str = "product_name",
    categories: str = "categories_en",
    grades: str = "nutriscore_grade",
    ingredients: str = "ingredients_text",
) -> DataFrame:
    """All given criteria together; terms are literal text, never part of an SQL string."""
    if term:
        df = df.where(contains(name, term))
    if category:
        df = df.where(contains(categories, category))
    if grade:
        df = df.where(col(grades) == grade.lower())
    df = exclude_terms(df, exclude, ingredients)
    if limit is None:
        return df
    return df.orderBy(*[col(t).asc_nulls_last() for t in tie_break]).limit(limit)


def in_category(df: DataFrame, category: str, categories: str = "categories_en") -> DataFrame:
    """Rows whose category text contains the picked category as written, capitals included."""
    return df.where(F.contains(col(categories), F.lit(category)))


def exclude_terms(df: DataFrame, terms: Sequence[str], text: str) -> DataFrame:
    """Rows without any of the terms; a missing text has none."""
    return df.where(~contains_any(text, terms)) if terms else df


def exclude_groups(df: DataFrame, groups: Sequence[str], text: str, members: dict[str, list[str]] = ALLERGENS) -> DataFrame:
    """Rows whose text names no member of the chosen groups."""
    return exclude_terms(df, [m for g in groups for m in members[g]], text)


def any_column_contains(df: DataFrame, columns: Sequence[str], term: str) -> DataFrame:
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(contains(c, term), F.lit(False))
    return df.where(found)


def lookup_key(df: DataFrame, key: str, value, tie_break: Sequence[str]) -> DataFrame:
    """The row of a key, at most one: the first by ``tie_break``."""
    return df.where(col(key) == F.lit(str(value))).orderBy(*[col(t) for t in tie_break]).limit(1)


def lookup_many(wanted: DataFrame, local: DataFrame, fallback: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A row per wanted key from the local table, or else from the fallback table, or else nulls.

    Both tables hold one row per key. ``found_in`` says which one answered. Each table is joined once, on
    the same key, and the answer is picked per row.
    """
    keys = wanted.select(col(key)).distinct()

    def side(df, name):
        held = [c for c in columns if c in df.columns]
        return df.select(col(key), F.struct(F.lit(name).alias("found_in"), *[col(c) for c in held]).alias(name)), held

    (here, in_local), (there, in_fallback) = side(local, "local"), side(fallback, "payload")
    joined = keys.join(here, key, "left").join(there, key, "left")

    def answer(c):
        one = F.col(f"local.`{c}`") if c in in_local else F.lit(None)
        two = F.col(f"payload.`{c}`") if c in in_fallback else F.lit(None)
        return F.when(F.col("local").isNotNull(), one).otherwise(two)

    shown = [c for c in columns if c in in_local or c in in_fallback]
    return joined.select(col(key), *[answer(c).alias(c) for c in shown], F.coalesce("local.found_in", "payload.found_in").alias("found_in"))
