"""Four cleaning profiles. They differ in steps and in their order, and so in their results.

Each writes the filtered, de-duplicated and parsed rows once; clip bounds and medians are
then aggregates over the columns they need, and clipping and filling are column expressions
on top. The number of jobs does not depend on the number of columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..constants import FEATURES, GRADES, NUTRIENTS, REGION_PATTERN
from ..operators import cleaning as step
from ..operators.dedup import first_per_key
from ..operators.sampling import first_rows
from ..staging import Staged, release, stage

GRADE = "nutriscore_grade"
NAME = "product_name"


@dataclass(frozen=True)
class Cleaned:
    """A cleaned table. The read rows are counted by the job that writes the kept ones, whose number
    is in the footers of the written files. The table reads staged data: use it inside a ``scope``,
    or drop the data with ``release`` when done."""

    frame: DataFrame
    rows_read: int
    data: Staged

    @property
    def rows_kept(self) -> int:
        return self.data.rows

    @property
    def rows_removed(self) -> int:
        return self.rows_read - self.rows_kept

    def release(self) -> None:
        release(self.frame.sparkSession, self.data.path)


def _observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def _staged(df: DataFrame, seen: Observation, name: str) -> tuple[Staged, int]:
    data = stage(df, name)
    rows_read = seen.get.get("rows", 0)
    if not rows_read:
        release(df.sparkSession, data.path)
        raise ValueError("no products to clean")
    return data, rows_read


def _numbers_first(df: DataFrame, columns: Sequence[str], key: str, order_by: Sequence[str]) -> DataFrame:
    """Numbers parsed before the first rows are found, as they take less of that shuffle than their texts. What is
    compared there or tested after it stays as written, and so does all where whole rows are compared."""
    if key not in df.columns:
        return df
    return step.parse_numbers(df, [c for c in columns if c not in (key, NAME, GRADE, *order_by)])


def clean_strict(df: DataFrame, order_by: Sequence[str], key: str = "code", features: Sequence[str] = FEATURES) -> Cleaned:
    """First row per code before any validity rule; clip; group medians; title-case brands."""
    df, seen = _observed(df)
    df = first_per_key(_numbers_first(df, features, key, order_by), [key], order_by)
    df = step.drop_missing(df, [NAME])
    df = step.keep_domain(step.normalize_grades(df), GRADE, GRADES)
    columns = step.present(df, features)
    data, rows_read = _staged(step.parse_numbers(df, columns), seen, "strict")
    clipped = step.clip_outliers(data.frame, step.clip_bounds(data, columns))
    out = step.fill_group_median(data.derive(clipped), GRADE, columns)
    out = step.add_label(step.default_texts(step.parse_counts(out)))
    return Cleaned(out, rows_read, data)


def clean_basic(df: DataFrame, order_by: Sequence[str], key: str = "code", features: Sequence[str] = FEATURES) -> Cleaned:
    """Grades as written; clip; global medians; rows without label stay."""
    df, seen = _observed(df)
    df = first_per_key(_numbers_first(df, features, key, order_by), [key], order_by)
    df = step.keep_domain(step.drop_missing(df, [NAME]), GRADE, GRADES)
    columns = step.present(df, features)
    data, rows_read = _staged(step.parse_numbers(df, columns), seen, "basic")
    clipped = step.clip_outliers(data.frame, step.clip_bounds(data, columns))
    out = step.fill_values(clipped, step.global_medians(data.derive(clipped), columns))
    out = step.add_label(out, drop_unknown=False)
    if "additives_n" in out.columns:
        out = step.fill_values(out, {"additives_n": 0.0})
    return Cleaned(step.default_texts(out), rows_read, data)


def clean_region(
    df: DataFrame,
    order_by: Sequence[str],
    keys: Sequence[str] = (NAME, "brands"),
    features: Sequence[str] = FEATURES,
    pattern: str = REGION_PATTERN,
    max_rows: int | None = None,
) -> DataFrame:
    """Products of some regions; no clipping; group medians; de-duplicated last, on name and brand."""
    df = step.drop_missing(step.keep_regions(df, pattern=pattern), [GRADE, NAME])
    df = step.keep_domain(df, GRADE, GRADES, any_case=True)
    if max_rows is not None:
        df = first_rows(df, max_rows, order_by)
    columns = step.present(df, features)
    data = stage(step.parse_numbers(step.normalize_grades(df), columns), "region")
    out = step.fill_group_median(data, GRADE, columns)
    out = step.add_label(step.parse_counts(out))
    return first_per_key(out, keys, order_by)


def clean_batch(df: DataFrame, order_by: Sequence[str], key: str = "code", features: Sequence[str] = NUTRIENTS) -> Cleaned:
    """Validity rules first, then one row per code; clip; global medians; brands only stripped."""
    df, seen = _observed(df)
    df = step.drop_missing(step.keep_domain(df, GRADE, GRADES), [NAME])
    if key in df.columns:
        df = first_per_key(_numbers_first(df, features, key, order_by), [key], order_by)
    columns = step.present(df, features)
    data, rows_read = _staged(step.parse_numbers(df, columns), seen, "batch")
    clipped = step.clip_outliers(data.frame, step.clip_bounds(data, columns), swap=False)
    out = step.fill_values(clipped, step.global_medians(data.derive(clipped), columns))
    out = step.add_label(step.parse_counts(out), drop_unknown=False)
    return Cleaned(step.default_texts(out, category=None, title=False), rows_read, data)
