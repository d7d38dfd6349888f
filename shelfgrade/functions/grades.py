"""Grades: label, description, position, order."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import GRADE_DESCRIPTIONS, GRADE_LABELS, GRADES, UNKNOWN_GRADE
from .text import col


def lookup(c, mapping: dict) -> Column:
    """Value of a literal map; an unknown key gives null."""
    pairs = chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items())
    return F.create_map(*pairs)[col(c)]


def grade_label(c, labels: dict[str, int] = GRADE_LABELS) -> Column:
    return lookup(c, labels).cast("int")


def label_grade(c, labels: dict[str, int] = GRADE_LABELS) -> Column:
    return lookup(col(c).cast("int"), {v: k for k, v in labels.items()})


def grade_position(c, labels: dict[str, int] = GRADE_LABELS) -> Column:
    """Place on the scale, 0 for the best grade and 1 for the worst."""
    return grade_label(c, labels) / F.lit(float(max(labels.values())))


def describe_grade(c, descriptions: dict[str, str] = GRADE_DESCRIPTIONS, default: str = UNKNOWN_GRADE) -> Column:
    return F.coalesce(lookup(c, descriptions), F.lit(default))


def own_grade(c, grades=GRADES) -> Column:
    """The grade used to look for better ones; an unknown grade counts as the worst."""
    grade = F.lower(col(c))
    return F.when(grade.isin(*grades), grade).otherwise(F.lit(grades[-1]))
