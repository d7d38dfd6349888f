"""Text expressions, all JVM-side."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(f"`{c}`")


def strip(c) -> Column:
    """Remove all white space at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def normalize_grade(c) -> Column:
    return strip(F.lower(col(c).cast("string")))


def title_case(c) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others."""
    words = F.split(col(c), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(
        F.transform(
            words,
            lambda w: F.concat(
                F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**31 - 1))
            ),
        ),
        "",
    )


def text_default(c, default: str, title: bool = False) -> Column:
    """Stripped text, or the default where the value is missing."""
    cleaned = strip(c)
    return F.coalesce(title_case(cleaned) if title else cleaned, F.lit(default))


def first_category(c) -> Column:
    """First element of a comma list."""
    return strip(F.substring_index(col(c), ",", 1))


def contains(c, term) -> Column:
    """Case-insensitive literal substring match; ``%`` and ``_`` have no special meaning."""
    term = F.lower(term) if isinstance(term, Column) else F.lit(term.lower())
    return F.contains(F.lower(col(c)), term)


def contains_any(c, terms) -> Column:
    """True where any of the terms occurs, false where none does or the text is missing.

    Empty terms say nothing and are passed over; without a term nothing occurs.
    """
    # One pass with one alternation: a chain of contains() would lower-case the text per term.
    alternation = "|".join(re.escape(t.lower()) for t in terms if t)
    if not alternation:
        return F.lit(False)
    return F.coalesce(F.lower(col(c)), F.lit("")).rlike(alternation)


def query_words(c, limit: int = 4, longer_than: int = 3) -> Column:
    """First words of a message: long enough as written, punctuation removed at both ends."""
    words = F.filter(F.split(F.lower(col(c)), r"(?U)\s+"), lambda w: F.length(w) > longer_than)
    return F.slice(F.transform(words, lambda w: F.regexp_replace(w, r"^[?.,!]+|[?.,!]+$", "")), 1, limit)


def corpus_text(columns) -> Column:
    """Columns joined by one blank each, a missing value counting as empty text."""
    parts = []
    for i, c in enumerate(columns):
        if i:
            parts.append(F.lit(" "))
        parts.append(F.coalesce(col(c), F.lit("")))
    return strip(F.concat(*parts))


def first_matching(c, themes: dict[str, list[str]]) -> Column:
    """Name of the first theme, in declared order, with a keyword in the text; else null."""
    out = None
    for name, keywords in themes.items():
        hit = contains_any(c, keywords)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out
