"""Column expressions that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

# A word: a run of letters and digits; everything beyond ASCII counts as a letter. Of lower-cased text this is
# `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`. Java tests a character against each range of such a class in turn, but looks up
# characters that are listed one by one, which is several times faster.
WORD = f"[{string.digits}{string.ascii_lowercase}\\x80-\\x{{10FFFF}}]+"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """The lower-cased words of a text; a missing text has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def hex_bits(digest: Column, n: int = 60) -> Column:
    """The first ``n`` (up to 60) bits of a hexadecimal digest as a number."""
    return F.shiftright(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), 60 - n)


def bit_text(value: Column, n: Column) -> Column:
    """A number as ``n`` binary digits; no digits for ``n`` = 0."""
    return F.when(n == 0, F.lit("")).otherwise(F.lpad(F.bin(value), n, "0"))
