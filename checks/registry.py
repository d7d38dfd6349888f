"""Where queries register themselves with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgrade.plans.views import PRODUCTS, RAW, ROW

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WITH_PRODUCTS = f"WITH products AS ({PRODUCTS})\n"
WITH_RAW = f"WITH products AS ({PRODUCTS}), raw AS ({RAW})\n"
ORDER = ", ".join(ROW)

# A second catalogue whose searchable text is long.
DOC_CATALOGUE = """
SELECT doc_id, concat('Doc ', doc_id) AS product_name, source AS brands, text AS body,
       CASE WHEN n_chars < 200 THEN 'a' WHEN n_chars < 600 THEN 'b' WHEN n_chars < 1500 THEN 'c'
            WHEN n_chars < 4000 THEN 'd' ELSE 'e' END AS nutriscore_grade,
       CAST(n_chars AS DOUBLE) AS energy_100g, n_chars / 8 AS sugars_100g, n_chars / 16 AS salt_100g,
       n_chars / 4 AS fat_100g, CASE WHEN lang <> 'en' THEN n_chars / 2 END AS proteins_100g,
       length(lang) AS additives_n
FROM documents
"""


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})
