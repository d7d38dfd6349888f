"""Stand-in product tables derived from order lines and parts, as SQL both engines run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Columns that identify a row and order it.
ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]

PRODUCTS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
       concat(l_orderkey, '-', l_linenumber) AS code,
       p_name AS product_name,
       p_brand AS brands,
       CASE WHEN l_linenumber <> 6 THEN concat(p_type, ', ', p_name) END AS categories_en,
       CASE l_returnflag WHEN 'A' THEN 'France' WHEN 'R' THEN 'Belgium,Canada' ELSE 'Germany' END AS countries_en,
       concat(p_name, ' ', lower(p_type)) AS ingredients_text,
       substr('abcde', CAST(floor((p_size - 1) / 10) AS INT) + 1, 1) AS nutriscore_grade,
       least(l_linenumber, 4) AS nova_group,
       CASE WHEN l_linenumber <> 7 THEN l_extendedprice END AS energy_100g,
       l_quantity AS fat_100g,
       l_quantity / 4 AS saturated_fat_100g,
       l_extendedprice / 1000 AS carbohydrates_100g,
       l_discount * 100 AS sugars_100g,
       CASE WHEN l_linenumber <> 3 THEN l_quantity / 5 END AS fiber_100g,
       p_retailprice / 100 AS proteins_100g,
       l_tax * 10 AS salt_100g,
       l_linenumber - 1 AS additives_n
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

# The same as an untidy dump: strings, missing names, odd grades, values that are no numbers.
RAW = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, code,
       CASE WHEN l_linenumber <> 2 OR nova_group <> 3 OR salt_100g > 0 THEN product_name END AS product_name,
       CASE WHEN l_linenumber <> 4 THEN concat(' ', lower(brands), ' x2y ') END AS brands,
       categories_en, countries_en, ingredients_text,
       CASE WHEN l_linenumber = 5 THEN concat(' ', upper(nutriscore_grade), ' ')
            WHEN l_linenumber = 1 AND salt_100g = 0 THEN 'unknown'
            ELSE nutriscore_grade END AS nutriscore_grade,
       CAST(energy_100g AS STRING) AS energy_100g,
       CASE WHEN l_linenumber = 2 THEN 'abc' ELSE CAST(fat_100g AS STRING) END AS fat_100g,
       CASE WHEN nutriscore_grade = 'e' THEN 'n/a' ELSE CAST(saturated_fat_100g AS STRING) END AS saturated_fat_100g,
       concat(' ', CAST(carbohydrates_100g AS STRING), ' ') AS carbohydrates_100g,
       CASE WHEN l_linenumber = 6 THEN 'NaN' ELSE CAST(sugars_100g AS STRING) END AS sugars_100g,
       CAST(fiber_100g AS STRING) AS fiber_100g,
       CAST(fat_100g / 4 - 3 AS STRING) AS proteins_100g,
       CAST(salt_100g AS STRING) AS salt_100g,
       CASE WHEN l_linenumber = 7 THEN 'x' ELSE concat(CAST(additives_n AS STRING), '.7') END AS additives_n
FROM ({PRODUCTS}) AS products
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def products(spark: SparkSession, folder: str) -> DataFrame:
    return _derived(spark, folder, PRODUCTS)


def raw_products(spark: SparkSession, folder: str) -> DataFrame:
    return _derived(spark, folder, RAW)


def _derived(spark: SparkSession, folder: str, text: str) -> DataFrame:
    return select(spark, folder, text, ("lineitem", "part"))


def select(spark: SparkSession, folder: str, text: str, tables) -> DataFrame:
    """Answer of a query over the folder's tables; no view of the session is made or replaced."""
    for name in tables:
        text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}} AS {name}", text)
    return spark.sql(text, **{name: table(spark, folder, name) for name in tables})
