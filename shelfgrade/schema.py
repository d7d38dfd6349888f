"""Schemas of the product table, the payloads and the registry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import NUTRIENTS, PRODUCT_COLUMNS

_CLEAN_TYPES = {
    **{c: T.DoubleType() for c in NUTRIENTS},
    "nutriscore_score": T.DoubleType(),
    "nova_group": T.IntegerType(),
    "additives_n": T.IntegerType(),
}


def clean_schema(label: bool = True) -> T.StructType:
    fields = [T.StructField(c, _CLEAN_TYPES.get(c, T.StringType())) for c in PRODUCT_COLUMNS]
    if label:
        fields.append(T.StructField("nutriscore_label", T.IntegerType()))
    return T.StructType(fields)


SEARCH_PAYLOAD = "products array<struct<" + ",".join(f"`{c}`:string" for c in PRODUCT_COLUMNS) + ">>"

PRODUCT_PAYLOAD = (
    "status int, status_verbose string, "
    "product struct<product_name:string, brands:string, categories:string, "
    "nutriscore_grade:string, image_url:string, ingredients_text:string, "
    "nutriments:struct<`energy-kcal_100g`:double, energy_100g:double, sugars_100g:double, "
    "salt_100g:double, proteins_100g:double>>"
)


def select_available(df: DataFrame, wanted) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[F.col(f"`{c}`") for c in wanted if c in df.columns])


def ensure_column(df: DataFrame, name: str, default) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(default))


def rename_coalesce(df: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rename many-to-one: each target takes the first non-null of its source columns."""
    taken = {s for sources in names.values() for s in sources}
    targets = {
        target: [s for s in sources if s in df.columns] for target, sources in names.items()
    }
    out, done = [], set()
    for column in df.columns:
        if column not in taken:
            out.append(F.col(f"`{column}`"))
            continue
        for target, present in targets.items():
            if column in present and target not in done:
                out.append(F.coalesce(*[F.col(f"`{s}`") for s in present]).alias(target))
                done.add(target)
    return df.select(*out)


def describe_schema(df: DataFrame, count_values: bool = False) -> DataFrame:
    """Column names and types as rows, on request with the number of values each column holds."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    schema = df.sparkSession.createDataFrame(rows, "column_name string, column_type string")
    if not count_values:
        return schema
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    long = counts.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column_name", "n_values")
    return schema.join(long, "column_name")
