"""JSON documents of the product service, landed as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import GRADES
from ..functions.text import col
from ..schema import PRODUCT_PAYLOAD, SEARCH_PAYLOAD


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Landed documents, one per file or one per line, as column ``payload``."""
    return spark.read.text(path, wholetext=not lines).withColumnRenamed("value", "payload")


def search_rows(documents: DataFrame, payload: str = "payload", schema: str = SEARCH_PAYLOAD) -> DataFrame:
    """One row per product of each search response; an empty response gives none."""
    kept = [c for c in documents.columns if c != payload]
    parsed = documents.withColumn("parsed", F.from_json(payload, schema))
    return parsed.select(*kept, F.explode("parsed.products").alias("p")).select(*kept, "p.*")


def product_rows(
    documents: DataFrame, payload: str = "payload", schema: str = PRODUCT_PAYLOAD, grades=GRADES
) -> DataFrame:
    """The product of each found response, nutrients flattened.

    Energy is the kilocalorie figure, or the general one where that is missing or zero.
    """
    kept = [c for c in documents.columns if c != payload]
    found = documents.withColumn("parsed", F.from_json(payload, schema)).where(
        "parsed.status = 1 AND parsed.product IS NOT NULL"
    )
    # An empty object parses to a struct of nulls, which is "not found" as well.
    anything = F.coalesce(*[F.col(f"p.{c}").cast("string") for c in _fields(schema) if c != "nutriments"])
    grade = F.lower(F.col("p.nutriscore_grade"))
    kcal = F.col("p.nutriments.`energy-kcal_100g`")

    def nutrient(name):
        return F.coalesce(F.col(f"p.nutriments.{name}"), F.lit(0.0))

    return (
        found.select(*kept, F.col("parsed.product").alias("p"))
        .where(anything.isNotNull() | F.col("p.nutriments").isNotNull())
        .select(
            *kept,
            F.col("p.product_name").alias("product_name"),
            F.col("p.brands").alias("brands"),
            F.col("p.categories").alias("categories_en"),
            F.when(grade.isin(*grades), grade).otherwise(F.lit("?")).alias("nutriscore_grade"),
            F.col("p.image_url").alias("image_url"),
            F.col("p.ingredients_text").alias("ingredients_text"),
            F.coalesce(F.nullif(kcal, F.lit(0.0)), F.col("p.nutriments.energy_100g"), F.lit(0.0)).alias(
                "energy_100g"
            ),
            nutrient("sugars_100g").alias("sugars_100g"),
            nutrient("salt_100g").alias("salt_100g"),
            nutrient("proteins_100g").alias("proteins_100g"),
        )
    )


def _fields(schema: str) -> list[str]:
    from pyspark.sql import types as T

    return T.StructType.fromDDL(schema)["product"].dataType.fieldNames()


def to_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """One JSON object per row in ``value``; nulls and NaN are written as JSON null."""
    columns = []
    for field in df.schema.fields:
        c = col(field.name)
        if field.dataType.typeName() in ("double", "float"):
            c = F.when(~F.isnan(c), c).alias(field.name)
        columns.append(c)
    value = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value")
    return df.select(*([col(key).cast("string").alias("key")] if key else []), value)


def from_messages(messages: DataFrame, schema: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Parsed rows, and apart from them the messages that are no such JSON object."""
    kept = [c for c in messages.columns if c != value]
    parsed = messages.withColumn(
        "parsed",
        F.from_json(
            col(value).cast("string"),
            f"{schema}, _corrupt_record string",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
        ),
    )
    bad = F.col("parsed").isNull() | F.col("parsed._corrupt_record").isNotNull()
    good = parsed.where(~bad).select(*kept, "parsed.*").drop("_corrupt_record")
    return good, parsed.where(bad).select(*kept, value)
