"""Product tables in files: delimited dumps, cleaned CSV, Parquet."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import PRODUCT_COLUMNS, REGION_SOURCE_NAMES, SOURCE_NAMES
from ..schema import clean_schema, rename_coalesce, select_available

_SPARE = "_one_field_too_many"


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Column names of a delimited file, read from its first line only."""
    return spark.read.option("sep", sep).option("header", True).csv(path).columns


def scan_delimited(
    spark: SparkSession,
    path: str,
    sep: str = "\t",
    wanted: Sequence[str] | None = PRODUCT_COLUMNS,
    names: dict[str, tuple[str, ...]] = SOURCE_NAMES,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """A dump as strings: known columns only, lines with too many fields skipped.

    Lines that end early are kept, their last columns null. ``columns`` names the columns of
    the file in order and saves reading its header.
    """
    columns = list(columns or _header(spark, path, sep))
    # The first spare column catches a field too many. The second is never read, so that Spark
    # always picks columns by position and does not report every regular line as too short.
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, _SPARE, _SPARE + "_2"]])
    df = (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("encoding", "UTF-8")
        .csv(path)
        .where(F.col(_SPARE).isNull())
        .drop(_SPARE, _SPARE + "_2")
    )
    df = rename_coalesce(df, names)
    return df if wanted is None else select_available(df, wanted)


def scan_region(spark: SparkSession, path: str, sep: str = "\t", **options) -> DataFrame:
    """The regional dump: energy may come in two columns, of which kilocalories win."""
    return scan_delimited(spark, path, sep, names=REGION_SOURCE_NAMES, **options)


def with_ingest_order(df: DataFrame) -> DataFrame:
    """Columns that order rows as they stand in the files, for first-wins rules.

    The file name and the start of the split come from the reader; the id rises within a split.
    """
    return df.withColumns(
        {
            "ingest_file": F.col("_metadata.file_path"),
            "ingest_block": F.col("_metadata.file_block_start"),
            "ingest_row": F.monotonically_increasing_id(),
        }
    )


def scan_clean(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The cleaned table with its declared types; codes keep their leading zeros."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    declared = {f.name: f for f in clean_schema().fields}
    columns = _header(spark, path, ",")
    schema = T.StructType([declared.get(c, T.StructField(c, T.StringType())) for c in columns])
    return spark.read.schema(schema).option("header", True).option("escape", '"').option(
        "multiLine", False
    ).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def first_available(
    spark: SparkSession, candidates: Sequence[tuple[str, str, Callable[[SparkSession, str], DataFrame]]]
) -> tuple[str, DataFrame]:
    """The first source whose path exists, as (name, table): clean table, dump, raw file, payloads."""
    for name, path, read in candidates:
        if exists(spark, path):
            return name, read(spark, path)
    raise FileNotFoundError(", ".join(path for _, path, _ in candidates))
