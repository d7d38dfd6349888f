"""Counts, shares, distributions and descriptive statistics."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import GRADES
from ..functions.text import col, first_category
from ..staging import stage
from .order_statistics import exact_quantiles, staged_columns


def value_counts(df: DataFrame, column: str, keep_null: bool = False) -> DataFrame:
    kept = df if keep_null else df.where(col(column).isNotNull())
    return kept.groupBy(col(column)).agg(F.count(F.lit(1)).alias("n"))


def domain_counts(df: DataFrame, column: str = "nutriscore_grade", domain: Sequence[str] = GRADES) -> DataFrame:
    """Rows and percent per value of a fixed domain; absent values count zero."""
    values = df.sparkSession.createDataFrame([(v,) for v in domain], f"`{column}` string")
    counts = value_counts(df, column)
    full = values.join(counts, column, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    # A window over one row per value of the domain.
    total = F.greatest(F.sum("n").over(Window.partitionBy(F.lit(1))), F.lit(1))
    return full.withColumn("percent", F.col("n") * F.lit(100.0) / total)


def summary(df: DataFrame, brand="brands", category="categories_en", means: dict[str, str] | None = None, approximate: bool = False) -> DataFrame:
    """One row: rows, distinct brands and categories, means rounded to two digits."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    means = means or {"avg_additives": "additives_n", "avg_sugar": "sugars_100g", "avg_salt": "salt_100g"}
    aggregates = [F.count(F.lit(1)).alias("n_products")]
    for name, column in (("n_brands", brand), ("n_categories", category)):
        aggregates.append(
            distinct(col(column)).alias(name) if column in df.columns else F.lit(0).cast("long").alias(name)
        )
    for name, column in means.items():
        aggregates.append(
            F.round(F.avg(col(column)), 2).alias(name) if column in df.columns else F.lit(0.0).alias(name)
        )
    return df.agg(*aggregates)


def distributions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value counts of several columns at once: ``column_name, value, n``; one pass."""
    held = [c for c in columns if c in df.columns]
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), col(c).cast("string").alias("value")) for c in held]))
    )
    return long.where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def kpis(df: DataFrame, grade="nutriscore_grade", good=GRADES[:2], sugar="sugars_100g", additives="additives_n", sugar_scale: float = 50.0, additive_scale: float = 10.0) -> DataFrame:
    """One row: share of good grades, means, and means as capped percent of a scale."""
    base = df.agg(
        F.count(F.lit(1)).alias("n_products"),
        (F.lit(100.0) * F.count_if(col(grade).isin(*good)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("pct_good"),
        F.avg(col(sugar)).alias("avg_sugar"),
        F.avg(col(additives)).alias("avg_additives"),
    )
    return base.withColumns(
        {
            "sugar_progress": F.least(F.col("avg_sugar") / sugar_scale * 100, F.lit(100.0)),
            "additives_progress": F.least(F.col("avg_additives") / additive_scale * 100, F.lit(100.0)),
        }
    )


def top_counts(df: DataFrame, column: str, k: int, count: str = "n") -> DataFrame:
    """The k most frequent values; ties by value."""
    return (
        value_counts(df, column).withColumnRenamed("n", count).orderBy(F.desc(count), col(column).asc()).limit(k)
    )


def top_categories(df: DataFrame, label: str = "nutriscore_label", category: str = "categories_en", k: int = 10) -> DataFrame:
    """Mean label of the k most frequent main categories, ranked with the best mean first; one aggregation."""
    main = first_category(category).alias("category")
    means = (
        df.select(main, col(label).alias("_label"))
        .where("category IS NOT NULL")
        .groupBy("category")
        .agg(F.avg("_label").alias("avg_label"), F.count(F.lit(1)).alias("n"))
    )
    frequent = means.orderBy(F.desc("n"), "category").limit(k)
    # A window over k rows.
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("avg_label", "category"))
    return frequent.withColumn("rank", place).orderBy("rank")


# Correlations per aggregate row: their buffers stay under the width Spark compiles.
_PAIRS_PER_ROW = 15


def correlations(df: DataFrame, columns: Sequence[str], lower_triangle: bool = False) -> DataFrame:
    """Pearson correlations over the rows where both values exist, rounded to two digits; one scan.

    The pairs are dealt to a few rows per input row, each folded at once by a compiled partial
    aggregate; one aggregate with a column per pair would be too wide to compile.
    """
    held = [c for c in columns if c in df.columns]
    pairs = list(combinations(held, 2) if lower_triangle else combinations_with_replacement(held, 2))
    decks = [pairs[i : i + _PAIRS_PER_ROW] for i in range(0, len(pairs), _PAIRS_PER_ROW)]
    slots = range(max(len(d) for d in decks))
    nothing = F.lit(None).cast("double")
    rows = []
    for number, deck in enumerate(decks):
        values = []
        for i in slots:
            x, y = [col(c).cast("double") for c in deck[i]] if i < len(deck) else (nothing, nothing)
            values += [x.alias(f"x{i}"), y.alias(f"y{i}")]
        rows.append(F.struct(F.lit(number).alias("deck"), *values))
    folded = (
        df.select(F.inline(F.array(*rows))).groupBy("deck").agg(*[F.corr(f"x{i}", f"y{i}").alias(f"r{i}") for i in slots])
    )
    cells = [
        F.struct(F.lit(n).alias("of"), F.lit(b).alias("column_1"), F.lit(a).alias("column_2"), F.round(f"r{i}", 2).alias("correlation"))
        for n, deck in enumerate(decks)
        for i, (a, b) in enumerate(deck)
    ]
    one = folded.select("deck", F.inline(F.array(*cells))).where("deck = of").drop("deck", "of")
    if lower_triangle:
        return one
    both = F.array(F.struct("column_1", "column_2"), F.struct(F.col("column_2").alias("column_1"), F.col("column_1").alias("column_2")))
    sides = F.when(F.col("column_1") == F.col("column_2"), F.slice(both, 1, 1)).otherwise(both)
    return one.select(F.inline(sides), "correlation")


def describe(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Per column count, mean, sample deviation, minimum, exact quartiles and maximum."""
    held = [c for c in columns if c in df.columns]
    data = staged_columns(df, held)
    basic = data.frame.agg(
        *[
            F.struct(
                F.count(col(c)).alias("count"),
                F.avg(col(c)).alias("mean"),
                F.stddev_samp(col(c)).alias("std"),
                F.min(col(c)).alias("min"),
                F.max(col(c)).alias("max"),
            ).alias(c)
            for c in held
        ]
    ).first()
    quartiles = exact_quantiles(data, held, [0.25, 0.5, 0.75]).first()
    rows = []
    for c in held:
        q = (quartiles[c] if quartiles is not None else None) or [None] * 3
        b = basic[c]
        rows.append((c, b["count"], b["mean"], b["std"], b["min"], *q, b["max"]))
    table = df.sparkSession.createDataFrame(
        rows, "column_name string, `count` long, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
    )
    return table.withColumns({c: F.round(c, digits) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")})


def box_statistics(df: DataFrame, by: str, columns: Sequence[str], fence: float = 1.5) -> DataFrame:
    """Per group and column the quartiles and the whiskers: the outermost values within the fences."""
    columns = list(columns)
    data = staged_columns(df.where(col(by).isNotNull()), columns, [by])
    quartiles = exact_quantiles(data, columns, [0.25, 0.5, 0.75], [by])
    boxes = stage(quartiles.select(col(by).alias("_group"), *[col(c).alias(f"_{c}") for c in columns]), "quartiles").frame
    joined = data.frame.join(boxes, col(by) == F.col("_group"))
    aggregates = []
    for c in columns:
        q1, q3 = F.get(col(f"_{c}"), F.lit(0)), F.get(col(f"_{c}"), F.lit(2))
        reach = (q3 - q1) * fence
        inside = F.when((col(c) >= q1 - reach) & (col(c) <= q3 + reach), col(c))
        aggregates.append(
            F.struct(
                F.lit(c).alias("measure"),
                F.min(inside).alias("whisker_low"),
                F.any_value(q1).alias("q1"),
                F.any_value(F.get(col(f"_{c}"), F.lit(1))).alias("median"),
                F.any_value(q3).alias("q3"),
                F.max(inside).alias("whisker_high"),
            ).alias(f"_box_{c}")
        )
    stats = joined.groupBy(col(by)).agg(*aggregates)
    return stats.select(col(by), F.inline(F.array(*[col(f"_box_{c}") for c in columns])))


def null_counts(df: DataFrame) -> DataFrame:
    """Columns with missing values and how many."""
    one = df.agg(*[F.count_if(col(c).isNull()).alias(c) for c in df.columns])
    return one.unpivot([], [col(c) for c in df.columns], "column_name", "n_null").where("n_null > 0")


def top_by(df: DataFrame, measure: str, columns: Sequence[str], k: int = 10, tie_break: Sequence[str] = ()) -> DataFrame:
    """The k rows with the largest values; missing values last."""
    order = [col(measure).desc_nulls_last(), *[col(t).asc_nulls_last() for t in tie_break]]
    return df.orderBy(*order).limit(k).select(*[col(c) for c in columns])


def distinct_categories(df: DataFrame, category: str = "categories_en", k: int = 80) -> DataFrame:
    """The first k main categories in alphabetical order."""
    return (
        df.select(first_category(category).alias("category")).where("category IS NOT NULL").distinct().orderBy("category").limit(k)
    )


def table_count(spark, table: str) -> int:
    """Rows of a table, 0 if there is no such table."""
    return spark.table(table).count() if spark.catalog.tableExists(table) else 0
