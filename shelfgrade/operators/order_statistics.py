"""Exact quantiles and ranks that do not gather a group in one task.

One aggregate sketches all columns of all groups side by side. The sketch gives, for each wanted
rank, an interval of its values that should hold it, about one part in seventy of the rows; the counts
show whether it does, and an interval that misses its rank is an error, never a wrong value.
A second pass counts the rows below each interval and takes out those inside, folded by value: a
value that fills a third of the rows is one entry. These entries are range-partitioned, numbered by
the sums of the partitions before them, and the entry at the rank is picked from the partition that
holds it. There is one way for all sizes, its number of passes is constant, and no task holds more
than a range of the entries, however large a group is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col
from ..staging import Staged, scope, stage

_CELLS = 200


def staged_columns(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> Staged:
    """The grouping columns and the measures as doubles, NaN as null, written once."""
    measures = []
    for c in columns:
        value = col(c).cast("double")
        measures.append(F.when(~F.isnan(value), value).alias(c))
    return stage(df.select(*[col(b) for b in by], *measures), "measures")


def exact_quantiles(
    data: Staged,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """One row per group, one ``array<double>`` per column with the interpolated quantiles."""
    positions = [lambda n, p=p: F.lit(float(p)) * (n - 1) for p in probs]
    spark = data.frame.sparkSession
    with scope(spark) as keep:
        found = positioned_values(data.frame, columns, positions, by, accuracy)
        slots = [
            F.array(
                *[
                    F.max(F.when((F.col("measure") == c) & (F.col("target") == i), F.col("found")))
                    for i in range(len(probs))
                ]
            )
            for c in columns
        ]
        wide = found.groupBy(*[col(b) for b in by]).agg(
            *[
                # Like percentile, a column without values has no quantiles at all.
                F.when(~F.exists(slot, lambda v: v.isNull()), slot).alias(c)
                for c, slot in zip(columns, slots)
            ]
        )
        if by:
            groups = data.frame.select(*[col(b) for b in by]).distinct()
            same = [groups[b].eqNullSafe(wide[b]) for b in by]
            wide = groups.join(wide, same, "left").select(*[groups[b] for b in by], *[wide[c] for c in columns])
        return keep(stage(wide, "quantiles"))


def positioned_values(
    df: DataFrame,
    columns: Sequence[str],
    positions: Sequence[Callable[[Column], Column]],
    by: Sequence[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """Value at each 0-based position of the ordered non-null values of each group and column.

    A position is a function of the number of values and may be fractional (interpolated).
    Returns ``by..., measure, target, n, below, found``; ``below`` counts the values that lie
    strictly under the value at the position rounded down.
    """
    by, columns = list(by), list(columns)
    with scope(df.sparkSession) as keep:
        bounds = stage(_intervals(df, columns, positions, by, accuracy), "intervals")
        joined = _with_intervals(df, bounds, columns, len(positions), by)
        targets = bounds.frame.join(_below(joined, columns, len(positions), by), "_group").select(
            *[col(b) for b in by], "_group", F.inline("_targets"), "_below"
        )
        targets = stage(targets.withColumn("_below", F.get("_below", F.col("_slot"))).where("position >= 0 AND position <= n - 1"), "targets").frame
        picked = _pick(_entries(joined, columns, len(positions)), targets)
        names = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(i), F.lit(c))])
        out = picked.select(*[col(b) for b in by], names[F.col("_measure")].alias("measure"), "target", "n", "below", "found")
        return keep(stage(out, "positions"))


def _intervals(df: DataFrame, columns: list[str], positions, by: list[str], accuracy: int) -> DataFrame:
    """Per group a number, and all targets with their position and interval (lo, hi)."""
    cells = F.array(*[F.lit(i / _CELLS) for i in range(_CELLS + 1)])
    sketches = [
        F.struct(F.count(col(c)).alias("n"), F.percentile_approx(col(c).cast("double"), cells, accuracy).alias("grid")).alias(f"_sketch_{i}")
        for i, c in enumerate(columns)
    ]
    summary = df.groupBy(*[col(b) for b in by]).agg(*sketches)
    targets = []
    for i in range(len(columns)):
        n, grid = F.col(f"_sketch_{i}.n"), F.col(f"_sketch_{i}.grid")
        for t, position in enumerate(positions):
            at = position(n).cast("double")
            # One cell of margin on each side covers the error of the sketch.
            left = F.greatest(F.floor(F.floor(at) * _CELLS / n) - 1, F.lit(0)).cast("int")
            right = F.least(F.ceil((F.ceil(at) + 1) * _CELLS / n) + 1, F.lit(_CELLS)).cast("int")
            targets.append(
                F.struct(
                    F.lit(i * len(positions) + t).alias("_slot"),
                    F.lit(i).alias("_measure"),
                    F.lit(t).alias("target"),
                    n.alias("n"),
                    at.alias("position"),
                    F.when(n > 0, F.get(grid, left)).alias("lo"),
                    F.when(n > 0, F.get(grid, right)).alias("hi"),
                )
            )
    return summary.select(*[col(b) for b in by], F.monotonically_increasing_id().alias("_group"), F.array(*targets).alias("_targets"))


def _with_intervals(df: DataFrame, bounds: Staged, columns: list[str], n_targets: int, by: list[str]) -> DataFrame:
    """The measures with their group's intervals beside them: one table row per group, or constants."""
    slots = range(len(columns) * n_targets)
    if not by:
        row = bounds.frame.first()
        values = [(t["lo"], t["hi"]) for t in row["_targets"]] if row is not None else [(None, None)] * len(slots)
        limits = [x for s in slots for x in (F.lit(values[s][0]).cast("double").alias(f"_lo_{s}"), F.lit(values[s][1]).cast("double").alias(f"_hi_{s}"))]
        return df.select(F.lit(row["_group"] if row is not None else 0).alias("_group"), *[col(c).cast("double").alias(f"_value_{i}") for i, c in enumerate(columns)], *limits)
    limits = [x for s in slots for x in (F.col("_targets")[s]["lo"].alias(f"_lo_{s}"), F.col("_targets")[s]["hi"].alias(f"_hi_{s}"))]
    named = bounds.frame.select(*[col(b).alias(f"_by_{k}") for k, b in enumerate(by)], "_group", *limits)
    same = [col(b).eqNullSafe(F.col(f"_by_{k}")) for k, b in enumerate(by)]
    return df.join(named, same).select(
        "_group", *[col(c).cast("double").alias(f"_value_{i}") for i, c in enumerate(columns)], *[f"_{side}_{s}" for s in slots for side in ("lo", "hi")]
    )


def _below(joined: DataFrame, columns: list[str], n_targets: int, by: list[str]) -> DataFrame:
    """Per group how many values lie under each interval."""
    counts = [F.count_if(F.col(f"_value_{s // n_targets}") < F.col(f"_lo_{s}")) for s in range(len(columns) * n_targets)]
    return joined.groupBy("_group").agg(F.array(*counts).alias("_below"))


def _entries(joined: DataFrame, columns: list[str], n_targets: int) -> DataFrame:
    """The values inside the intervals and how often each occurs."""
    inside = []
    for s in range(len(columns) * n_targets):
        value = F.col(f"_value_{s // n_targets}")
        inside.append(F.when(value.between(F.col(f"_lo_{s}"), F.col(f"_hi_{s}")), F.struct(F.lit(s).alias("_slot"), value.alias("value"))))
    held = joined.select("_group", F.inline(F.array_compact(F.array(*inside))))
    return held.groupBy("_group", "_slot", "value").agg(F.count("*").alias("times"))


def _pick(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets with the value at their position and the number of values under it."""
    key = ["_group", "_slot"]
    ranged = stage(entries.repartitionByRange(*key, "value").withColumn("_part", F.spark_partition_id()), "entries").frame
    sums = ranged.groupBy(*key, "_part").agg(F.sum("times").alias("_held"))
    before = F.sum("_held").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.withColumn("_before", F.coalesce(before, F.lit(0)))
    low, high, start = F.floor("position"), F.ceil("position"), F.col("_below") + F.col("_before")
    # A position and the next one lie in two partitions at most; the entries of no other one are searched.
    wanted = offsets.join(targets.select(*key, "position", "_below"), key).where((start <= high) & (start + F.col("_held") > low))
    within = F.sum("times").over(Window.partitionBy("_part", *key).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    counted = ranged.withColumn("_within", within).join(wanted, ["_part", *key])
    upto = start + F.col("_within")
    at = lambda place: (upto > place) & (upto - F.col("times") <= place)
    found = (
        counted.where(at(low) | at(high))
        .groupBy(*key)
        .agg(
            F.min(F.when(at(low), F.col("value"))).alias("_low"),
            F.min(F.when(at(high), F.col("value"))).alias("_high"),
            F.min(F.when(at(low), upto - F.col("times"))).alias("below"),
        )
    )
    part = F.col("position") - low
    missed = F.col("_low").isNull() | F.col("_high").isNull()
    value = F.col("_low") + (F.col("_high") - F.col("_low")) * part
    wrong = F.raise_error(F.concat(F.lit("the sketch's interval does not hold position "), F.col("position").cast("string")))
    return targets.join(found, key, "left").withColumn("found", F.when(missed, wrong).otherwise(value))
