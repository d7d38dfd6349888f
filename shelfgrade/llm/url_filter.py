"""URL rules by a sort-merge range join.

A rule (host, path) covers its host, all subdomains, and every path that starts with its path. Hosts
are written with their labels reversed (``org.example``), so that a host's rules and the URLs below
it share a key, and a rule's paths are one interval of the order by (key, path). The intervals of a
host are nested or apart. Each rule therefore carries the stack of the rules around it, and the rule
that starts last before a URL carries all that can be active there.

URLs (one row for each ancestor host) and rules are range-partitioned together by (key, path); one
sorted sweep per partition carries the last rule along, and a partition starts with the last rule of
the partitions before it. URLs have their row number as last sort key, so that equal URLs, however
many, spread over partitions; no rule is copied per URL and no hash key can be hot.

Defined results: a missing URL or one without ``://`` has an empty host and path; rows may repeat, and
each keeps its own result; a rule given twice counts once, and ``block`` wins over ``allow``; rules with
a missing or empty host cover nothing; of several rules the longest text (host and path) wins, then the
longer host; URLs without a rule take the default verdict. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfgrade.staging import release, stage

from .text import ascii_lower

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def reversed_labels(host: Column) -> Column:
    """``blog.example.org`` as ``[org, example, blog]``."""
    return F.reverse(F.split(host, r"\."))


def _with_stacks(rules: DataFrame) -> DataFrame:
    """Each distinct rule with the rules of its host around it, outermost first, itself last."""
    distinct = (
        rules.where(F.col("host") != "")
        .groupBy(
            F.array_join(reversed_labels(ascii_lower(F.col("host"))), ".").alias("key"),
            ascii_lower(F.col("host")).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
        )
        .agg(F.max("verdict").alias("verdict"))
    )
    around = distinct.select("key", F.col("path").alias("outer"), F.struct(F.length("path").alias("n"), "path", "host", "verdict").alias("rule"))
    prefixes = distinct.select(
        "key", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n")
    ).select("key", "path", F.expr("substring(path, 1, n)").alias("outer"))
    return prefixes.join(around, ["key", "outer"]).groupBy("key", "path").agg(F.sort_array(F.collect_list("rule")).alias("stack"))


def apply_rules(pages: DataFrame, rules: DataFrame, url: str = "url", keep=(), default: str = "allow") -> DataFrame:
    """``keep`` columns, host, path, rule and verdict of every row of ``pages``.

    ``rules`` has the columns host, path and verdict.
    """
    numbered = stage(
        pages.select(F.monotonically_increasing_id().alias("_row"), *keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")),
        "urls",
    ).frame
    stacks = stage(_with_stacks(rules), "rules")
    deepest = stacks.frame.agg(F.max(F.size(F.split("key", r"\.")))).first()[0] or 0

    starts = stacks.frame.select("key", "path", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("_row"), "stack")
    labels = reversed_labels(F.col("host"))
    # Only as many labels as a rule has can be a rule's host.
    ancestors = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda n: F.array_join(F.slice(labels, 1, n), ".")
    )
    asked = numbered.where((F.col("host") != "") & F.lit(deepest > 0)).select(
        F.explode(ancestors).alias("key"),
        "path",
        F.lit(1).alias("kind"),
        "_row",
        F.lit(None).cast(stacks.frame.schema["stack"].dataType).alias("stack"),
    )
    order = ["key", "path", "kind", "_row"]
    ranged = stage(starts.unionByName(asked).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sweep")
    release(pages.sparkSession, stacks.path)

    active = F.struct("key", "path", "stack")
    last_in = ranged.frame.groupBy("part").agg(F.max(F.when(F.col("kind") == 0, active)).alias("last"))
    # One row per partition of the sweep.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last_in.select("part", F.last("last", ignorenulls=True).over(before).alias("carried"))

    sweep = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = ranged.frame.join(carried, "part").withColumn(
        "top", F.coalesce(F.last(F.when(F.col("kind") == 0, active), ignorenulls=True).over(sweep), F.col("carried"))
    )
    fitting = F.filter("top.stack", lambda rule: F.col("path").startswith(rule["path"]))
    best = (
        swept.where((F.col("kind") == 1) & (F.col("top.key") == F.col("key")))
        .select("_row", F.try_element_at(fitting, F.lit(-1)).alias("hit"))
        .where(F.col("hit").isNotNull())
        .groupBy("_row")
        .agg(F.max(F.struct((F.length("hit.host") + F.length("hit.path")).alias("n"), F.length("hit.host").alias("m"), F.col("hit.verdict").alias("verdict"), F.concat("hit.host", "hit.path").alias("rule"))).alias("best"))
    )
    return numbered.join(best, "_row", "left").select(
        *keep, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
