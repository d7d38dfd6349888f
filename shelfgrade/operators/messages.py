"""Routing conversations: last question, theme, matching products, context text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CONTEXT_WORDS, GRADE_DESCRIPTIONS, THEMES, UNKNOWN_BRAND
from ..functions.grades import describe_grade
from ..functions.numeric import zero_if_missing
from ..functions.text import col, first_matching, query_words
from ..staging import scope, stage
from .dedup import top_rows
from .statistics import value_counts
from .substring_join import match_words, needle_table

SHOWN = (
    "product_name", "brands", "nutriscore_grade", "energy_100g", "sugars_100g", "salt_100g",
    "fat_100g", "proteins_100g", "additives_n",
)


def last_user_message(turns: DataFrame, conversation="conv_id", turn="turn", role="role", text="text", asker="user") -> DataFrame:
    """One row per conversation with the user's last message, empty if there is none."""
    asked = col(role) == asker
    return turns.groupBy(col(conversation)).agg(
        F.coalesce(F.max_by(F.when(asked, col(text)), F.when(asked, col(turn))), F.lit("")).alias("message")
    )


def keyword_hits(words: DataFrame, products: DataFrame, tie_break: Sequence[str], name="product_name", brand="brands", grade="nutriscore_grade", shown: Sequence[str] = SHOWN, n: int = 3) -> DataFrame:
    """The n best-graded products per word whose name or brand contains it: ``word, place, ...``.

    Every word of the names and brands keeps its n best rows, taken in the map tasks first. The
    asked words are matched with this vocabulary only, and the short lists of the matched words are
    merged: a product among the n best of all is among the n best of one of its own words. The lists
    hold the grade and the ``tie_break`` columns, which tell products apart; the other columns are
    fetched for the final rows.
    """
    order = [col(grade).asc_nulls_last(), *[col(t).asc_nulls_last() for t in tie_break]]
    kept = list(dict.fromkeys([*shown, grade, *tie_break]))
    ranked_by = list(dict.fromkeys([grade, *tie_break]))
    split = lambda c: F.split(F.lower(F.coalesce(col(c), F.lit(""))), r"\s+")
    held = products.select(*[col(c) for c in ranked_by], F.explode(F.array_distinct(F.concat(split(name), split(brand)))).alias("_word"))
    lists = stage(top_rows(held.where("_word <> ''"), ["_word"], order, n), "lists").frame
    needles = needle_table(words, "word").frame
    matched = match_words(needles.where("needle <> ''"), lists.select(F.col("_word").alias("word")).distinct())
    # At most n rows a word in the lists, and a word is matched by its own parts only: nothing is hot.
    offered = lists.join(matched.select(F.col("word").alias("_word"), F.col("needle").alias("word")), "_word").drop("_word")
    # A common word is part of much of the vocabulary and each of its lists, so every task keeps its n best products
    # of a word before anything is shuffled; a product comes from several words and counts once.
    near = F.dense_rank().over(Window.partitionBy("word").orderBy(*order))
    offered = offered.withColumn("_near", near).where(F.col("_near") <= n).drop("_near")
    best = stage(top_rows(offered.dropDuplicates(["word", *tie_break]), ["word"], order, n, "place"), "best").frame
    hits = _fetched(best, products, ranked_by, kept)
    if not needles.where("needle = ''").isEmpty():
        # A word of punctuation only is empty after stripping and matches everything.
        everything = products.where(col(name).isNotNull() | col(brand).isNotNull()).select(F.lit("").alias("word"), *[col(c) for c in kept])
        hits = hits.unionByName(top_rows(everything, ["word"], order, n, "place"))
    return hits


def _fetched(best: DataFrame, products: DataFrame, by: list[str], kept: list[str]) -> DataFrame:
    """``word, place`` of the ranked rows with all ``kept`` columns of their product; ``by`` tells products apart."""
    rest = [c for c in kept if c not in by]
    if not rest:
        return best.select("word", *[col(c) for c in kept], "place")
    shown = products.select(*[col(c).alias(f"_by_{i}") for i, c in enumerate(by)], *[col(c) for c in rest])
    asked = best.select(*[col(c).alias(f"_by_{i}") for i, c in enumerate(by)]).distinct()
    same = lambda left, right: [left[f"_by_{i}"].eqNullSafe(right[f"_by_{i}"]) for i in range(len(by))]
    # Written, so that what reads the hits reads the few rows that were found and not the products again.
    one = stage(shown.join(asked, same(shown, asked), "left_semi").dropDuplicates([f"_by_{i}" for i in range(len(by))]), "shown").frame
    marked = best.select("word", "place", *[col(c).alias(f"_by_{i}") for i, c in enumerate(by)])
    back = {c: one[f"_by_{i}"] for i, c in enumerate(by)}
    return marked.join(one, same(marked, one)).select("word", *[back[c].alias(c) if c in back else one[f"`{c}`"] for c in kept], "place")


def message_products(messages: DataFrame, products: DataFrame, tie_break: Sequence[str], key="conv_id", message="message", name="product_name", n: int = 3, **columns) -> DataFrame:
    """Products named by the first words of each message, one row per name, in word order."""
    words = messages.select(col(key), F.posexplode(query_words(message)).alias("_word_at", "word"))
    with scope(messages.sparkSession) as keep:
        hits = keep(stage(keyword_hits(words, products, tie_break, name=name, n=n, **columns), "hits"))
    found = words.join(hits, "word")
    order = [F.col("_word_at"), F.col("place")]
    first = top_rows(found, [key, name], order, 1)
    # At most four words with n products each, so a conversation is a few rows here.
    return first.withColumn("position", F.row_number().over(Window.partitionBy(col(key)).orderBy(*order))).drop("_word_at", "place")


def theme_route(messages: DataFrame, message="message", themes=THEMES) -> DataFrame:
    """Adds the first theme, in declared order, with a keyword in the message."""
    return messages.withColumn("theme", first_matching(message, themes))


def advice(grade) -> Column:
    grade = F.lower(F.coalesce(col(grade), F.lit("e")))
    return F.when(grade.isin("a", "b"), "good").when(grade == "c", "moderate").otherwise("poor")


def reply_route(messages: DataFrame, found: DataFrame, key="conv_id", message="message", grade="nutriscore_grade", themes=THEMES) -> DataFrame:
    """What kind of reply a conversation gets: products found, else a theme, else the generic one."""
    first = found.groupBy(col(key)).agg(
        F.count(F.lit(1)).alias("n_products"), F.min_by(F.struct(col(grade).alias("g")), "position").alias("_first")
    )
    joined = theme_route(messages, message, themes).join(first, key, "left")
    any_found = F.coalesce(F.col("n_products"), F.lit(0)) > 0
    return joined.select(
        col(key),
        F.when(any_found, "products").when(F.col("theme").isNotNull(), "theme").otherwise("generic").alias("reply"),
        F.when(~any_found, F.col("theme")).alias("theme"),
        F.when(any_found, advice(F.col("_first.g"))).alias("advice"),
        F.coalesce(F.col("n_products"), F.lit(0)).cast("long").alias("n_products"),
    )


def _fixed(c, digits: int) -> Column:
    """Fixed decimals, halves to even."""
    return F.format_string(f"%.{digits}f", F.bround(zero_if_missing(c), digits))


def product_line(descriptions=GRADE_DESCRIPTIONS, words=CONTEXT_WORDS) -> Column:
    """A product as two lines of text; ``words`` are the fixed texts between the figures."""
    grade = col("nutriscore_grade")
    parts = [
        words["item"], F.coalesce(col("product_name"), F.lit("None")),
        " (", F.coalesce(F.nullif(col("brands"), F.lit("")), F.lit(UNKNOWN_BRAND)),
        words["grade"], F.upper(F.coalesce(grade, F.lit("?"))),
        " (", describe_grade(grade, descriptions, ""), ")\n",
    ]
    for measure, digits, label, unit in words["figures"]:
        parts += [label, _fixed(measure, digits), unit]
    parts += [words["additives"], zero_if_missing("additives_n").cast("int").cast("string"), "\n"]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def catalogue_line(products: DataFrame, grade="nutriscore_grade", title: str = "CATALOGUE", words=CONTEXT_WORDS) -> DataFrame:
    """One row with the size of the table and its grade distribution as text."""
    counts = value_counts(products, grade, keep_null=True)
    entry = F.when(
        F.length(col(grade)) > 0,
        F.struct(col(grade).alias("g"), F.concat(F.upper(col(grade)), F.lit(":"), F.format_number("n", 0)).alias("t")),
    )
    # One entry per grade.
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["t"]), " | ")
    return counts.agg(
        F.concat(F.lit(f"{title} : "), F.format_number(F.coalesce(F.sum("n"), F.lit(0)), 0), F.lit(words["size"]), parts, F.lit("\n")).alias("header")
    )


def context_blocks(messages: DataFrame, found: DataFrame, products: DataFrame, key="conv_id", title: str = "CATALOGUE") -> DataFrame:
    """Per conversation the catalogue line and the products its last message names."""
    header = catalogue_line(products, title=title).first()["header"]
    lines = found.groupBy(col(key)).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("position", product_line().alias("line")))), lambda e: e["line"]), ""
        ).alias("_lines")
    )
    listed = F.concat(F.lit(CONTEXT_WORDS["found"]), F.col("_lines"))
    return messages.select(col(key)).join(lines, key, "left").select(
        col(key), F.concat(F.lit(header), F.coalesce(listed, F.lit(""))).alias("context")
    )
