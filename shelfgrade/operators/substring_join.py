"""Join on "text contains needle" without comparing every pair.

A needle without white space lies within one word, so it is compared with the distinct words
of all texts, and the words that hold it lead back to the texts by an equi-join. A needle with
white space is compared with the texts themselves.

In both cases the needle is looked up by one of its character grams, the one that occurs in the
fewest words or texts; only those that hold this gram are tested. The result is exact, and the
work grows with the texts and the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from ..staging import Staged, stage
from .joins import join_spread

GRAM = 3


def needle_table(df: DataFrame, needle: str) -> Staged:
    """Distinct needles, written once."""
    return stage(df.select(col(needle).alias("needle")).where(F.col("needle").isNotNull()).distinct(), "needles")


def text_table(df: DataFrame, text: str) -> Staged:
    """One row per text (the caller's), numbered and written; other columns are carried along."""
    named = df.withColumnRenamed(text, "text").where("text IS NOT NULL")
    return stage(named.withColumn("text_id", F.monotonically_increasing_id()), "texts")


def join_containing(needles: Staged, texts: Staged) -> DataFrame:
    """``needle`` and the columns of the texts it occurs in, both compared as written.

    Empty needles are left out: they occur in everything.
    """
    words, corpus = needles.frame.where(F.length("needle") > 0), texts.frame
    spaced = F.col("needle").rlike(r"\s")
    found = _by_words(words.where(~spaced), corpus)
    phrases = words.where(spaced)
    if not phrases.isEmpty():
        found = found.unionByName(_matches(phrases, corpus.select("text_id", "text")))
    return found.join(corpus, "text_id").select("needle", *corpus.columns)


def _by_words(words: DataFrame, corpus: DataFrame) -> DataFrame:
    """``needle, text_id`` through the distinct words of the texts."""
    held = corpus.select("text_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    pairs = stage(match_words(words, held.select("word").distinct()), "pairs").frame
    # A text can hold the needle in several words; a stop word is in nearly every text.
    return join_spread(held, pairs, "word", ["text_id"]).select("needle", "text_id").distinct()


def match_words(needles: DataFrame, words: DataFrame) -> DataFrame:
    """``needle, word`` for needles without white space and the distinct words they occur in."""
    vocabulary = stage(words, "vocabulary").frame
    pairs = _matches(needles, vocabulary.select(F.col("word").alias("text_id")))
    return pairs.select("needle", F.col("text_id").alias("word"))


def _grams(c, size: int) -> Column:
    """Distinct character grams of a text."""
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(f"(?s)(?=(.{{{size}}}))"), 1))


def _text(corpus: DataFrame) -> str:
    """The column of the texts; a corpus without one has texts that are their own numbers."""
    return "text" if "text" in corpus.columns else "text_id"


def _matches(words: DataFrame, corpus: DataFrame) -> DataFrame:
    """``needle, text_id`` for every needle and the texts it occurs in."""
    matched = _long_matches(words.where(F.length("needle") >= GRAM), corpus)
    short = words.where(F.length("needle") < GRAM)
    # A needle shorter than a gram is a gram of that size itself. (At most two sizes.)
    for size in [r["n"] for r in short.select(F.length("needle").alias("n")).distinct().collect()]:
        held = corpus.select("text_id", F.explode(_grams(_text(corpus), size)).alias("needle"))
        exact = short.where(F.length("needle") == size)
        matched = matched.unionByName(held.join(exact, "needle").select("needle", "text_id"))
    return matched


def _long_matches(words: DataFrame, corpus: DataFrame) -> DataFrame:
    word_grams = words.select("needle", F.explode(_grams("needle", GRAM)).alias("gram"))
    held = corpus.select("text_id", F.explode(_grams(_text(corpus), GRAM)).alias("gram"))
    # Only grams of some needle are kept, and written once: they are counted, then looked up.
    held = stage(held.join(word_grams.select("gram").distinct(), "gram", "left_semi"), "grams").frame
    spread = held.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    # A needle with a gram that no text has cannot match and gets no anchor.
    known = F.coalesce("texts", F.lit(0))
    anchors = (
        word_grams.join(spread, "gram", "left")
        .groupBy("needle")
        .agg(F.min_by("gram", known).alias("gram"), F.min(known).alias("texts"))
        .where("texts > 0")
        .select("needle", "gram")
    )
    anchors = stage(anchors, "anchors").frame
    candidates = held.join(anchors, "gram").select("text_id", "needle")
    texts = candidates.join(corpus, "text_id") if "text" in corpus.columns else candidates
    return texts.where(F.contains(F.col(_text(corpus)), F.col("needle"))).select("needle", "text_id")
