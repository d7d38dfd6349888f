"""Benchmark passages in training texts by a positional inverted index.

The index holds a posting (term, document, position) for every training word that the benchmark uses;
other words cannot be part of a match and are not stored. It is one pass over the texts and one written
table, without a shuffle. The term table is small beside the corpus; it is written first, so that Spark
broadcasts it if its measured size allows and sorts otherwise.

Each benchmark item is cut into windows of ``size`` words. A window's terms are put in order of their
frequency in the index. The posting list of the rarest term gives candidate starts (position less the
term's offset); these are intersected with the offset-adjusted list of the next rarest term, and so on.
The first ``SINGLE`` lists are intersected one by one; what is left is few, and its remaining terms are
intersected at once by counting them. Every step is an equi-join on (document, term, position), whose keys
no common passage or word makes hot. ``slop`` lets each term lie that many words off its place beside the
rarest one (proximity match); 0 asks for the exact phrase.

Defined results: a missing or empty text or item has no words; documents keep a row each, repeated or not;
items that repeat an id count once; an item without an id counts under the empty id; windows with a word
that no training text has match nothing; with an empty benchmark nothing is hit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from shelfgrade.staging import release, stage

from .text import words

SINGLE = 3  # lists that are intersected one by one


@dataclass(frozen=True)
class Index:
    """postings: (doc, term, pos), and for each document one row with term 0 and its number of words as pos."""

    postings: DataFrame
    windows: DataFrame  # (win, n)
    items: DataFrame  # (win, item): which items a window is in
    steps: DataFrame  # (win, n, rank, term, off): a window's terms, rarest first
    paths: tuple

    def release(self) -> None:
        for path in self.paths:
            release(self.postings.sparkSession, path)


def item_windows(items: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(item, window): all runs of ``size`` words of each item, or the whole of a shorter one."""
    split = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return split.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window"))


def build_index(docs: DataFrame, items: DataFrame, keep=(), text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = 10) -> Index:
    """Index ``docs`` for the words of ``items``. The rows of term 0 carry the ``keep`` columns."""
    found = stage(item_windows(items, item_key, item_text, size), "windows")
    distinct = stage(found.frame.select("window").distinct().withColumn("win", F.monotonically_increasing_id()), "windows")
    members = stage(found.frame.distinct().join(distinct.frame, "window").select("win", "item"), "items")
    vocabulary = distinct.frame.select(F.explode("window").alias("word")).distinct()
    # Numbers from 1; 0 is the row that closes a document.
    numbered = vocabulary.select("word", (F.monotonically_increasing_id() + 1).alias("term"))
    closing = items.sparkSession.range(1).select(F.lit("").alias("word"), F.col("id").alias("term"))
    terms = stage(numbered.unionByName(closing), "terms")

    # The empty text is no word; at the end of the words it stands at position n_words.
    split = docs.select(F.monotonically_increasing_id().alias("doc"), *keep, F.concat(words(F.col(text)), F.array(F.lit(""))).alias("w"))
    tokens = split.select("doc", *keep, F.posexplode("w").alias("pos", "word"))
    last = F.col("term") == 0
    postings = stage(tokens.join(terms.frame, "word").select("doc", "term", "pos", *[F.when(last, F.col(c)).alias(c) for c in keep]), "postings")

    frequency = postings.frame.where("term > 0").groupBy("term").agg(F.count("*").alias("n_postings"))
    placed = distinct.frame.select("win", F.size("window").alias("n"), F.posexplode("window").alias("off", "word")).join(terms.frame, "word")
    ranked = placed.join(frequency, "term", "left").withColumn("n_postings", F.coalesce("n_postings", F.lit(0)))
    rarest = Window.partitionBy("win").orderBy("n_postings", "off")
    ranked = ranked.withColumn("rank", F.row_number().over(rarest)).withColumn("least", F.min("n_postings").over(Window.partitionBy("win")))
    steps = stage(ranked.where("least > 0").select("win", "n", "rank", "term", "off"), "steps")
    for scratch in (found, terms):
        release(docs.sparkSession, scratch.path)
    return Index(postings.frame, distinct.frame.select("win", F.size("window").alias("n")), members.frame, steps.frame, (postings.path, distinct.path, members.path, steps.path))


def _asked(candidates: DataFrame, steps: DataFrame, slop: int) -> DataFrame:
    """Where the terms of ``steps`` must lie for the candidates to match."""
    at = F.col("start") + F.col("off")
    wanted = candidates.join(steps.select("win", "rank", "term", "off"), "win")
    if not slop:
        return wanted.select("doc", "win", "start", "rank", "term", at.alias("pos"))
    return wanted.select("doc", "win", "start", "rank", "term", F.explode(F.sequence(at - slop, at + slop)).alias("pos"))


def window_matches(index: Index, slop: int = 0) -> tuple[DataFrame, list[str]]:
    """(doc, win, start, n): where a window's words lie one after the other, ``start`` the first's place.

    With a ``slop``, each word lies at most that far from its place as told from the rarest word.
    Also returns the folders to release after use.
    """
    steps, postings = index.steps, index.postings.select("doc", "term", "pos")
    first = postings.join(steps.where("rank = 1").select("win", "n", "term", "off"), "term")
    found = stage(first.select("doc", "win", "n", (F.col("pos") - F.col("off")).alias("start")).where(F.col("start") >= -slop), "candidates")
    scratch = [found.path]
    for rank in range(2, SINGLE + 1):
        now = steps.where(F.col("rank") == rank)
        lists = postings.join(now.select("term").distinct(), "term", "left_semi")
        hits = _asked(found.frame, now, slop).join(lists, ["doc", "term", "pos"])
        left = hits.select("doc", "win", "start").distinct() if slop else hits.select("doc", "win", "start")
        kept = found.frame.join(left, ["doc", "win", "start"], "left_semi") if slop else hits.join(index.windows, "win").select("doc", "win", "n", "start")
        short = found.frame.where(F.col("n") < rank).select("doc", "win", "n", "start")
        found = stage(kept.select("doc", "win", "n", "start").where(F.col("n") >= rank).unionByName(short), "candidates")
        scratch.append(found.path)
    rest = steps.where(F.col("rank") > SINGLE)
    hits = _asked(found.frame, rest, slop).join(postings, ["doc", "term", "pos"])
    counted = hits.groupBy("doc", "win", "start").agg((F.count_distinct("rank") if slop else F.count("*")).alias("found"))
    whole = found.frame.where(F.col("n") > SINGLE).join(counted, ["doc", "win", "start"]).where(F.col("found") == F.col("n") - SINGLE)
    matches = whole.select("doc", "win", "start", "n").unionByName(found.frame.where(F.col("n") <= SINGLE).select("doc", "win", "start", "n"))
    return matches, scratch


def hit_words(matches: DataFrame) -> DataFrame:
    """(doc, n_hit): words inside any match, each counted once."""
    order = Window.partitionBy("doc").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    runs = matches.groupBy("doc", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    before = F.coalesce(F.max("end").over(order), F.lit(0))
    new = runs.withColumn("new", F.greatest(F.col("end") - F.greatest("start", before), F.lit(0)))
    return new.groupBy("doc").agg(F.sum("new").cast("long").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, keep=(), text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """``keep`` columns, n_words, n_hit, n_items and the sorted ``items`` found in each document."""
    spark = docs.sparkSession
    index = build_index(docs, items, keep, text, item_key, item_text, size)
    found, scratch = window_matches(index)
    matches = stage(found, "matches")
    items_of = matches.frame.select("doc", "win").distinct().join(index.items, "win").groupBy("doc").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = stage(hit_words(matches.frame).join(items_of, "doc"), "hits").frame
    rows = stage(index.postings.where("term = 0").select("doc", *keep, F.col("pos").cast("long").alias("n_words")), "documents").frame
    for path in (*scratch, matches.path):
        release(spark, path)
    index.release()
    none = F.array().cast("array<string>")
    return rows.join(hits, "doc", "left").select(
        *keep, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items")
    )
