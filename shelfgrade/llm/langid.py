"""The language of texts by rank-order profiles of character n-grams.

A profile lists the ``SIZE`` most frequent runs of one to three letters of a language, words padded with
a blank, most frequent first. A text's own list is compared with each profile by the out-of-place
distance: how far each n-gram's rank is from its rank in the profile, ``SIZE`` if it is not there. The
nearest profile names the language.

Profiles are learned from a bounded sample of labelled texts (``per_language`` rows for each language,
chosen by a hash of the key, whole texts). The n-grams are counted in the tasks, summed and ranked by
Spark; only the profiles reach the driver. N-grams are exact: up to three code points in one number.

Defined results: a missing text, one without a letter, and any text when nothing was learned are ``und``
with score 0; equal distances go to the first language by name, equal counts rank the smaller n-gram
first; a label of null is not learned; repeated rows are results of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shelfgrade.staging import release, stage

SIZE = 300
BLANK = 32
UNKNOWN = "und"
_BITS = 21


def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text in ascending order, and how often each occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.concatenate([[BLANK], np.where(letters[codes], codes, BLANK), [BLANK]]).astype(np.int64)
    # Of several blanks one stays.
    codes = codes[np.concatenate([[True], (codes[1:] != BLANK) | (codes[:-1] != BLANK)])]
    middle = codes[1:-1]
    inside = middle != BLANK
    two = codes[:-1] << _BITS | codes[1:]
    three = codes[:-2] << 2 * _BITS | middle << _BITS | codes[2:]
    found = np.sort(np.concatenate([middle[inside], two if len(middle) else two[:0], three[inside]]))
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.empty(0, np.int64)
    return found[first], np.diff(np.append(first, len(found)))


def most_frequent(values: np.ndarray, counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    return values[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Ranks of all profiles' n-grams."""

    def __init__(self, profiles: dict[str, list[int]], size: int = SIZE):
        self.size, self.langs = size, sorted(profiles)
        self.grams = np.unique(np.concatenate([np.empty(0, np.int64), *(np.array(p, np.int64) for p in profiles.values())]))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            listed = np.array(profiles[lang], np.int64)
            self.ranks[np.searchsorted(self.grams, listed), k] = np.arange(len(listed))

    def nearest(self, ranked: np.ndarray) -> tuple[str, float]:
        """The nearest language, and 1 less the share of the greatest distance."""
        at = np.searchsorted(self.grams, ranked)
        known = np.minimum(at, len(self.grams) - 1)
        ranks = self.ranks[np.where(self.grams[known] == ranked, known, len(self.grams))]
        away = np.where(ranks >= 0, np.minimum(np.abs(ranks - np.arange(len(ranked))[:, None]), self.size), self.size)
        total = away.sum(axis=0)
        best = int(total.argmin())
        return self.langs[best], 1 - float(total[best]) / (self.size * len(ranked))


def learn(df: DataFrame, key: str, text: str, lang: str, per_language: int = 2_000, size: int = SIZE) -> dict[str, list[int]]:
    """The profile of each language, from about ``per_language`` rows of it."""
    known = df.where(F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    share = known.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share"))
    shares = stage(share, "shares")
    draw = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1_000_003)) / 1_000_003.0
    sample = known.join(shares.frame, "lang").where(draw < F.col("share")).select("lang", F.coalesce("text", F.lit("")).alias("text"))

    def tally(batches):
        letters, sums = letter_table(), {}
        for b in batches:
            for name, body in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                values, counts = grams(body, letters)
                old = sums.get(name)
                if old:
                    merged, place = np.unique(np.concatenate([old[0], values]), return_inverse=True)
                    values, counts = merged, np.bincount(place, np.concatenate([old[1], counts])).astype(np.int64)
                sums[name] = (values, counts)
        for name, (values, counts) in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(values), pa.string()), "gram": pa.array(values, pa.int64()), "n": pa.array(counts.astype(np.int64))})

    counted = sample.mapInArrow(tally, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked = counted.withColumn("place", place).where(F.col("place") <= size)
    profiles: dict[str, list[int]] = {}
    for r in ranked.orderBy("lang", "place").collect():
        profiles.setdefault(r.lang, []).append(r.gram)
    release(df.sparkSession, shares.path)
    return profiles


def predict(df: DataFrame, text: str, profiles: dict[str, list[int]], keep, size: int = SIZE) -> DataFrame:
    """``keep`` columns, lang_pred and score."""
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches):
        letters, known = letter_table(), Profiles(profiles, size)
        for b in batches:
            names, scores = [], []
            for body in b.column("_text"):
                own = most_frequent(*grams(body.as_py(), letters), size)
                name, score = known.nearest(own) if len(own) and known.langs else (UNKNOWN, 0.0)
                names.append(name)
                scores.append(score)
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(run, rows.drop("_text").schema.add("lang_pred", "string").add("score", "double"))
