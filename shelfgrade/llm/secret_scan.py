"""Secrets in texts: fixed patterns, and values in credential context that would take many guesses.

Three patterns give the base spans: values assigned to a credential name, access keys, long
hexadecimal runs. Beyond these, every value in a wider credential context (``pwd=``, ``passphrase is``,
``Authorization: Bearer`` and the like) is judged by its guess cost: the cheapest way, found by dynamic
programming over its characters, to cut it into words, dates, repeats, keyboard walks and brute-force
spans, as the decimal logarithm of the guesses. Values of at least ``LEAST`` are added as spans of kind
``guess`` unless they lie inside a base span.

Words are the fixed ones and all words of the scanned texts, ranked by how often they occur outside of
base spans and of values in credential context, so that a secret does not become a word by being repeated.
A word is a run of 3 to ``LONGEST_WORD`` letters; its rank is the number of words that occur as often or
more often. The ranks are staged and joined to the letters of the distinct costly values only; values that
cost less with them are taken back from the rows that hold them. No vocabulary is sent to the tasks.

Texts are first searched for any of the patterns' fixed parts by Arrow's linear-time matcher; only texts
with one of them are looked at character by character.

Defined results: a missing text is an empty text; nothing found gives empty spans; repeated rows have
results of their own; positions count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from shelfgrade.operators.joins import join_spread
from shelfgrade.staging import release, stage

# The base patterns, their kinds in order, and the least lengths of what they match.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "guess")

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# Runs of the class are taken whole, so the least length can stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:[A-Za-z0-9]+_)?(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|(?:api|access|private|auth|secret)[_-]?key|authorization)"""
    r"""["']?(?:\x20*(?::=|=>|[:=])\x20*|\x20+is\x20+)(?:(?:bearer|basic)\x20+)?["']?([^\s"'<>]+)""",
    re.IGNORECASE | re.ASCII,
)
_ANY = r"(?i)(?:pass|passphrase|passcode|password|passwd|pwd|pin|secret|token|credentials?|key|authorization)[\"']?(?:\x20*[:=]|\x20+is\x20)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"

LEAST = 8.0  # decimal logarithm of the guesses
LONGEST_WORD = 40
SLICE = 1000  # texts whose words are counted together
LETTERS = 20_000  # parts of a value that are handed on together

# Common words of passwords, most frequent first.
WORDS = (
    "password", "qwerty", "admin", "welcome", "letmein", "login", "monkey", "dragon", "master", "hello",
    "test", "user", "guest", "root", "secret", "changeme", "default", "sunshine", "princess", "football",
    "baseball", "shadow", "superman", "love", "summer", "winter", "spring", "autumn", "hunter", "pepper",
    "ginger", "cookie", "orange", "banana", "flower", "purple", "silver", "golden", "happy", "lucky",
    "angel", "tiger", "eagle", "server", "system", "token", "key", "pass", "word", "example",
    "sample", "demo", "temp", "none", "null", "true", "false", "your", "here", "the",
)
# Rows of a keyboard, and sequences.
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "qwertzuiop", "azertyuiop", "1qaz2wsx3edc4rfv5tgb6yhn7ujm")
# Letters that digits and signs stand for.
STANDS = str.maketrans("4@3€1!0$5+7", "aaeeiiosstt")

_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
_LONGEST = max(map(len, WORDS))
_NEXT = {a + b for row in WALKS for line in (row, row[::-1]) for a, b in zip(line, line[1:])}
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
_REPEAT = re.compile(r"(.{1,8}?)\1+", re.DOTALL)
_CLASSES = ((re.compile("[0-9]"), 10), (re.compile("[a-z]"), 26), (re.compile("[A-Z]"), 26))


def _char_cost(c: str) -> float:
    return math.log10(next((n for rule, n in _CLASSES if rule.match(c)), 33))


def _small(value: str) -> str:
    low = value.lower()
    if len(low) != len(value):  # a letter whose small form is two characters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    return low


def spans_of(value: str, rank: dict[str, int] | None = None) -> list[tuple[int, int, str, float]]:
    """All (start, end, kind, cost) of known shapes in a value."""
    rank = _RANK if rank is None else rank
    longest = _LONGEST if rank is _RANK else max(map(len, rank), default=0)
    low = _small(value)
    plain = low.translate(STANDS)
    out = []
    for i in range(len(value)):
        for j in range(i + 3, min(len(value), i + longest) + 1):
            place = rank.get(low[i:j])
            stood = 0 if place else rank.get(plain[i:j])
            if place or stood:
                # Twice the guesses for capitals, four times for signs that stand for letters.
                cased = value[i:j] != low[i:j]
                out.append((i, j, "word", math.log10((place or stood) * (1 + cased) * (4 if stood else 1))))
    for m in _DATE.finditer(value):
        out.append((m.start(), m.end(), "date", math.log10(200 if len(m[0]) == 4 else 365 * 200)))
    for m in _REPEAT.finditer(value):
        if m.end() - m.start() >= 3:
            unit = sum(map(_char_cost, m[1]))
            out.append((m.start(), m.end(), "repeat", unit + math.log10((m.end() - m.start()) / len(m[1]))))
    i = 0
    while i < len(low) - 1:
        j = i
        while j + 1 < len(low) and low[j : j + 2] in _NEXT:
            j += 1
        if j - i >= 2:
            out.append((i, j + 1, "walk", math.log10(len(WALKS) * 20 * (j - i + 1))))
        i = max(j, i + 1)
    return out


def guess_cost(value: str, rank: dict[str, int] | None = None) -> tuple[float, list[tuple[int, int, str]]]:
    """The least cost of a value and the segments that have it; brute force goes by single characters."""
    ending: dict[int, list] = {}
    for start, end, kind, cost in spans_of(value, rank):
        ending.setdefault(end, []).append((start, kind, cost))
    best, came = [0.0], [(0, "")]
    for end in range(1, len(value) + 1):
        least, origin = best[end - 1] + _char_cost(value[end - 1]), (end - 1, "brute")
        for start, kind, cost in ending.get(end, ()):
            if best[start] + cost < least:
                least, origin = best[start] + cost, (start, kind)
        best.append(least)
        came.append(origin)
    segments, end = [], len(value)
    while end:
        start, kind = came[end]
        if segments and kind == "brute" and segments[-1][2] == "brute":
            segments[-1] = (start, segments[-1][1], kind)
        else:
            segments.append((start, end, kind))
        end = start
    return best[-1], segments[::-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the three patterns, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def digest(value: str) -> str:
    return hashlib.md5(value.encode("utf-8", "surrogatepass")).hexdigest()


def guess_spans(text: str, base, least: float = LEAST, cheap=frozenset()) -> list[tuple[int, int, int]]:
    """Values in credential context that cost many guesses and lie outside the base spans, but for those whose digest is in ``cheap``."""
    out = []
    at, reach = 0, 0  # base spans that start before the value; how far they reach
    for m in _CONTEXT.finditer(text):
        start, end = m.span(1)
        while at < len(base) and base[at][0] <= start:
            reach = max(reach, base[at][2])
            at += 1
        if end > reach and not (cheap and digest(m[1]) in cheap) and guess_cost(m[1])[0] >= least:
            out.append((start, 3, end))
    return out


def named(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find(text: str, least: float = LEAST, cheap=frozenset()):
    """Base spans and added spans of a text."""
    base = base_spans(text)
    return base, guess_spans(text, base, least, cheap)


def masked(text: str, spans, mark: str) -> str:
    """The text with every run of spans that touch or overlap replaced by ``mark``."""
    out, done = [], 0
    runs: list[list[int]] = []
    for start, _, end in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    for start, end in runs:
        out += [text[done:start], mark]
        done = end
    return "".join([*out, text[done:]])


def _is_letter(c: str) -> bool:
    return unicodedata.category(c)[0] in "LM"


def letters(value: str, most: int = LETTERS) -> Iterator[set[str]]:
    """All that could be a word in a value, as it is and with signs read as letters, in sets of about ``most``.

    A value of any length is held together with one set only; what repeats far apart is in several sets.
    """
    low, held = _small(value), set()
    for line in {low, low.translate(STANDS)}:
        run = 0  # letters from a place on
        for i in range(len(line) - 1, -1, -1):
            run = run + 1 if _is_letter(line[i]) else 0
            held.update(line[i:j] for j in range(i + 3, i + min(run, LONGEST_WORD) + 1))
            if len(held) >= most:
                yield held
                held = set()
    if held:
        yield held


def word_counts(rows: DataFrame) -> DataFrame:
    """word, n: the words of ``_text`` outside of base spans and of values in credential context."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                texts = b.column("_text").slice(at, SLICE)
                suspect = pc.match_substring_regex(texts, _ANY).to_pylist()
                if any(suspect):
                    bodies = texts.to_pylist()
                    for i, look in enumerate(suspect):
                        if look:
                            held = [(m.start(1), 3, m.end(1)) for m in _CONTEXT.finditer(bodies[i])]
                            bodies[i] = masked(bodies[i], base_spans(bodies[i]) + held, " ")
                    texts = pa.array(bodies, pa.string())
                words = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\pL\pM]+").flatten()
                size = pc.utf8_length(words)
                counted = words.filter(pc.and_(pc.greater_equal(size, 3), pc.less_equal(size, LONGEST_WORD))).value_counts()
                yield pa.RecordBatch.from_arrays([counted.field("values").cast(pa.string()), counted.field("counts").cast(pa.int64())], names=["word", "n"])

    return rows.select("_text").where("_text IS NOT NULL").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _costly(rows: DataFrame, least: float) -> DataFrame:
    """The rows with the values that the fixed words leave costly, as ``_values``."""

    def run(batches):
        for b in batches:
            texts = b.column("_text")
            found = []
            for i, look in enumerate(pc.match_substring_regex(texts, _ANY).to_pylist()):
                body = texts[i].as_py() if look else ""
                found.append(sorted({body[a:e] for a, _, e in find(body, least)[1]}) if look else [])
            columns = [b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.string()))], names=[*b.schema.names, "_values"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("_values", ArrayType(StringType())))


def cheap_values(values: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """_id: the digests of those ``values`` (_id, value) that cost less with the words of ``rows``."""

    def pairs(batches):
        for b in batches:
            for i, value in zip(b.column("_id").to_pylist(), b.column("value").to_pylist()):
                for some in letters(value):
                    words = sorted(some)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(words), pa.string()), pa.array(words, pa.string())], names=["_id", "word"])

    def judge(batches):
        for b in batches:
            cheap = []
            for i, value, known in zip(*(b.column(n).to_pylist() for n in ("_id", "value", "known"))):
                rank = dict(_RANK)
                for k in known:
                    rank[k["word"]] = min(k["rank"], rank.get(k["word"], k["rank"]))
                if guess_cost(value, rank)[0] < least:
                    cheap.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(cheap, pa.string())], names=["_id"])

    spark = rows.sparkSession
    counts = stage(word_counts(rows), "words")
    asked = stage(values.mapInArrow(pairs, "_id string, word string"), "letters")
    # One row for each number of occurrences: as many as the root of twice the length of the corpus at most.
    places = counts.frame.groupBy("n").count().select("n", F.sum("count").over(Window.orderBy(F.desc("n"))).alias("rank"))
    needed = counts.frame.join(asked.frame.select("word").distinct(), "word", "left_semi")
    ranks = stage(join_spread(needed, places, "n", ["word"]).select("word", "rank"), "ranks")
    known = join_spread(asked.frame, ranks.frame, "word", ["_id"]).groupBy("_id").agg(F.collect_list(F.struct("word", "rank")).alias("known"))
    cheap = stage(values.join(known, "_id").select("_id", "value", "known").mapInArrow(judge, "_id string"), "cheap").frame
    for scratch in (counts, asked, ranks):
        release(spark, scratch.path)
    return cheap


def _judged(rows: DataFrame, least: float) -> DataFrame:
    """The rows with the digests of those of their values that the words of all rows make cheap, as ``_cheap``."""
    spark, none = rows.sparkSession, F.array().cast("array<string>")
    marked = _costly(rows, least)
    # Few rows hold such a value; only these are written and joined.
    held = stage(marked.where(F.size("_values") > 0).withColumn("_row", F.monotonically_increasing_id()), "costly")
    if not held.rows:
        release(spark, held.path)
        return rows.withColumn("_cheap", none)
    each = held.frame.select("_row", F.explode("_values").alias("value"))
    values = stage(each.select("value").distinct().select(F.md5(F.encode("value", "utf-8")).alias("_id"), "value"), "values")
    cheap = cheap_values(values.frame, rows, least)
    found = join_spread(each.select("_row", F.md5(F.encode("value", "utf-8")).alias("_id")), cheap, "_id", ["_row"])
    found = found.groupBy("_row").agg(F.collect_list("_id").alias("_cheap"))
    joined = held.frame.join(found, "_row", "left").withColumn("_cheap", F.coalesce("_cheap", none)).select(*rows.columns, "_cheap")
    release(spark, values.path)
    return marked.where(F.size("_values") == 0).select(*rows.columns).withColumn("_cheap", none).unionByName(joined)


def redact(df: DataFrame, text: str, mark: str = "<secret>", least: float = LEAST) -> DataFrame:
    """The same rows and columns, secrets in ``text`` replaced by ``mark``; a missing text stays missing."""
    rest = [c for c in df.columns if c != text]
    others = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0)
    rows = df.select(others.alias("_rest"), F.col(f"`{text}`").alias("_text"))

    def run(batches):
        for b in batches:
            texts = b.column("_text")
            suspect = pc.match_substring_regex(texts, _ANY).to_pylist()
            clean = []
            for i, look in enumerate(suspect):
                body = texts[i].as_py()
                clean.append(masked(body, sum(find(body, least, set(b.column("_cheap")[i].as_py())), []), mark) if look else body)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(clean, pa.string())], names=b.schema.names[:2])

    done = _judged(rows, least).mapInArrow(run, rows.schema)
    return done.select(*[F.col("_text").alias(c) if c == text else F.col(f"_rest.`{c}`").alias(c) for c in df.columns])


def scan(df: DataFrame, text: str, keep, least: float = LEAST) -> DataFrame:
    """``keep`` columns, n_assign, n_access, n_hex, n_guess, base and all spans as text."""
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches):
        for b in batches:
            texts = b.column("_text")
            suspect = pc.match_substring_regex(texts, _ANY).to_pylist()
            counts, base_text, all_text = [[], [], [], []], [], []
            for i, look in enumerate(suspect):
                text = texts[i].as_py() if look else ""
                base, more = find(text, least, set(b.column("_cheap")[i].as_py())) if look else ([], [])
                for k in range(4):
                    counts[k].append(sum(kind == k for _, kind, _ in (*base, *more)))
                base_text.append(named(base))
                all_text.append(named(sorted((*base, *more))))
            columns = [b.column(i) for i in range(b.num_columns - 2)]
            yield pa.RecordBatch.from_arrays(
                [*columns, *[pa.array(c, pa.int64()) for c in counts], pa.array(base_text, pa.string()), pa.array(all_text, pa.string())],
                names=[*b.schema.names[:-2], *names],
            )

    names = ["n_assign", "n_access", "n_hex", "n_guess", "base", "spans"]
    schema = rows.drop("_text").schema
    for name in names:
        schema = schema.add(name, "long" if name.startswith("n_") else "string")
    return _judged(rows, least).mapInArrow(run, schema)
