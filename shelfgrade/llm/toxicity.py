"""A convolutional text classifier over hashed word embeddings, trained in numpy.

A word is the concatenation of hashed embeddings: two of the whole word under different hashes, so that
words are told apart although tables are small, and one of its first letters, so that inflected forms
share a part. Filters of several widths slide over the words, each keeps its largest response in the
text, and a logistic layer turns these into a score.

Spark hashes the words inside the JVM and hands arrays of numbers to numpy. Since a filter's response is
a sum over its words, a trained model is folded into one response row per table entry: scoring a text of
any length is look-ups, sums and maxima. Fitting takes all labelled texts. They are dealt by a hash of the
key into parts of about ``part`` rows; each part fits a model from the same first weights, and the models are
averaged: an embedding by the number of texts that hold its word in each part, the other weights by the rows.
A fifth of the rows is kept aside to set, for each language, the threshold with the best F1 (``DEFAULT`` where
a language has too few cases); where there are several parts, the averaged model scores these rows and their
scores are counted to four decimals.

Defined results: a missing or empty text has no words and gets the score that the logistic layer gives to
silent filters; a key labelled twice counts as toxic if any label says so; without any labelled text the
score is 0 for all; languages not seen in fitting use the default threshold; rows may repeat.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfgrade.staging import release, stage

from .text import words

DEFAULT = 0.3
BUCKETS = 1 << 16
STEM = 4
DIMS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8  # of each width
TABLES = 3
PAD = BUCKETS  # the entry between two texts, always zero
CHUNK = 30_000  # words whose responses are held at a time
PART = 300_000  # words that are looked up at a time


def word_hashes(text: Column) -> Column:
    """One number per word: 32 bits of the word's hash, 16 bits of its stem's."""
    whole = lambda w: F.xxhash64(w).bitwiseAND(F.lit(0xFFFFFFFF))
    stem = lambda w: F.xxhash64(F.substring(w, 1, STEM)).bitwiseAND(F.lit(0xFFFF))
    return F.transform(words(text), lambda w: F.shiftleft(stem(w), 32).bitwiseOR(whole(w)))


def _entries(hashes: np.ndarray, lengths: np.ndarray):
    """Table entries of all words of many texts, pads behind each text; where texts start; where windows may start.

    Windows start at each word, in an empty text at its first pad, and never reach the next text.
    """
    pads = WIDTHS[-1]
    starts = np.concatenate([[0], np.cumsum(lengths + pads)]).astype(np.int64)
    out = np.full((TABLES, starts[-1]), PAD, np.int32)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    where = np.arange(len(hashes)) + owner * pads
    for k in range(TABLES):
        out[k, where] = (hashes >> (16 * k)) & (BUCKETS - 1)
    opens = np.zeros(starts[-1], bool)
    opens[where] = opens[starts[:-1]] = True
    return out, starts, opens


def _slices():
    """(width, offset within the filter, columns of the joint response)."""
    at = 0
    for width in WIDTHS:
        for offset in range(width):
            yield width, offset, slice(at, at + FILTERS)
            at += FILTERS


RESPONSES = FILTERS * sum(WIDTHS)


def _convolve(response: np.ndarray) -> np.ndarray:
    """Filter outputs at each word, from the responses of the single words (n, RESPONSES)."""
    n = len(response)
    out = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
    for width, offset, columns in _slices():
        k = WIDTHS.index(width) * FILTERS
        out[: n - offset, k : k + FILTERS] += response[offset:, columns]
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fold(model: dict) -> dict:
    """With one row of responses per table entry."""
    tables = [t @ model["conv"][k * DIMS : (k + 1) * DIMS] for k, t in enumerate(model["table"])]
    return {**model, "tables": tables}


def scores(model: dict, hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Scores of many texts whose words lie one after the other."""
    entries, starts, opens = _entries(hashes, lengths)
    tables, bias = model["tables"], model["bias"]
    peaks = np.full((len(lengths), len(bias)), -np.inf, np.float32)
    total = entries.shape[1]
    for first in range(0, total, CHUNK):
        # The last words are looked at again by the next chunk, so that no window is cut.
        part = entries[:, first : first + CHUNK + WIDTHS[-1] - 1]
        response = tables[0][part[0]]
        for k in range(1, TABLES):
            response += tables[k][part[k]]
        values = _convolve(response)[: min(CHUNK, total - first)]
        values[~opens[first : first + CHUNK]] = -np.inf
        texts = np.searchsorted(starts, [first, first + len(values) - 1], side="right") - 1
        inside = slice(texts[0], texts[1] + 1)
        cuts = np.maximum(starts[inside] - first, 0)
        peaks[inside] = np.maximum(peaks[inside], np.maximum.reduceat(values, cuts, axis=0))
    return _sigmoid(np.maximum(peaks + bias, 0).astype(np.float64) @ model["out"] + model["base"])


def _leanings(texts: list[np.ndarray], labels: np.ndarray, rate: float, doubt: float = 4.0) -> np.ndarray:
    """How far each table entry leans to label 1: log-odds of the texts it is in, against ``rate``, that of all texts."""
    held, marked = np.zeros((2, TABLES, BUCKETS + 1))
    for text, label in zip(texts, labels):
        entries = _entries(text, np.array([len(text)]))[0]
        for k in range(TABLES):
            own = np.unique(entries[k])
            held[k, own] += 1
            marked[k, own] += label
    share = (marked + doubt * rate) / (held + doubt)
    lean = np.log(share / (1 - share)) - np.log(rate / (1 - rate))
    lean[:, PAD] = 0
    return lean.astype(np.float32)


def _in_parts(model: dict, column: pa.ListArray) -> np.ndarray:
    """Scores of a column of word hashes, some texts at a time; a text stays whole."""
    lengths = np.asarray(column.value_lengths(), np.int64)
    words, ends = column.flatten().to_numpy(), np.cumsum(lengths)
    out, first = [np.empty(0)], 0
    while first < len(lengths):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + PART, side="right")))
        out.append(scores(model, words[done : ends[last - 1]], lengths[first:last]))
        first = last
    return np.concatenate(out)


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 5, updates: int = 300, batch: int = 64, seed: int = 7, rate: float | None = None) -> dict:
    """Train on word hashes per text and labels 0 or 1; ``fold`` makes the result ready to score.

    ``rate`` is the share of label 1 where ``texts`` are a part of all, which need not hold both labels.

    The first dimension of the embeddings starts with the entries' leanings and one filter of width 1
    adds these up; all weights are then trained. Small samples are gone through more often, for at least
    ``updates`` steps.
    """
    rng = np.random.default_rng(seed)
    features = FILTERS * len(WIDTHS)
    table = rng.normal(0, 0.05, (TABLES, BUCKETS + 1, DIMS)).astype(np.float32)
    table[:, PAD] = 0
    conv = rng.normal(0, 0.3, (TABLES * DIMS, RESPONSES)).astype(np.float32)
    bias, out = np.full(features, -0.1, np.float32), rng.normal(0, 0.3, features).astype(np.float32)
    if rate is None:
        rate = labels.mean() if len(labels) else 0
    base = np.float32(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    if 0 < rate < 1:
        table[:, :, 0] = _leanings(texts, labels, rate) / 4
        conv[:, 0], conv[::DIMS, 0] = 0, 1
        bias[0], out[0] = -1, 3
        epochs = max(epochs, -(-updates * batch // len(texts)))
    seen = [np.full(v.shape[:-1] + (1,) if v.ndim == 3 else v.shape, 1e-3, np.float32) for v in (table, conv, bias, out)] + [1e-3]
    lengths = np.array([len(t) for t in texts], np.int64)
    for epoch in range(epochs if 0 < rate < 1 else 0):
        step = 0.05 * 0.05 ** (epoch / epochs)
        shuffled = rng.permutation(len(texts))
        for first in range(0, len(texts), batch):
            rows = shuffled[first : first + batch]
            entries, starts, opens = _entries(np.concatenate([texts[i] for i in rows]).astype(np.int64), lengths[rows])
            x = np.concatenate([table[k][entries[k]] for k in range(TABLES)], axis=1)
            values = _convolve(x @ conv)
            values[~opens] = -np.inf
            best = np.stack([values[a:b].argmax(axis=0) + a for a, b in zip(starts, starts[1:])])
            peak = np.take_along_axis(values, best, axis=0) + bias
            hidden = np.maximum(peak, 0)
            error = (_sigmoid(hidden @ out + base) - labels[rows]).astype(np.float32) / len(rows)
            back = error[:, None] * out * (peak > 0)
            grads = [None, np.zeros_like(conv), back.sum(axis=0), hidden.T @ error + 1e-4 * out]
            touched, pulls = [], []
            for width, offset, columns in _slices():
                k = WIDTHS.index(width) * FILTERS
                at, pull = best[:, k : k + FILTERS] + offset, back[:, k : k + FILTERS]
                inside = at < len(x)
                at = np.minimum(at, len(x) - 1)
                pull = pull * inside
                grads[1][:, columns] = np.einsum("rfd,rf->df", x[at], pull)
                on = pull != 0
                touched.append(at[on])
                pulls.append(pull[on][:, None] * conv[:, columns].T[np.nonzero(on)[1]])
            touched, pulls = np.concatenate(touched), np.concatenate(pulls)
            for k in range(TABLES):
                which, inverse = np.unique(entries[k][touched], return_inverse=True)
                grad = np.zeros((len(which), DIMS), np.float32)
                np.add.at(grad, inverse, pulls[:, k * DIMS : (k + 1) * DIMS])
                grad[which == PAD] = 0
                seen[0][k, which] += (grad**2).mean(axis=1, keepdims=True)
                table[k, which] -= step * grad / np.sqrt(seen[0][k, which])
            for i, value in ((1, conv), (2, bias), (3, out)):
                seen[i] += grads[i] ** 2
                value -= step * grads[i] / np.sqrt(seen[i])
            seen[4] += error.sum() ** 2
            base -= step * error.sum() / np.sqrt(seen[4])
    return {"table": table, "conv": conv, "bias": bias, "out": out, "base": float(base), "thresholds": {}}


def best_threshold(given: np.ndarray, labels: np.ndarray, default: float = DEFAULT, cases: int = 10, rows: np.ndarray | None = None) -> float:
    """The threshold with the best F1, half-way between the scores around it; the nearest to the default of equals.

    A score may stand for several ``rows``, of which ``labels`` are 1.
    """
    rows = np.ones(len(labels)) if rows is None else rows
    if min(labels.sum(), (rows - labels).sum()) < cases:
        return default
    order = np.argsort(-given, kind="stable")
    s, y = given[order], labels[order]
    f1 = 2 * np.cumsum(y) / (np.cumsum(rows[order]) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = 0
    cuts = np.append((s[:-1] + s[1:]) / 2, s[-1] / 2)
    good = cuts[f1 >= f1.max() - 1e-12]
    return float(good[np.argmin(np.abs(good - default))])


def _read(batches):
    """Words of each text, labels and languages in the order of the keys: the same model, however rows arrive."""
    texts, labels, langs, order = [], [], [], []
    for b in batches:
        hashed = b.column("words")
        values, ends = hashed.flatten().to_numpy(), np.cumsum(np.asarray(hashed.value_lengths()))
        texts += np.split(values, ends[:-1]) if len(ends) else []
        labels += b.column("label").to_pylist()
        langs += b.column("lang").to_pylist()
        order += b.column("order").to_pylist()
    ranked = np.argsort(order, kind="stable")
    return [texts[i] for i in ranked], np.array([labels[i] for i in ranked], np.float32), [langs[i] for i in ranked]


def _train(batches):
    """A model with thresholds from rows that are one part."""
    texts, labels, langs = _read(batches)
    aside = np.arange(len(texts)) % 5 == 0
    model = fit([t for t, a in zip(texts, aside) if not a], labels[~aside])
    kept = [t for t, a in zip(texts, aside) if a]
    found = scores(fold(model), np.concatenate([*kept, np.empty(0, np.int64)]), np.array([len(t) for t in kept], np.int64))
    spoken = [x for x, a in zip(langs, aside) if a]
    for lang in {x for x in spoken if x is not None}:
        rows = np.array([x == lang for x in spoken])
        model["thresholds"][lang] = best_threshold(found[rows], labels[aside][rows])
    yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(model)]})


BLOCK = 4096  # table entries whose weights travel together
DENSE = ("conv", "bias", "out", "base")
SUMS = "block int, part int, held binary, weights binary"


def _fit_part(rate: float):
    """Fits one part; gives its weights by blocks, each times the number of texts behind it, and these numbers."""

    def run(group: pa.Table) -> pa.Table:
        texts, labels, _ = _read(group.to_batches())
        model = fit(texts, labels, rate=rate)
        out, part = {"block": [], "part": [], "held": [], "weights": []}, group.column("part")[0].as_py()

        def give(block, held, weights):
            values = (block, part, held.astype(np.float32).tobytes(), (weights * held[:, None]).astype(np.float32).tobytes())
            for column, value in zip(out.values(), values):
                column.append(value)

        give(-1, np.array([len(texts)]), np.concatenate([np.ravel(model[k]) for k in DENSE]).astype(np.float64)[None])
        words, owner = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        for k, table in enumerate(model["table"]):
            own = np.unique(owner * BUCKETS + ((words >> (16 * k)) & (BUCKETS - 1))) % BUCKETS
            held = np.bincount(own, minlength=BUCKETS)
            for first in range(0, BUCKETS, BLOCK):
                give((k * BUCKETS + first) // BLOCK, held[first : first + BLOCK], table[first : min(first + BLOCK, BUCKETS)].astype(np.float64))
        return pa.table(out, schema=pa.schema([("block", pa.int32()), ("part", pa.int32()), ("held", pa.binary()), ("weights", pa.binary())]))

    return run


def _add_up(batches):
    """Means of the parts' weights, which come block by block; NaN where no text is behind them."""
    block, held, weights = None, None, None

    def done():
        with np.errstate(invalid="ignore"):
            mean = weights.reshape(len(held), -1) / held[:, None]
        return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "weights": [mean.astype(np.float32).tobytes()]})

    for b in batches:
        for row in b.to_pylist():
            more = [np.frombuffer(row[c], np.float32).astype(np.float64) for c in ("held", "weights")]
            if row["block"] == block:
                held, weights = held + more[0], weights + more[1]
                continue
            if block is not None:
                yield done()
            block, (held, weights) = row["block"], more
    if block is not None:
        yield done()


def _average(rows: DataFrame, rate: float) -> dict | None:
    """The mean of the models of all parts; an entry that no text holds keeps its first weights."""
    parts = rows.groupBy("part").applyInArrow(_fit_part(rate), SUMS)
    means = parts.repartition("block").sortWithinPartitions("block", "part").mapInArrow(_add_up, "block int, weights binary")
    # As many numbers as one model has, however many parts there are.
    found = {r.block: np.frombuffer(r.weights, np.float32) for r in means.collect()}
    if not found:
        return None
    model = fit([], np.empty(0, np.float32), rate=0.0)
    model["table"][:, :, 0] = 0
    dense, at = found.pop(-1), 0
    for name in DENSE:
        shape = np.shape(model[name])
        size = int(np.prod(shape))
        model[name] = dense[at : at + size].reshape(shape) if shape else float(dense[at])
        at += size
    for block, weights in found.items():
        k, first = divmod(block * BLOCK, BUCKETS)
        weights = weights.reshape(BLOCK, DIMS)
        own = np.flatnonzero(~np.isnan(weights[:, 0]))
        model["table"][k, first + own] = weights[own]
    return model


def _thresholds(scored: DataFrame) -> dict[str, float]:
    """The best threshold of each language, from scores counted to four decimals: at most 10,001 numbers a language."""
    counted = scored.where("lang IS NOT NULL").groupBy("lang", F.round("score", 4).alias("score")).agg(F.count("*").alias("rows"), F.sum("label").alias("marked"))

    def best(group: pa.Table) -> pa.Table:
        values = {c: group.column(c).to_numpy().astype(np.float64) for c in ("score", "marked", "rows")}
        found = best_threshold(values["score"], values["marked"], rows=values["rows"])
        return pa.table({"lang": group.column("lang").slice(0, 1), "threshold": [found]})

    return {r.lang: r.threshold for r in counted.groupBy("lang").applyInArrow(best, "lang string, threshold double").collect()}


def train(df: DataFrame, labels: DataFrame, key: str, text: str, lang: str, label: str, part: int = 12_000) -> bytes | None:
    """Fit on all rows of ``df`` that ``labels`` (key, label) marks, one a key: the first by a hash of its text."""
    truth = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("label"))
    chosen = stage(truth, "labels")
    known, rate = chosen.frame.agg(F.count("*"), F.avg("label")).first()
    texts = df.where(F.col(key).isNotNull()).select(key, F.col(text).alias("text"), F.col(lang).alias("lang"))

    def labelled(rows, *by):
        # Each task keeps one row a key before the shuffle, so that a key with many rows is short. The labels
        # are as many as the texts and meet them there, at any size.
        first = F.row_number().over(Window.partitionBy(key).orderBy(*by))
        return rows.withColumn("_place", first).where("_place <= 1").join(chosen.frame.hint("merge"), key)

    order = F.col(key).cast("string").alias("order")
    hashed = lambda rows, *more: rows.select(word_hashes(F.col("text")).alias("words"), "label", "lang", order, *more)
    by = [F.xxhash64("text"), "text", "lang"]
    parts = -(-known // part)
    if parts <= 1:
        found = hashed(labelled(texts, *by)).repartition(1).mapInArrow(_train, "model binary").collect()
        release(df.sparkSession, chosen.path)
        return found[0].model if found else None
    draw = lambda seed, n: F.pmod(F.xxhash64(order, F.lit(seed)), F.lit(n)).cast("int")
    aside = draw("aside", 5) == 0
    model = _average(hashed(labelled(texts.where(~aside), *by), draw("part", parts).alias("part")), rate)
    if model:
        # Rows kept aside are scored before they meet their labels, so that no text is shuffled.
        kept = texts.where(aside).select(key, "text", "lang", F.xxhash64("text").alias("hash"))
        scored = score(kept, pickle.dumps(model), "text", "lang", [key, "lang", "hash"])
        model["thresholds"] = _thresholds(labelled(scored, "hash", "score", "lang"))
    release(df.sparkSession, chosen.path)
    return pickle.dumps(model) if model else None


def score(df: DataFrame, model: bytes | None, text: str, lang: str, keep) -> DataFrame:
    """``keep`` columns, score, predicted at the default and flagged at the language's threshold."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = df.select(*keep, F.col(lang).alias("_lang"), word_hashes(F.col(text)).alias("_words"))

    def run(batches):
        fitted = fold(pickle.loads(shared.value)) if shared.value else None
        for b in batches:
            found = np.zeros(b.num_rows) if fitted is None else _in_parts(fitted, b.column("_words"))
            limits = fitted["thresholds"] if fitted else {}
            least = np.array([limits.get(x, DEFAULT) for x in b.column("_lang").to_pylist()])
            columns = [b.column(i) for i in range(b.num_columns - 2)]
            names = b.schema.names[:-2]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found), pa.array((found >= DEFAULT).astype(np.int32)), pa.array((found >= least).astype(np.int32))],
                names=[*names, "score", "predicted", "flagged"],
            )

    schema = rows.drop("_lang", "_words").schema.add("score", "double").add("predicted", "integer").add("flagged", "integer")
    return rows.mapInArrow(run, schema)
