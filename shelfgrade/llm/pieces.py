"""N-best segmentation of texts into the pieces of a SentencePiece vocabulary, and back.

The lattice of a text has an arc for every piece at every place. Its n best paths are found by a search
backwards from the end, A-star, for which the scores of the best ways from the start to each place
(forward Viterbi) are exact estimates: the first paths that arrive are the best ones.

No piece of the vocabulary goes on past the start of a word (blanks, then what is not blank) or over an end
of line, which is checked when it is loaded. The lattice of a text therefore falls apart at word starts, and a text's n
best paths come from its words' paths: all words take their best one, but for those n - 1 swaps that
lose least. Scores of all distinct words of a batch are computed together, forwards and backwards, place
by place in numpy; from these follow the best path and the loss of the next best. Only words with the
least losses of a text are searched by A-star.

Text is taken as it is: a blank is put in front, blanks become the vocabulary's blank sign, characters
without a piece become bytes (the sign itself included), so that ``decode`` gives back every text.

Defined results: a missing or empty text has the single blank in front, and decodes to the empty text; equal
scores keep the longer last piece; alternatives are listed by falling score, fewer than n where a text has
fewer segmentations; repeated rows are results of their own.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

BLANK = "▁"
WORD = re.compile(rf" *[^ {BLANK}\n]+|{BLANK}|\n| +")
LONG = 64  # characters; longer words are handled one by one
CHARS = 4_000_000  # of a batch that are worked on at a time
HELD = 200_000  # solved words that a task remembers
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.ids, self.bytes, self.raw = {}, {}, [b""] * size
        self.scores = np.array([model.get_score(i) for i in range(size)], np.float64)
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.raw[i] = piece.replace(BLANK, " ").encode()
        if any(re.search(f"[^{BLANK}]{BLANK}|\n", p) for p in self.ids) or len(self.bytes) != 256:
            raise ValueError("pieces must end where words start, and there must be a piece for each byte")
        self.longest = max(map(len, self.ids))
        self.unknown = float(self.scores[list(self.ids.values())].min(initial=0, where=self.scores[list(self.ids.values())] > -1e8)) - 10
        self.value = {p: float(self.scores[i]) for p, i in self.ids.items()}
        # Hashes of all beginnings of pieces, each with its piece or -1.
        begins = {p[:k]: -1 for p in self.ids for k in range(1, len(p) + 1)} | self.ids
        hashes = np.array([self._hash(p) for p in begins], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.hashed = hashes[order], np.array(list(begins.values()), np.int32)[order]
        self.spelling = np.array([self.bytes[c] for c in range(128)], np.int32)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_FACTOR) + ord(c) + 1) % 2**64
        return h

    def spelled(self, c: str) -> tuple[int, ...]:
        """A character as byte pieces."""
        return tuple(self.bytes[b] for b in c.encode())


def arcs(vocab: Vocabulary, word: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
    """For each place, the arcs that end there: (start, score, ids). ``word`` has blank signs for blanks."""
    out: list = [[] for _ in range(len(word) + 1)]
    for i, c in enumerate(word):
        if c not in vocab.ids:
            out[i + 1].append((i, vocab.unknown, vocab.spelled(c)))
        for j in range(i + 1, min(len(word), i + vocab.longest) + 1):
            score = vocab.value.get(word[i:j])
            if score is not None:
                out[j].append((i, score, (vocab.ids[word[i:j]],)))
    return out


def search(ending, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best paths through a lattice of ``arcs``, best first."""
    best = [0.0] + [-np.inf] * (len(ending) - 1)
    for end in range(1, len(ending)):
        best[end] = max((best[start] + score for start, score, _ in ending[end]), default=-np.inf)
    tie, found = count(), []
    # Of equal estimates the one nearer to the start goes first, so that ties do not widen the search.
    heap = [(-best[-1], len(ending) - 1, next(tie), 0.0, None)]
    while heap and len(found) < n:
        _, place, _, behind, path = heapq.heappop(heap)
        if place == 0:
            ids = []
            while path:
                ids += path[0]
                path = path[1]
            found.append((behind, tuple(ids)))
            continue
        for start, score, ids in reversed(ending[place]):
            heapq.heappush(heap, (-(best[start] + score + behind), start, next(tie), behind + score, (ids, path)))
    return found


def n_best(vocab: Vocabulary, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best segmentations of a word of a text (blanks as blanks)."""
    if word == BLANK:  # the sign itself is no blank
        return [(vocab.unknown, vocab.spelled(BLANK))]
    return search(arcs(vocab, word.replace(" ", BLANK)), n)


def _solve(vocab: Vocabulary, words: list[str]):
    """Best score, loss of the second best and best ids of words of one length, at most LONG characters."""
    n, size = len(words), len(words[0])
    codes = np.frombuffer("".join(words).replace(" ", BLANK).encode("utf-32-le"), np.uint32).reshape(n, size).T.copy()
    everyone, spans = np.arange(n), []  # (start, end, rows, piece, score)
    for start in range(size):
        rows, h = everyone, np.zeros(n, np.uint64)
        for length in range(1, min(size - start, vocab.longest) + 1):
            h = h * _FACTOR + codes[start + length - 1, rows] + np.uint64(1)
            at = np.minimum(np.searchsorted(vocab.hashes, h), len(vocab.hashes) - 1)
            piece = vocab.hashed[at]
            begins = vocab.hashes[at] == h
            hit = begins & (piece >= 0)
            if length == 1:
                letters = codes[start]
                spelt = np.where(letters < 128, vocab.spelling[np.minimum(letters, 127)], -1)
                spans.append((start, start + 1, rows, np.where(hit, piece, spelt), np.where(hit, vocab.scores[piece], vocab.unknown)))
            elif hit.any():
                spans.append((start, start + length, rows[hit], piece[hit], vocab.scores[piece[hit]]))
            rows, h = rows[begins], h[begins]
            if not len(rows):
                break
    spans.sort(key=lambda span: (span[1], span[0]))
    before, after = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf)
    before[0] = after[size] = 0
    came, taken = np.zeros((size + 1, n), np.int32), np.zeros((size + 1, n), np.int32)
    for start, end, rows, piece, score in spans:
        through = before[start, rows] + score
        better = through > before[end, rows]
        who = rows[better]
        before[end, who], came[end, who], taken[end, who] = through[better], start, piece[better]
    for start, end, rows, _, score in sorted(spans, key=lambda span: -span[0]):
        after[start, rows] = np.maximum(after[start, rows], score + after[end, rows])
    # Where the best path stops, and which words have it at a time.
    stops, place = np.zeros((size + 1, n), bool), np.full(n, size)
    while True:
        stops[place, everyone] = True
        if not place.any():
            break
        place = np.where(place > 0, came[place, everyone], 0)
    second = np.full(n, -np.inf)
    for start, end, rows, _, score in spans:
        other = before[start, rows] + score + after[end, rows]
        other[stops[start, rows] & stops[end, rows] & (came[end, rows] == start)] = -np.inf
        second[rows] = np.maximum(second[rows], other)
    stops[0] = False
    flat, lengths = taken.T[stops.T], stops.sum(axis=0)
    if (flat == -1).any():  # characters of several bytes
        odd = np.flatnonzero(((taken == -1) & stops).any(axis=0))
        paths = np.split(flat, np.cumsum(lengths)[:-1])
        for k in odd:
            ends = np.flatnonzero(stops[:, k])
            paths[k] = np.array([i for e in ends for i in ([taken[e, k]] if taken[e, k] >= 0 else vocab.spelled(words[k][e - 1]))], np.int32)
        lengths[odd] = [len(paths[k]) for k in odd]
        flat = np.concatenate(paths)
    return before[size], before[size] - second, flat, lengths


class Numbers(dict):
    """Words in the order of their first occurrence."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Solved:
    """Per word: its number, best score, loss of the second best, and where its ids are in ``flat``."""

    def __init__(self):
        self.number = Numbers()
        self.score, self.loss = np.empty(0), np.empty(0)
        self.first, self.length = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)

    def add(self, vocab: Vocabulary, words: list[str]) -> None:
        """Solve the words that were numbered since the last call."""
        n = len(words)
        score, loss, first, length = np.zeros(n), np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        parts, at = [self.flat], len(self.flat)
        sizes = np.array([len(w) if w != BLANK else LONG + 1 for w in words], np.int64)
        for size in np.unique(sizes[sizes <= LONG]):
            same = np.flatnonzero(sizes == size)
            step = max(1, 1_000_000 // int(size))
            for some in (same[i : i + step] for i in range(0, len(same), step)):
                score[some], loss[some], flat, lengths = _solve(vocab, [words[i] for i in some])
                length[some] = lengths
                first[some] = at + np.cumsum(lengths) - lengths
                parts.append(flat)
                at += len(flat)
        for i in np.flatnonzero(sizes > LONG):
            paths = n_best(vocab, words[i], 2)
            score[i], ids = paths[0]
            loss[i] = paths[0][0] - paths[1][0] if len(paths) > 1 else np.inf
            first[i], length[i] = at, len(ids)
            parts.append(np.array(ids, np.int32))
            at += len(ids)
        self.flat = np.concatenate(parts)
        for name, new in (("score", score), ("loss", loss), ("first", first), ("length", length)):
            setattr(self, name, np.concatenate([getattr(self, name), new]))


def _gather(flat, first, length):
    """The runs (first, length) of ``flat`` one behind the other."""
    ends = np.cumsum(length)
    return flat[np.repeat(first - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


def _swaps(options: list[list[float]], n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The n sets of swaps that lose least. ``options[k]``: losses of word k's first, second... alternative.

    Returns (loss, ((word, alternative), ...)), the empty set first.
    """
    heap, out, seen = [(0.0, (0,) * len(options))], [], set()
    while heap and len(out) < n:
        loss, picks = heapq.heappop(heap)
        out.append((loss, tuple((k, p - 1) for k, p in enumerate(picks) if p)))
        for k, losses in enumerate(options):
            if picks[k] < len(losses):
                new = (*picks[:k], picks[k] + 1, *picks[k + 1 :])
                if new not in seen:
                    seen.add(new)
                    old = losses[picks[k] - 1] if picks[k] else 0.0
                    heapq.heappush(heap, (loss - old + losses[picks[k]], new))
    return out


def encode_texts(vocab: Vocabulary, texts: list[str], n: int, solved: Solved | None = None) -> Iterator[tuple[np.ndarray, float, list]]:
    """Per text: ids and score of the best segmentation, and the n - 1 next as (score, swaps).

    A swap (at, removed, ids) puts ids in the place of ``removed`` ids of the best, from ``at`` on.
    """
    solved = solved or Solved()
    number, known = solved.number, len(solved.number)
    split = [np.fromiter(map(number.__getitem__, WORD.findall(" " + t)), np.int64) for t in texts]
    solved.add(vocab, list(islice(number, known, None)))
    score, loss, first, length, flat = solved.score, solved.loss, solved.first, solved.length, solved.flat
    words = list(number)
    searched = cache(lambda k: n_best(vocab, words[k], n))
    for own in split:
        ids, total, more = _gather(flat, first[own], length[own]), float(score[own].sum()), []
        if n > 1:
            least = [int(k) for k in _least(loss[own], n - 1) if np.isfinite(loss[own[k]])]
            paths = [searched(int(own[k])) for k in least]
            starts = np.cumsum(length[own]) - length[own]
            for lost, picks in _swaps([[p[0][0] - s for s, _ in p[1:]] for p in paths], n)[1:]:
                more.append((total - lost, sorted((int(starts[least[k]]), int(length[own[least[k]]]), list(paths[k][alt + 1][1])) for k, alt in picks)))
        yield ids, total, more


def _least(losses: np.ndarray, k: int) -> np.ndarray:
    """The places of the k least, the first of equals."""
    if len(losses) <= k:
        return np.arange(len(losses))
    limit = np.partition(losses, k - 1)[k - 1]
    below, at = np.flatnonzero(losses < limit), np.flatnonzero(losses == limit)
    return np.concatenate([below, at[: k - len(below)]])


def decode_ids(vocab: Vocabulary, ids) -> str:
    return b"".join(map(vocab.raw.__getitem__, ids))[1:].decode()


ENCODED = "ids array<int>, n_pieces long, score double, round_trip boolean, alternatives array<struct<score: double, swaps: array<struct<at: int, removed: int, ids: array<int>>>>>"


def encode(df: DataFrame, text: str, keep, model: str, n: int = 3) -> DataFrame:
    """``keep`` columns, ids, n_pieces and score of the best segmentation, and the n - 1 next.

    ``round_trip`` says whether the ids were decoded to the text again.
    """
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = rows.drop("_text").schema
    for field in T.StructType.fromDDL(ENCODED):
        schema = schema.add(field)
    others = pa.list_(pa.struct([("score", pa.float64()), ("swaps", pa.list_(pa.struct([("at", pa.int32()), ("removed", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))

    def run(batches):
        vocab, solved = Vocabulary(model), Solved()
        for whole in batches:
            for b in _parts(whole):
                solved = solved if len(solved.number) < HELD else Solved()
                texts = b.column("_text").to_pylist()
                pieces, scores, same, alternatives = [], [], [], []
                for body, (ids, score, alt) in zip(texts, encode_texts(vocab, texts, n, solved)):
                    pieces.append(ids)
                    scores.append(score)
                    same.append(decode_ids(vocab, ids.tolist()) == body)
                    alternatives.append([{"score": s, "swaps": [{"at": a, "removed": r, "ids": i} for a, r, i in w]} for s, w in alt])
                sizes = [len(ids) for ids in pieces]
                flat = np.concatenate([np.empty(0, np.int32), *pieces]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
                columns = [listed, pa.array(sizes, pa.int64()), pa.array(scores, pa.float64()), pa.array(same, pa.bool_()), pa.array(alternatives, others)]
                kept = [b.column(i) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*b.schema.names[:-1], "ids", "n_pieces", "score", "round_trip", "alternatives"])

    return rows.mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch):
    """A batch in parts of about CHARS bytes of text; a text stays whole."""
    sizes = np.cumsum(pc.binary_length(batch.column("_text")).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        done = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, done + CHARS, side="right")))
        yield batch.slice(first, last - first)
        first = last


def decode(df: DataFrame, ids: str, keep, model: str) -> DataFrame:
    """``keep`` columns and the text of the ids; null for null."""
    rows = df.select(*keep, F.col(ids).alias("_ids"))

    def run(batches):
        vocab = Vocabulary(model)
        for b in batches:
            held = b.column("_ids")
            # One row's ids at a time become Python numbers.
            texts = [None if not one.is_valid else decode_ids(vocab, one.values.to_pylist()) for one in held]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "decoded"])

    return rows.mapInArrow(run, rows.drop("_ids").schema.add("decoded", "string"))
