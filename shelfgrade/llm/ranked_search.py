"""The best documents for each query by saturated term frequencies, found through hashed max-sketches.

Index, one pass over the texts: a document's term counts fold into ``ROWS`` sketches with hashes of their own,
whose coordinate ``hash mod width`` holds the largest count of its terms (a term's impact grows with its count,
so this is the largest impact too; 255 stands for more). The width is the power of two that is at least ``ROOM``
times the number of distinct terms, so sketches grow with documents and stay sparse; they are stored compressed.
The same pass counts in how many documents each term occurs.

Search, for blocks of queries: a block's terms are looked up in all sketches of a batch at once, and one matrix
product gives upper bounds of all scores (coordinates hold at least the term's own count, and the least of a
term's coordinates is taken). The
``FIRST`` documents of the highest bounds are scored exactly; the k-th best score is a query's threshold. Documents with
a bound at or above the threshold follow in waves of descending bounds, each of which raises the threshold,
until none is left; only the texts of such documents are read again. The wave size grows by ``GROWTH``.

The driver holds one block of queries: at most ``BLOCK_ITEMS`` of them, and ``BLOCK_TERMS`` terms or one query.
Terms are told apart by 64-bit hashes. Equal texts meet by hash, and the rows of a text that many
documents hold are dealt over the tasks.

Defined results: a missing or empty text has no terms and no score; a query without terms, or whose terms no
document has, has no rows; each row of the queries is ranked by itself, also when ids repeat; repeated documents
are ranked each; equal scores come by ascending document key, missing keys last; an empty table gives no rows.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from shelfgrade.operators.joins import hot_keys, join_counted
from shelfgrade.staging import scope, scratch_path, stage

ROOM = 4
ROWS = 3
FIRST = 32
GROWTH = 8
BLOCK_ITEMS = 256
BLOCK_TERMS = 1 << 15
TERMS_HELD = 1 << 19  # hashes, or counted terms, that a worker holds
TEXT_BYTES = 1 << 23
CELLS = 1 << 22  # of documents x terms that are looked up at once
_TERM = set(string.ascii_letters.encode() + string.digits.encode()) | set(range(0x80, 0x100))
_TABLE = bytes(ord(chr(b).lower()) if b in _TERM and b < 0x80 else b if b in _TERM else 0x20 for b in range(256))


class _Hashes(dict):
    def __missing__(self, term: bytes) -> int:
        value = xxhash.xxh64_intdigest(term)
        if len(term) <= 64:
            if len(self) >= TERMS_HELD:
                self.clear()
            self[term] = value
        return value


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def term_hashes(terms: list[bytes], hashes: _Hashes) -> np.ndarray:
    """The hashes of terms, as signed numbers."""
    return np.fromiter(map(hashes.__getitem__, terms), np.uint64, len(terms)).view(np.int64)


def coordinates(terms: np.ndarray, row: int, width: int) -> np.ndarray:
    """Where term hashes fold to: each sketch takes 20 bits of its own."""
    return (terms >> (20 * row)) & (width - 1) if width <= 1 << 20 else (terms >> (11 * row)) & (width - 1)


def sketches_of(terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The largest count of each coordinate; terms that occur more often than 254 times count as 255."""
    width = 16
    while width < ROOM * len(terms):
        width *= 2
    order = np.argsort(counts, kind="stable")
    terms, counts = terms[order], np.minimum(counts[order], 255).astype(np.uint8)
    out = np.zeros((ROWS, width), np.uint8)
    for row in range(ROWS):
        out[row, coordinates(terms, row, width)] = counts  # the last, largest count stays
    return out


def impact(counts, length_part):
    """Saturated counts: ``1e9 tf div (1000 tf + 8 m)``."""
    return (1_000_000_000 * counts) // (1000 * counts + 8 * length_part)


def length_part(n, documents: int, all_terms: int):
    """The part m of a document of n terms."""
    return 100 - 75 + (75 * n * documents) // all_terms


def _texts(batches):
    """(rows, terms of each) of slices whose texts are bounded together."""
    for batch in batches:
        first, held = 0, 0
        texts = batch.column("_text")
        for i in range(batch.num_rows):
            size = len(texts[i].as_buffer())
            if i > first and held + size > TEXT_BYTES:
                yield batch.slice(first, i - first), map(terms_of, texts.slice(first, i - first).to_pylist())
                first, held = i, 0
            held += size
        if first < batch.num_rows:
            yield batch.slice(first), map(terms_of, texts.slice(first).to_pylist())


def build_index(docs: DataFrame, text: str) -> DataFrame:
    """Rows (hash, n, width, sketches) of documents, and (term, df) of parts of the documents."""
    kept = docs.select(F.xxhash64(F.col(f"`{text}`")).alias("hash"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("_text"))

    def run(batches):
        hashes, codec = _Hashes(), pa.Codec("zstd")
        terms, sums = np.empty(0, np.int64), np.empty(0, np.int64)

        def counted():
            m = len(terms)
            none = pa.nulls(m, pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.nulls(m, pa.binary()), pa.array(terms), pa.array(sums)], names=names)

        for rows, found in _texts(batches):
            own = [np.unique(term_hashes(f, hashes), return_counts=True) for f in found]
            folded = [sketches_of(t, c) for t, c in own]
            packed = [codec.compress(f.tobytes(), asbytes=True) for f in folded]
            sizes, widths = (pa.array(v, pa.int64()) for v in ([int(c.sum()) for _, c in own], [f.shape[1] for f in folded]))
            none = pa.nulls(len(own), pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), sizes, widths, pa.array(packed, pa.binary()), none, none], names=names)
            now, n = np.unique(np.concatenate([t for t, _ in own]), return_counts=True)
            terms, where = np.unique(np.concatenate([terms, now]), return_inverse=True)
            sums = np.bincount(where, weights=np.concatenate([sums, n]), minlength=len(terms)).astype(np.int64)
            if len(terms) > TERMS_HELD:
                yield counted()
                terms, sums = terms[:0], sums[:0]
        if len(terms):
            yield counted()

    names = ["hash", "n", "width", "sketches", "term", "df"]
    return kept.mapInArrow(run, "hash long, n long, width long, sketches binary, term long, df long")


class Block:
    """Some queries: their terms, and weights times occurrences as a matrix terms x queries."""

    def __init__(self, items: list[list[bytes]], frequency: dict[int, int], documents: int, all_terms: int):
        self.documents, self.all_terms = documents, all_terms
        words = sorted({w for item in items for w in item})
        hashed = term_hashes(words, _Hashes())
        known = [i for i, h in enumerate(hashed) if int(h) in frequency]
        self.terms = hashed[known]
        # Places from 1, as 0 would be passed over.
        self.places = {words[i]: place for place, i in enumerate(known, 1)}
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency[int(t)] + 1))) for t in self.terms], np.int64)
        self.of, self.weights = [], []
        for item in items:
            at, times = np.unique([self.places[w] - 1 for w in item if w in self.places], return_counts=True)
            self.of.append(at.astype(np.int64))
            self.weights.append(weight[self.of[-1]] * times)

    def matrix(self) -> np.ndarray:
        out = np.zeros((len(self.terms), len(self.of)), np.float32)
        for q, (at, weights) in enumerate(zip(self.of, self.weights)):
            out[at, q] = weights
        return out

    def bounds(self, sketches: np.ndarray, sizes: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """Upper bounds, documents x queries, of documents x rows x coordinates of one width."""
        width = sketches.shape[2]
        counts = sketches[:, 0, coordinates(self.terms, 0, width)]
        for row in range(1, ROWS):
            np.minimum(counts, sketches[:, row, coordinates(self.terms, row, width)], out=counts)
        many, counts = counts == 255, counts.astype(np.float32)
        parts = (8 * length_part(sizes, self.documents, self.all_terms)).astype(np.float32)[:, None]
        highest = np.where(many, np.float32(1e6), 1e9 * counts / (1000 * counts + parts))
        # Single precision errs by less than the margin.
        return highest @ matrix * 1.001

    def counts(self, terms: list[bytes]) -> np.ndarray:
        """How often each term of the block is among ``terms``."""
        found = np.fromiter(filter(None, map(self.places.get, terms)), np.int64)
        return np.bincount(found, minlength=len(self.terms) + 1)[1:]

    def score(self, counts: np.ndarray, n: int, query: int) -> int:
        """The exact score of a document of n terms with these counts."""
        found = counts[self.of[query]]
        return int((self.weights[query] * impact(found, int(length_part(n, self.documents, self.all_terms)))).sum())


def _bounded(rows: DataFrame, block: Block, least: list[float], k: int | None) -> DataFrame:
    """(query, hash, bound) at or above ``least``; of each slice of rows the ``k`` highest if given."""
    floors = np.maximum(np.array(least, np.float64), 1.0)

    def run(batches):
        matrix, codec = block.matrix(), pa.Codec("zstd")
        for batch in batches:
            packed = batch.column("sketches")
            hashes, sizes, widths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hash", "n", "width"))
            for width in np.unique(widths):
                places = np.flatnonzero(widths == width)
                step = max(1, CELLS // max(1, len(block.terms) + len(block.of), ROWS * width))
                for at in range(0, len(places), step):
                    own = places[at : at + step]
                    size = int(ROWS * width)
                    held = b"".join(codec.decompress(packed[int(i)].as_buffer(), size, asbytes=True) for i in own)
                    held = np.frombuffer(held, np.uint8).reshape(-1, ROWS, width)
                    bounds = block.bounds(held, sizes[own], matrix)
                    fits = bounds >= floors
                    if k is not None and k < len(own):
                        lowest = np.partition(bounds, len(own) - k, axis=0)[len(own) - k]
                        fits &= bounds >= lowest
                    d, q = np.nonzero(fits)
                    yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(hashes[own][d]), pa.array(bounds[d, q].astype(np.float64))], names=["query", "hash", "bound"])

    return rows.select("hash", "n", "width", "sketches").mapInArrow(run, "query int, hash long, bound double")


def _scored(docs: DataFrame, asked: DataFrame, hot: DataFrame, block: Block) -> DataFrame:
    """(query, key, score) of the documents whose text is asked for."""
    queries = asked.groupBy("hash").agg(F.collect_set("query").alias("queries"))
    met = join_counted(docs, queries, ["hash"], ["key"], hot=hot)

    def run(batches):
        for rows, found in _texts(batches):
            out, at = [], []
            for i, (own, asked_by) in enumerate(zip(found, rows.column("queries").to_pylist())):
                counts = block.counts(own)
                for q in asked_by:
                    if score := block.score(counts, len(own), q):
                        out.append((q, score))
                        at.append(i)
            keys = rows.column("key").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in out], pa.int32()), keys, pa.array([s for _, s in out], pa.int64())], names=["query", "key", "score"])

    read = met.select("key", "queries", F.col("text").cast("binary").alias("_text"))
    kind = docs.schema["key"].dataType.simpleString()
    return read.mapInArrow(run, f"query int, key {kind}, score long")


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(docs: DataFrame, index: DataFrame, hot: DataFrame, block: Block, k: int) -> DataFrame:
    """(query, rank, key, score) for a block."""
    n_queries = len(block.of)
    lookup = index.where("n > 0")
    highest = Window.partitionBy("query").orderBy(F.desc("bound"), "hash")
    place = F.row_number().over(highest)
    first = _bounded(lookup, block, [0.0] * n_queries, FIRST).withColumn("place", place).where(F.col("place") <= FIRST)
    asked = stage(first.select("query", "hash"), "asked").frame
    best = stage(_best(_scored(docs, asked, hot, block), k), "best").frame

    def thresholds() -> list[float]:
        found = {r["query"]: r["score"] for r in best.where(F.col("rank") == k).collect()}  # one row a query
        return [found.get(q, 0.0) for q in range(n_queries)]

    least = thresholds()
    left = stage(_bounded(lookup, block, least, None).join(asked, ["query", "hash"], "left_anti"), "left").frame
    wave = FIRST * GROWTH
    while True:
        floors = docs.sparkSession.createDataFrame(list(enumerate(map(float, least))), "query int, least double")
        open_ones = left.join(F.broadcast(floors), "query").where("bound >= least").drop("least")  # a row a query of the block
        ranked = stage(open_ones.withColumn("place", place), "ranked").frame
        now = ranked.where(F.col("place") <= wave).select("query", "hash")
        if now.isEmpty():
            return best
        best = stage(_best(_scored(docs, now, hot, block).unionByName(best.drop("rank")), k), "best").frame
        left, least, wave = ranked.where(F.col("place") > wave).drop("place"), thresholds(), wave * GROWTH


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Blocks of (id, terms), from one row of the table at a time."""
    block, terms = [], 0
    for row in items.toLocalIterator():
        found = terms_of(row["text"].encode())
        size = len(set(found))
        if block and (len(block) == BLOCK_ITEMS or terms + size > BLOCK_TERMS):
            yield block
            block, terms = [], 0
        block.append((row["id"], found))
        terms += size
    if block:
        yield block


def ranked_search(docs: DataFrame, key: str, items: DataFrame, item_key: str, text: str = "text", item_text: str = "text", k: int = 10) -> DataFrame:
    """(item key, rank, document key, score): the ``k`` documents of the highest scores above 0 for each item."""
    spark = docs.sparkSession
    queries = items.select(F.col(f"`{item_key}`").alias("id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text"))
    id_type = queries.schema["id"].dataType
    named = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("hash")).where("text IS NOT NULL")
    out = scratch_path(spark, "ranked")  # of the caller's scope
    blocks = 0
    with scope(spark):
        both = stage(build_index(docs, text), "sketches").frame
        # Equal texts have equal sketches; one of them is looked up.
        index = both.where("term IS NULL")
        documents, all_terms = index.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        hot = stage(hot_keys(index, ["hash"]), "hot").frame
        frequencies = stage(both.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")), "frequencies").frame
        distinct = stage(index.dropDuplicates(["hash"]), "distinct-sketches").frame
        for block in _blocks(queries) if documents else ():
            terms = set(term_hashes([t for _, found in block for t in found], _Hashes()).tolist())
            blocks += 1
            with scope(spark):
                asked = spark.createDataFrame([(t,) for t in terms], "term long")
                known = {r["term"]: r["df"] for r in frequencies.join(F.broadcast(asked), "term").collect()}  # at most a block's terms
                found = _search(named, distinct, hot, Block([f for _, f in block], known, documents, all_terms), k)
                ids = spark.createDataFrame([(q, own) for q, (own, _) in enumerate(block)], f"query int, id {id_type.simpleString()}")
                rows = found.join(F.broadcast(ids), "query").select(F.col("id").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")
                rows.write.mode("append").parquet(out)
    if not blocks:
        key_type = docs.schema[key].dataType.simpleString()
        return spark.createDataFrame([], f"`{item_key}` {id_type.simpleString()}, rank int, `{key}` {key_type}, score long")
    return spark.read.parquet(out)
