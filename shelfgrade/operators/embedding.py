"""Dense text vectors without a model file: texts projected on the leading directions of their weighted words.

Words are hashed to ``size`` buckets; a text is the unit vector of its dampened counts, weighted by rarity over all
texts. The directions are leading right singular vectors of that texts x buckets matrix, found by a randomised
range finder: a few passes over all texts, each of which sums ``a (a' Q)`` over the texts ``a``. A pass shuffles one partial sum a
task (``size`` x (``dims`` + ``extra``) numbers), with the number of tasks set by ``tasks``, and the driver holds
one such sum: both are fixed by parameters and do not grow with the texts. A lost task is run again alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col
from ..staging import scope, stage

DIMS = 384
SIZE = 4096
EXTRA = 16  # directions carried beside those that are kept
PASSES = 3
BLOCK = 1 << 21  # numbers in the matrix of the texts that are multiplied at once


def word_buckets(text: str = "text", size: int = SIZE) -> Column:
    """The bucket of every word of two or more letters or digits, with repeats; none for a missing text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]{2,}"), 0)
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))


def _unit_texts(texts: pa.ListArray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some texts at a time: the buckets that occur in them and, a row a text, its (1 + ln count) x weight of each,
    scaled to length 1; zeros without a weighted word. Their number is set by that of all buckets."""
    block = max(1, BLOCK // len(weights))
    for first in range(0, len(texts), block):
        some = texts.slice(first, block)
        words = some.flatten().to_numpy()
        lengths = some.value_lengths().fill_null(0).to_numpy()
        at, place = np.unique(words, return_inverse=True)
        counts = np.bincount(np.repeat(np.arange(len(some)) * len(at), lengths) + place, minlength=len(some) * len(at))
        rows = np.zeros(len(counts))
        held = np.flatnonzero(counts)
        rows[held] = 1 + np.log(counts[held])
        rows = rows.reshape(len(some), len(at)) * weights[at]
        squares = np.einsum("ij,ij->i", rows, rows)
        yield at, rows / np.sqrt(np.where(squares > 0, squares, 1))[:, None]


def _summed(buckets: DataFrame, weights: np.ndarray, basis: np.ndarray, tasks: int, products: type = np.float64) -> tuple[np.ndarray, float]:
    """The sum of ``a (a' basis)`` over all texts, and the sum of their squared lengths. The products within a block
    of texts are taken in ``products``; sums over blocks are always doubles."""
    size, width = basis.shape
    basis = basis.astype(products)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros((size, width)), 0.0
        for batch in batches:
            # A block of texts touches only the rows of its own buckets.
            for at, rows in _unit_texts(batch.column(0), weights):
                squares += float(np.einsum("ij,ij->", rows, rows))
                rows = rows.astype(products, copy=False)
                total[at] += rows.T @ (rows @ basis[at])
        # The squared lengths go in a row of their own, under the number behind the last bucket.
        total = np.vstack([total, np.full((1, width), squares)])
        held = np.flatnonzero(total.any(axis=1))
        for first in range(0, len(held), 512):
            some = held[first : first + 512]
            values = pa.ListArray.from_arrays(
                pa.array(np.arange(len(some) + 1) * width, pa.int32()), pa.array(total[some].ravel())
            )
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), values], ["bucket", "part"])

    parts = buckets.coalesce(tasks).mapInArrow(partial, "bucket int, part array<double>")
    added = parts.groupBy("bucket").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("total")).toArrow()
    out = np.zeros((size + 1, width))
    if added.num_rows:
        totals = added.column("total").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        out[added.column("bucket").to_numpy()] = totals.reshape(added.num_rows, width)
    return out[:size], float(out[size, 0])


@dataclass(frozen=True)
class TextDirections:
    """Weights of the buckets, orthonormal directions (buckets x dims), and the share of the sum of squares of
    all texts that lies along these directions."""

    weights: np.ndarray
    directions: np.ndarray
    share: float

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, float(w), d.tolist(), self.share) for i, (w, d) in enumerate(zip(self.weights, self.directions))]
        return spark.createDataFrame(rows, "bucket int, weight double, direction array<double>, share double")

    @classmethod
    def from_table(cls, table: DataFrame) -> TextDirections:
        rows = table.orderBy("bucket").collect()
        return cls(np.array([r["weight"] for r in rows]), np.array([r["direction"] for r in rows]), rows[0]["share"])


def fit_directions(df: DataFrame, text: str = "text", dims: int = DIMS, size: int = SIZE, passes: int = PASSES, extra: int = EXTRA, seed: int = 42, tasks: int | None = None, buckets: str | None = None) -> TextDirections:
    """The leading directions of all texts of ``df``. Fewer texts than ``dims`` leave directions without content,
    which are orthogonal to the others all the same. ``buckets`` names a column of a finished table that holds the
    ``word_buckets`` of the texts already; it is then read instead of the texts."""
    if not 0 < dims <= size:
        raise ValueError("dims must lie between 1 and size")
    if passes < 1:
        raise ValueError("at least one pass is needed")
    spark = df.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    with scope(spark):
        if buckets:
            found = df.select(col(buckets).alias("buckets"))
        else:
            found = stage(df.select(word_buckets(text, size).alias("buckets")), "buckets").frame
        held = found.select(F.explode(F.array_distinct("buckets")).alias("bucket")).groupBy("bucket").count().toArrow()
        texts = found.where(F.size("buckets") > 0).count()
        occurs = np.zeros(size)
        occurs[held.column("bucket").to_numpy()] = held.column("count").to_numpy()
        # A word of all texts keeps a small weight, so that no text of common words is left without a vector.
        weights = np.where(occurs > 0, np.log((texts + 1) / (occurs + 1)) + 1, 0.0)
        width = min(size, dims + extra)
        basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
        for _ in range(passes - 1):
            # These only turn the basis; the last pass, which weighs its directions, multiplies doubles.
            basis = np.linalg.qr(_summed(found, weights, basis, tasks, np.float32)[0])[0]
        total, squares = _summed(found, weights, basis, tasks)
    # The texts as seen in the basis: its eigenvectors turn the basis to the directions of most content.
    seen = basis.T @ total
    values, turned = np.linalg.eigh((seen + seen.T) / 2)
    first = np.argsort(values)[::-1][:dims]
    share = float(values[first].clip(0).sum() / squares) if squares else 0.0
    return TextDirections(weights, basis @ turned[:, first], share)


def embed_texts(df: DataFrame, model: TextDirections, text: str = "text", vector: str = "embedding", buckets: str | None = None) -> DataFrame:
    """Adds the vector of each text, of length 1; a text without a known word has all zeros. ``buckets`` names a column
    that holds the ``word_buckets`` of the texts already."""
    weights, directions = model.weights, model.directions

    @F.arrow_udf("array<float>")
    def projected(texts: pa.Array) -> pa.Array:
        out = [np.zeros((0, directions.shape[1]), np.float32)]
        for at, rows in _unit_texts(texts, weights):
            dense = rows @ directions[at]
            length = np.sqrt(np.einsum("ij,ij->i", dense, dense))[:, None]
            out.append(np.where(length > 1e-9, dense / np.where(length > 1e-9, length, 1), 0).astype(np.float32))
        ends = np.arange(len(texts) + 1) * directions.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out).ravel()))

    return df.withColumn(vector, projected(col(buckets) if buckets else word_buckets(text, len(weights))))
