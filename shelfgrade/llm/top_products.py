"""Exact highest inner products with norm-sorted vectors and pruned partial sums.

Vectors are rotated onto the singular directions of the set (from the sums of products of components, one
aggregate of dims x dims numbers), so that the first rotated components hold most of a vector's length.
They are ordered by falling norm and cut into blocks. For a query and a vector, the sum over the first
components plus the product of what is left of both lengths bounds the inner product (Cauchy-Schwarz).

The ``BLOCK`` longest vectors come first: their products give each query a threshold that its k-th best
cannot fall under. Then every part of the queries meets every block whose norms can reach a threshold, in a
task of its own. There vectors are dropped by norm, and after each slice of components by the bound;
products of what remains are counted in whole numbers. A task returns the k best per query, and Spark
merges these. A pair of blocks holds about two times ``BLOCK`` vectors whatever the table holds; a vector is
copied once for each part of queries that it may matter to.

Vectors of each length have a rotation and blocks of their own, one length after the other.

Defined results: vectors that are null, empty, or hold null or a non-finite component take no part, nor do
rows without an id; every row of the same length but the query's own is a candidate, also one with the same
id; equal scores go to the smaller id; empty tables give empty results.
Scores are exact as long as they stay under 2^53.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfgrade.staging import release, stage

BLOCK = 4096
QUERIES = 256  # queries of a part that are worked on together
SLICES = (16, 32)  # components after which the bound is tested
SLACK = 1e-6  # of the largest product, for rounding


def usable(vector: Column) -> Column:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(ok, F.lit(False))


def _pack(scale: float):
    def run(batches):
        for b in batches:
            column = b.column("v")
            numbers = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
            ends = np.cumsum(np.asarray(column.value_lengths(), np.int64))
            each = np.split(numbers, ends[:-1]) if len(ends) else []
            norms = np.array([np.sqrt((x.astype(np.float64) ** 2).sum()) for x in each], np.float64)
            columns = [b.column(n) for n in ("row", "id", "asks")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([x.tobytes() for x in each], pa.binary()), pa.array(norms), pa.array([len(x) for x in each], pa.int32())],
                names=["row", "id", "asks", "v", "norm", "dims"],
            )

    return run


def _matrix(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dims).astype(np.float64)


def rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """The right singular vectors of the matrix of all vectors, as columns, the strongest first."""

    def run(batches):
        total = np.zeros((dims, dims))
        for b in batches:
            x = _matrix(b.column("v"), dims)
            total += x.T @ x
        i, j = np.indices((dims, dims)).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    sums = vectors.select("v").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    gram = np.zeros((dims, dims))
    for r in sums:
        gram[r.i, r.j] = r.s
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]


class Candidates:
    """Vectors by falling norm, with their rotated components and what is left after each slice."""

    def __init__(self, rows, ids, vectors, turn):
        norms = np.sqrt((vectors**2).sum(axis=1))
        order = np.argsort(-norms, kind="stable")
        self.rows, self.ids, self.vectors, self.norms = rows[order], ids[order], vectors[order], norms[order]
        self.turned = self.vectors @ turn
        self.cuts = [s for s in SLICES if s < vectors.shape[1]]
        self.rest = {s: np.sqrt((self.turned[:, s:] ** 2).sum(axis=1)) for s in self.cuts}

    def best(self, rows, vectors, least, turn, k):
        """For each query (place, score) arrays of its k best candidates; those under ``least`` may be missing."""
        norms = np.sqrt((vectors**2).sum(axis=1))
        room = SLACK * (1 + norms.max(initial=0) * self.norms.max(initial=0))
        # Norms fall: from the first that is too short for every query the list ends.
        need = np.where(norms > 0, (least - room) / np.maximum(norms, 1e-300), np.where(least > room, np.inf, -np.inf))
        alive = np.arange(int(np.searchsorted(-self.norms, -need.min(initial=np.inf), side="right")))
        turned, done, sums = vectors @ turn, 0, np.zeros((len(alive), len(rows)))
        for s in self.cuts:
            sums += self.turned[alive, done:s] @ turned[:, done:s].T
            left = np.sqrt((turned[:, s:] ** 2).sum(axis=1))
            stay = (sums + self.rest[s][alive][:, None] * left + room >= least).any(axis=1)
            alive, sums, done = alive[stay], sums[stay], s
        scores = np.rint(self.vectors[alive] @ vectors.T)
        scores[self.rows[alive][:, None] == rows] = -np.inf
        for q in range(len(rows)):
            own = scores[:, q]
            places = np.flatnonzero(own > -np.inf)
            if len(places) > k:
                limit = np.partition(own, len(own) - k)[len(own) - k]
                places = np.flatnonzero(own >= limit)
            ids = self.ids[alive[places]]
            places = places[np.lexsort((self.rows[alive[places]], ids, -own[places]))[:k]]
            yield alive[places], own[places]


def _seed(head, turn, k: int):
    """Each query with the score of its k-th best among the longest vectors."""

    def run(batches):
        longest = Candidates(*head, turn)
        for b in batches:
            rows, x = b.column("row").to_numpy(), _matrix(b.column("v"), len(turn))
            least = np.full(len(rows), -np.inf)
            for at in range(0, len(rows), QUERIES):
                part = slice(at, at + QUERIES)
                for q, (_, scores) in enumerate(longest.best(rows[part], x[part], least[part], turn, k)):
                    if len(scores) == k:
                        least[at + q] = scores[-1]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in ("row", "id", "v", "norm")] + [pa.array(least)], names=["row", "id", "v", "norm", "least"])

    return run


def _meet(turn, k: int):
    dims = len(turn)
    names = ["query", "query_id", "vec_row", "vec_id", "score"]

    def work(tables):
        rows = pa.Table.from_batches(tables)
        asked = rows.filter(pc.equal(rows["side"], 0))
        held = rows.filter(pc.equal(rows["side"], 1))
        if not asked.num_rows or not held.num_rows:
            return
        candidates = Candidates(held["row"].to_numpy(), held["id"].to_numpy(), _matrix(held["v"], dims), turn)
        q_rows, q_ids, q, least = asked["row"].to_numpy(), asked["id"].to_numpy(), _matrix(asked["v"], dims), asked["least"].to_numpy()
        out = [[], [], [], [], []]
        for at in range(0, len(q_rows), QUERIES):
            part = slice(at, at + QUERIES)
            for i, (places, scores) in enumerate(candidates.best(q_rows[part], q[part], least[part], turn, k)):
                n = len(places)
                for column, values in zip(out, (np.full(n, q_rows[at + i]), np.full(n, q_ids[at + i]), candidates.rows[places], candidates.ids[places], scores.astype(np.int64))):
                    column.append(values)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=names)

    def run(batches):
        held, last = [], None
        for b in batches:
            keys = np.stack([b.column("block").to_numpy(), b.column("part").to_numpy()])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for first, end in zip([0, *cuts], [*cuts, b.num_rows]):
                if first == end:
                    continue
                if last is not None and last != tuple(keys[:, first]):
                    yield from work(held)
                    held = []
                held.append(b.slice(first, end - first))
                last = tuple(keys[:, first])
        if held:
            yield from work(held)

    return run


RESULT = "query_id long, rank int, vec_id long, score long"


def _of_length(vectors: DataFrame, dims: int, n: int, n_asks: int, k: int) -> DataFrame:
    """The k best of the asking rows among ``n`` vectors of ``dims`` components."""
    spark = vectors.sparkSession
    turn = rotation(vectors, dims)

    # A bounded number of vectors: the head goes to every task.
    longest = vectors.orderBy(F.desc("norm"), "row").limit(BLOCK).select("row", "id", "v").toArrow()
    head = (longest["row"].to_numpy(), longest["id"].to_numpy(), _matrix(longest["v"], dims))
    blocks = -(-n // BLOCK)
    parts = -(-n_asks // BLOCK)
    seeded = vectors.where("asks").select("row", "id", "v", "norm").mapInArrow(_seed(head, turn, k), "row long, id long, v binary, norm double, least double")
    queries = stage(seeded.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")), "queries")

    ordered = vectors.select("row", "id", "v", "norm").repartitionByRange(blocks, F.desc("norm"), F.xxhash64("row"))
    sorted_ = stage(ordered.withColumn("block", F.spark_partition_id()), "blocks")
    # What norm a part asks for at least; a little less, for rounding.
    need = queries.frame.groupBy("part").agg(F.min(F.when(F.col("norm") > 0, F.col("least") / F.col("norm")).otherwise(F.lit(float("-inf")))).alias("need"))
    reach = sorted_.frame.groupBy("block").agg(F.max("norm").alias("longest"))
    every = reach.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = stage(every.join(need, "part").where(F.col("longest") * (1 + SLACK) + SLACK >= F.col("need")).select("block", "part"), "pairs")

    columns = ["block", "part", "row", "id", "v", "least", "side"]
    asked = queries.frame.join(pairs.frame, "part").withColumn("side", F.lit(0)).select(columns)
    held = sorted_.frame.join(pairs.frame, "block").withColumn("least", F.lit(None).cast("double")).withColumn("side", F.lit(1)).select(columns)
    met = asked.unionByName(held).repartition("block", "part").sortWithinPartitions("block", "part", "side")
    found = met.mapInArrow(_meet(turn, k), "query long, query_id long, vec_row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "vec_row"))
    result = stage(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "products").frame
    for scratch in (queries, sorted_, pairs):
        release(spark, scratch.path)
    return result


def top_products(df: DataFrame, key: str, vector: str, asks: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id and score: the k highest products of each asking row with all other rows of its length.

    Components are counted as floor(scale * x).
    """
    spark = df.sparkSession
    named = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(vector).alias("v"))
    packed = named.where(usable(F.col("v")) & F.col("id").isNotNull()).mapInArrow(_pack(scale), "row long, id long, asks boolean, v binary, norm double, dims int")
    kept = stage(packed, "vectors")
    # A vector that is alone in its length has no candidate; a length that nobody asks in gives no rows.
    sizes = kept.frame.groupBy("dims").agg(F.count("*").alias("n"), F.count_if("asks").alias("n_asks"))
    lengths = sizes.where("n > 1 AND n_asks > 0").orderBy("dims").collect()
    found = [_of_length(kept.frame.where(F.col("dims") == r.dims), r.dims, r.n, r.n_asks, k) for r in lengths]
    release(spark, kept.path)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], RESULT)
