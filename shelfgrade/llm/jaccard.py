"""Groups of documents whose word shingles overlap by a Jaccard similarity of ``percent`` or more.

A document's set are its distinct shingles as 64-bit hashes; two different shingles of a pair of documents
share a hash with a chance of about n^2 / 2^65. Equal sets are folded to one, so that copies cost a row
each and no pairs.

Rare first: all sets are put in one order of the shingles, and a linked pair shares one of its first
``n - ceil(0.9 n) + 1``. Shingles of the first ring (a quarter of the hash space) come before all others, and
within a ring those that fewer documents hold come first. So only a quarter of the shingles is counted and
shuffled, from which a document takes its rarest, about two in five; documents with too few shingles in the
first ring bring all they have. Shingles of a single document join with nothing and are only counted as places.

Candidates: documents meet in the list of each shared prefix shingle. Lists over ``BLOCK`` rows are cut
into parts, and every two parts meet in a task of their own. Pairs are dropped by the length filter, by the
positional filter (what can still be shared behind the places of the common shingle) and by the suffix filter
(sets are partitioned by hash into 128 cells, and the differences of the cells' sizes bound the Hamming
distance). A list of n alike documents has about n^2 / 2 candidates, so a task first proposes a spanning forest
of them only; each proposed pair is verified once on the full sets, and components are joined. Where a
pair of a forest is no link, the full sets are sent to the cluster that the forests make, whose task verifies all
candidates that lie between different components, so no link between components is lost; only links leave it.

Defined results: a missing or empty text, or one of white space only, has no set: n_shingles is 0 and the
document is its own component; a text with fewer words than a shingle is one shingle; repeated rows are
members like others; ``component_id`` is the smallest key of the group, missing keys passed over; an empty
table has no groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from shelfgrade.operators.joins import hot_keys, join_counted
from shelfgrade.staging import scope, stage

from .components import connected_components

PERCENT = 90
BLOCK = 1024
SHORT = 8  # rows of lists whose pairs are all proposed
CELLS = 128
HELD = 1 << 20  # shingles of a part of a cluster
WORDS_HELD = 1 << 19  # word hashes a worker remembers
FILTER_WORDS = 1 << 17
TEXT_BYTES = 1 << 23  # of texts that are split at once
_NONE = np.empty(0, np.int64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= WORDS_HELD:
                self.clear()
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, size: int = 3, hashes: _WordHashes | None = None) -> np.ndarray:
    """The distinct shingles of a text, as sorted hashes."""
    words = text.lower().split()  # of bytes: A-Z, and white space of ASCII
    of = (_WordHashes() if hashes is None else hashes).__getitem__
    codes = np.fromiter(map(of, words), np.uint64, len(words))
    width = min(size, len(codes))
    if not width:
        return codes
    places = len(codes) - width + 1
    rolled = np.full(places, width, np.uint64)
    for k in range(width):
        rolled = _mixed(rolled * _ODD + codes[k : k + places])
    return np.unique(rolled)


def prefix_length(n):
    return n - (PERCENT * n + 99) // 100 + 1


def _reach(shingles: np.ndarray) -> np.ndarray:
    """The shingles that are counted: those of the first ring, or all if these are few."""
    ring = shingles[(shingles & np.uint64(3)) == 0]
    return ring if len(ring) >= 2 * prefix_length(len(shingles)) else shingles


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _slices(batch: pa.RecordBatch, column: str):
    """Parts of a batch whose texts are at most ``TEXT_BYTES`` together, or one text."""
    sizes = np.fromiter((len(t) if (t := v.as_buffer()) else 0 for v in batch.column(column)), np.int64, batch.num_rows)
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > TEXT_BYTES:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if first < batch.num_rows:
        yield batch.slice(first)


def with_sets(df: DataFrame, text: str, keep, size: int = 3) -> DataFrame:
    """``keep`` columns, n, a digest (d1, d2) of the set, its counted shingles and its cells."""
    kept = df.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    schema = kept.drop("_text").schema.add("n", "long").add("d1", "long").add("d2", "long").add("reach", ArrayType(LongType())).add("cells", "binary")

    def run(batches):
        hashes = _WordHashes()
        for batch in batches:
            for part in _slices(batch, "_text"):
                sets = [shingle_set(t, size, hashes) for t in part.column("_text").to_pylist()]
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                cells = [np.minimum(np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes() for s in sets]
                own = [part.column(i) for i in range(part.num_columns - 1)]
                found = [pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), _lists([_reach(s) for s in sets]), pa.array(cells, pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, *found], names=schema.names)

    return kept.mapInArrow(run, schema)


def with_shingles(df: DataFrame, text: str, key: str, size: int = 3) -> DataFrame:
    """``key`` and the whole set."""
    kept = df.select(key, F.col(text).cast("binary").alias("_text"))

    def run(batches):
        hashes = _WordHashes()
        for batch in batches:
            for part in _slices(batch, "_text"):
                sets = [shingle_set(t, size, hashes) for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(sets)], names=[key, "shingles"])

    return kept.mapInArrow(run, kept.drop("_text").schema.add("shingles", ArrayType(LongType())))


def prefixes(sets: DataFrame) -> DataFrame:
    """(sid, token, pos): the prefix shingles that other documents hold too, and their places."""
    tokens = sets.select("sid", F.explode("reach").alias("token"))
    counts = stage(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shingle-counts").frame
    late = F.col("token").bitwiseAND(F.lit(3)) != 0
    shared = tokens.join(counts, "token").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct(late.alias("late"), "df", "token"))).alias("shared"), F.count_if(~late).alias("first"), F.count("*").alias("all"))
    in_ring = F.size(F.filter("reach", lambda t: t.bitwiseAND(F.lit(3)) == 0))
    length = F.expr(f"n - ({PERCENT} * n + 99) div 100 + 1")
    own = sets.select("sid", length.alias("length"), in_ring.alias("ring"), F.size("reach").alias("reached"))
    # Shingles of this document alone come first in their ring.
    alone, alone_late = F.col("ring") - F.col("first"), F.col("reached") - F.col("all")
    taken = F.least(F.greatest(F.col("length") - alone, F.lit(0)), F.col("first")) + F.greatest(F.col("length") - alone_late - F.col("first"), F.lit(0))
    cut = own.join(shared, "sid").select("sid", alone.alias("alone"), alone_late.alias("alone_late"), F.slice("shared", F.lit(1), F.least(taken, F.col("all")).cast("int")).alias("cut"))
    placed = cut.select("sid", "alone", "alone_late", F.posexplode("cut").alias("k", "s"))
    return placed.select("sid", F.col("s.token").alias("token"), (F.col("k") + F.when(F.col("s.late"), F.col("alone_late")).otherwise(F.col("alone"))).alias("pos"))


def _near(n, pos, cells, x, y) -> np.ndarray:
    """Which pairs of places (x, y), n[x] <= n[y], pass the length, positional and suffix filters."""
    a, b = n[x], n[y]
    overlap = (PERCENT * (a + b) + 99 + PERCENT) // (100 + PERCENT)
    may = np.flatnonzero((100 * a >= PERCENT * b) & (np.minimum(a - pos[x], b - pos[y]) >= overlap))
    out = np.zeros(len(x), bool)
    for at in range(0, len(may), 1 << 14):
        i = may[at : at + (1 << 14)]
        apart = np.abs(cells[x[i]].astype(np.int16) - cells[y[i]]).sum(axis=1, dtype=np.int64)
        out[i] = apart <= (a + b - 2 * overlap)[i]
    return out


def candidates(n: np.ndarray, pos: np.ndarray, cells: np.ndarray, label: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a list's places that pass the filters and have different labels: all, or a spanning forest.

    ``n`` must be sorted. In a forest, labels are joined as its pairs are found.
    """
    label = label.copy()
    found_a, found_b = [], []
    ends = np.searchsorted(n, n * 100 // PERCENT, side="right")
    first, step = 0, 1
    while first < len(n):
        rows = np.arange(first, min(len(n), first + step))
        columns = np.arange(first + 1, ends[rows[-1]])
        first, step = rows[-1] + 1, min(256, step * 4)
        i, j = np.nonzero((columns[None, :] > rows[:, None]) & (label[rows][:, None] != label[columns][None, :]))
        x, y = rows[i], columns[j]
        near = _near(n, pos, cells, x, y)
        x, y = x[near], y[near]
        if whole:
            found_a.append(x)
            found_b.append(y)
            continue
        for p in np.unique(x):
            others = y[x == p]
            chosen = others[np.unique(label[others], return_index=True)[1]]
            chosen = chosen[label[chosen] != label[p]]
            if len(chosen):
                label[np.isin(label, label[chosen])] = label[p]
                found_a.append(np.full(len(chosen), p))
                found_b.append(chosen)
    return np.concatenate([*found_a, _NONE]), np.concatenate([*found_b, _NONE])


def links_within(n: np.ndarray, pos: np.ndarray, cells: np.ndarray, label: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between places that have different labels.

    ``n`` must be sorted; ``flat`` holds the whole sets one after the other. All candidates are counted on them.
    """
    label = label.copy()
    found_a, found_b = [], []
    ends = np.searchsorted(n, n * 100 // PERCENT, side="right")
    starts = np.concatenate([[0], np.cumsum(n)])
    names, codes = np.unique(flat, return_inverse=True)
    marks = np.zeros(len(names), bool)
    for x in range(len(n)):
        y = np.arange(x + 1, ends[x])
        y = y[label[y] != label[x]]
        y = y[_near(n, pos, cells, np.full(len(y), x), y)]
        if not len(y):
            continue
        own = codes[starts[x] : starts[x + 1]]
        marks[own] = True
        sizes = n[y]
        firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        places = np.arange(sizes.sum()) + np.repeat(starts[y] - firsts, sizes)
        shared = np.add.reduceat(marks[codes[places]], firsts, dtype=np.int64)
        marks[own] = False
        y = y[100 * shared >= PERCENT * (n[x] + sizes - shared)]
        chosen = y[np.unique(label[y], return_index=True)[1]]
        if len(chosen):
            label[np.isin(label, label[chosen])] = label[x]
            found_a.append(np.full(len(chosen), x))
            found_b.append(chosen)
    return np.concatenate([*found_a, _NONE]), np.concatenate([*found_b, _NONE])


def _proposals():
    schema = pa.schema([("token", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    numbers = ("token", "lo", "hi", "sid", "label", "n", "pos")

    def pairs(columns, cells):
        """Candidates of whole lists, whose rows follow each other, sorted by n."""
        token, lo, hi, sid, label, n, pos = columns
        new = np.concatenate([[True], (columns[:3, 1:] != columns[:3, :-1]).any(axis=0)])
        starts = np.append(np.flatnonzero(new), len(sid))
        sizes = np.diff(starts)
        number = np.repeat(np.arange(len(sizes)), sizes)
        short = np.flatnonzero(np.repeat(sizes <= SHORT, sizes))
        a, b = [], []
        for d in range(1, SHORT):
            x = short[short + d < len(sid)]
            x = x[(number[x] == number[x + d]) & (label[x] != label[x + d])]
            x = x[_near(n, pos, cells, x, x + d)]
            a.append(x)
            b.append(x + d)
        for k in np.flatnonzero(sizes > SHORT):
            at = slice(starts[k], starts[k + 1])
            x, y = candidates(n[at], pos[at], cells[at], label[at], False)
            a.append(x + starts[k])
            b.append(y + starts[k])
        x, a, b = np.concatenate(a), sid[np.concatenate(a)], sid[np.concatenate(b)]
        return pa.RecordBatch.from_arrays([pa.array(token[x]), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

    def run(batches):
        held, held_cells = np.empty((len(numbers), 0), np.int64), np.empty((0, CELLS), np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            now = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in numbers])
            held = np.concatenate([held, now], axis=1)
            held_cells = np.concatenate([held_cells, np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(-1, CELLS)])
            # The last list may go on in the next batch.
            differs = np.flatnonzero((held[:3] != held[:3, -1:]).any(axis=0))
            cut = differs[-1] + 1 if len(differs) else 0
            if cut:
                yield pairs(held[:, :cut], held_cells[:cut])
                held, held_cells = held[:, cut:], held_cells[cut:]
        if held.shape[1]:
            yield pairs(held, held_cells)

    return run


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of lists or clusters (token, sid, parts), every two parts of a list in a task of their own, sorted by n."""
    part = F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: (p != F.col("part")) | (F.col("parts") == 1))
    met = rows.withColumn("part", part).withColumn("other", F.explode(others))
    group = ["token", "lo", "hi"]
    met = met.select("token", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "sid", *columns)
    return met.repartition(*group).sortWithinPartitions(*group, "n")


def _propose(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """(token, a, b): a spanning forest of each list's candidate pairs."""
    met = _dealt(lists.join(sets, "sid").withColumn("label", F.col("sid")), "label", "n", "pos", "cells")
    return met.mapInArrow(_proposals(), "token long, a long, b long")


def _settled():
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    numbers = ("token", "lo", "hi", "sid", "label", "n", "pos")

    def links(parts):
        """Links of one cluster, whose rows are sorted by n."""
        _, _, _, sid, label, n, pos = np.concatenate([p[0] for p in parts], axis=1)
        cells = np.concatenate([p[1] for p in parts])
        x, y = links_within(n, pos, cells, label, np.concatenate([p[2] for p in parts]))
        x, y = sid[x], sid[y]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=schema)

    def run(batches):
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in numbers])
            cells = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(-1, CELLS)
            flat, ends = batch.column("shingles").flatten().to_numpy(), np.concatenate([[0], np.cumsum(now[5])])
            cuts = [0, *(np.flatnonzero((now[:3, 1:] != now[:3, :-1]).any(axis=0)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                # The last list may go on in the next batch.
                if held and (held[-1][0][:3, 0] != now[:3, a]).any():
                    yield links(held)
                    held = []
                held.append((now[:, a:b], cells[a:b], flat[ends[a] : ends[b]]))
        if held:
            yield links(held)

    return run


def _settle(forest: DataFrame, sets: DataFrame, bodies: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the links between different components of ``roots``.

    The forests of the lists connect what is a candidate in some list, so all candidates lie inside the clusters that
    ``forest`` makes. A set is sent once to its cluster and a pair is counted where it is found: no candidate pairs,
    whose number grows with the square of a cluster, are written, and no more links leave a task than it has rows.
    """
    clusters = connected_components(forest.select("a", "b")).select(F.col("node").alias("sid"), F.col("root").alias("token"))
    labelled = clusters.join(sets, "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("root", "sid")).drop("root")
    rows = stage(labelled, "clusters").frame
    spans = rows.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.sum("n").alias("held")).where("least < most")
    # Two parts of a cluster, of about as many shingles, are held at a time.
    parts = F.ceil(F.col("held") / HELD).cast("int")
    met = rows.join(spans.select("token", parts.alias("parts")), "token").join(bodies, "sid").withColumn("pos", F.lit(0))
    return _dealt(met, "label", "n", "pos", "cells", "shingles").mapInArrow(_settled(), "a long, b long").distinct()


def _verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs, and whether their sets overlap enough."""
    a = bodies.select(F.col("sid").alias("a"), F.col("shingles").alias("of_a"))
    b = bodies.select(F.col("sid").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(a, "a").join(b, "b").withColumn("shared", F.size(F.array_intersect("of_a", "of_b")))
    union = F.size("of_a") + F.size("of_b") - F.col("shared")
    return both.select("a", "b", (100 * F.col("shared") >= PERCENT * union).alias("linked"))


def _links(lists: DataFrame, sets: DataFrame, bodies: DataFrame) -> DataFrame:
    """(a, b): verified links that connect what all links connect."""
    forest = stage(_propose(lists, sets), "proposals").frame
    known = stage(_verified(forest.select("a", "b").distinct(), bodies), "verified").frame
    links, refused = known.where("linked").select("a", "b"), known.where("NOT linked").select("a", "b")
    # Where all pairs of a list's forest are links, its candidates are connected already.
    if refused.isEmpty():
        return links
    more = stage(_settle(forest.select("a", "b").distinct(), sets, bodies, connected_components(links)), "settled").frame
    return links.unionByName(more)


def _likely(rows: DataFrame, asked: DataFrame, hashed: str) -> DataFrame:
    """Rows whose hash may be among those of ``asked``, so that few other texts are shuffled.

    The filter has ``FILTER_WORDS`` words of 64 bits at most, whatever is asked for; where it is full, all
    rows pass and the join behind does the work.
    """
    word = F.pmod(F.col(hashed), F.lit(FILTER_WORDS)).alias("_word")
    place = F.shiftrightunsigned(F.col(hashed), 40).bitwiseAND(F.lit(63)).cast("int")
    bit = F.lit(1).cast("long")
    bits = asked.select(word, F.call_function("shiftleft", bit, place).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.withColumn("_word", word).join(F.broadcast(bits), "_word")
    return met.where(F.call_function("shiftrightunsigned", F.col("_bits"), place).bitwiseAND(F.lit(1)) == 1).select(*rows.columns)


def similar_groups(df: DataFrame, key: str, text: str = "text", size: int = 3, keep=()) -> DataFrame:
    """The key and ``keep`` columns of every row, n_shingles, and the component_id of its group."""
    spark = df.sparkSession
    own = list(dict.fromkeys([key, *keep]))
    whole = F.struct(*[F.col(f"`{c}`") for c in own]).alias("_own")
    texts = df.select(whole, F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_full"), F.xxhash64(F.col(f"`{text}`")).alias("_hash"))
    with scope(spark) as keep_staged:
        rows = stage(with_sets(texts, "_full", ["_own", "_key", "_hash"], size), "sets").frame
        folded = rows.where("n > 0").groupBy("d1", "d2").agg(
            F.min("_key").alias("least"), F.count("*").alias("copies"), *[F.any_value(c).alias(c) for c in ("n", "reach", "cells")], F.min("_hash").alias("_hash")
        )
        sets = stage(folded.withColumn("sid", F.monotonically_increasing_id()), "distinct").frame
        posts = stage(prefixes(sets.select("sid", "n", "reach")), "prefixes").frame
        sizes = posts.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
        parts = F.ceil(F.col("m") / BLOCK).cast("int")
        lists = stage(posts.join(sizes, "token").select("token", "sid", "pos", parts.alias("parts")), "lists").frame
        # The whole sets of documents in some list; one text of each is read again.
        asked = stage(lists.select("sid").distinct().join(sets.select("sid", "_hash", "n", "cells"), "sid"), "asked").frame
        likely = _likely(texts.select("_hash", "_full"), asked, "_hash")
        found = likely.join(asked.select("sid", "_hash"), "_hash").dropDuplicates(["sid"])
        bodies = stage(with_shingles(found.select("sid", "_full"), "_full", "sid", size), "bodies").frame
        links = _links(lists, asked.select("sid", "n", "cells"), bodies)
        roots = connected_components(links)
        members = sets.select("sid", "d1", "d2", "least", "copies").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        members = stage(members, "members").frame
        groups = members.groupBy("root").agg(F.min("least").alias("component_id"))
        named = members.join(groups, "root").select("d1", "d2", "component_id")
        hot = hot_keys(rows, ["d1", "d2"])
        ids = rows.select("_own", "_key", "n", "d1", "d2")
        out = join_counted(ids, named, ["d1", "d2"], ["_key"], "left", hot)
        component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_key"))
        result = stage(out.select("_own", F.col("n").alias("n_shingles"), component.alias("component_id")), "groups")
        keep_staged(result)
    names = [*[F.col(f"_own.`{c}`") for c in own if c not in ("n_shingles", "component_id")], "n_shingles", "component_id"]
    return result.frame.select(*names)
