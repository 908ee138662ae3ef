"""Approximate nearest neighbours by an adaptive dimension scan of inverted lists.

Vectors are dealt to about as many lists as the square root of their number, each to that of its nearest centroid, and
packed into blocks, each with its vectors as they are, to be turned by a random rotation in columns of ``COLUMN``
dimensions. A query probes the lists whose centroids are nearest: the share ``probed`` of all, and on until they hold
``LEAST`` vectors. Its nearest list gives a first bound, the distance of the 11th neighbour found there. In the other lists
the partial distances over the columns read so far are tested against the bound: scaled to all dimensions, a
partial distance above the bound by more than ``epsilon`` standard errors ends the candidate. Survivors of all
columns are measured on the original vectors in double precision. Distances are sums of squared differences throughout, so
near neighbours of long vectors don't drown in rounding.

``probed=1.0, epsilon=None`` is the exact mode: every list is probed, and no test ends a candidate whose partial sum
is within the bound.

Equal vectors count once: of each distinct vector the 11 smallest identifiers are kept, which is all that 10
neighbours can need; queries with equal vectors are searched once. Lists are cut into blocks of bounded size and
queries into chunks; they meet in a sorted join on list and salt, whose blocks are dealt over as many salts as lists hold
blocks on average, so that neither a list nor a query grows a task; a pair emits only what is within the bound. Nothing
but centroids and list sizes is broadcast.

The centroids are fitted on a sample of at most ``SAMPLE`` distinct vectors and ``SAMPLE_BYTES`` (those with the smallest hash), ``PER_LIST``
for each list at least, which bounds the lists at 1024; every row is indexed. On directions without structure, as in the
test tables, lists separate little, so that ``PROBED`` of them are needed for a recall above 0.9 against brute force (see
the tests); clustered data needs fewer.

Nulls: vectors that are null or zero, or hold null or non-finite components, take no part, neither do vectors
whose length isn't the most frequent one, nor rows with a null identifier. An identifier that comes with several
vectors has the smallest. Repeated rows count once. An empty table gives an empty result. Other columns play no part,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage_table

SAMPLE, PER_LIST, PROBED, LEAST, NEIGHBOURS = 16_384, 16, 0.6, 512, 10
COLUMN, EPSILON, SEED = 16, 2.1, 7
SAMPLE_BYTES = 1 << 27
#: Vectors of a block, queries of a chunk, rows that a task holds before it emits all blocks.
BLOCK, CHUNK, HELD = 1024, 128, 32_768


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def clean(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part, one per identifier."""
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    return own.groupBy("id").agg(F.min("v").alias("v"))


def fit(sample: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids by Lloyd's rounds, and a random rotation."""
    rng = np.random.default_rng(SEED)
    centroids = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(8):
        nearest = np.concatenate([squared(sample[i : i + 1024], centroids).argmin(axis=1) for i in range(0, len(sample), 1024)])
        counts = np.bincount(nearest, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
    rotation, _ = np.linalg.qr(rng.normal(size=(sample.shape[1], sample.shape[1])))
    return centroids, rotation


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances to centroids, good enough to order lists."""
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None], 0)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def squared_differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T):
        out += (x[:, None] - y[None]) ** 2
    return out


PACKED = "list int, n int, keys binary, bounds binary, ids array<array<long>>, v binary"
PACKED_ARROW = pa.schema([("list", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("bounds", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64()))), ("v", pa.binary())])


def packer(centroids: np.ndarray, size: int, lists_of):
    """Rows (key, bound, ids, v) to packed rows per list; ``lists_of`` turns squared distances to (row, list) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        total = 0

        def pack(k: int, rows: list) -> pa.RecordBatch:
            key, bound, ids, v = zip(*rows)
            data = np.array(key, np.int64).tobytes(), np.array(bound, np.float64).tobytes(), list(ids), np.stack(v).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((k, len(rows), *data), PACKED_ARROW.types)], schema=PACKED_ARROW)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, bounds, ids, v = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), matrix(batch.column(3))
            for lo in range(0, len(v), 1024):
                rows, lists = lists_of(squared(v[lo : lo + 1024], centroids))
                for i, k in zip((rows + lo).tolist(), lists.tolist()):
                    own = held.setdefault(k, [])
                    own.append((keys[i], bounds[i], ids[i], v[i]))
                    total += 1
                    if len(own) == size:
                        yield pack(k, held.pop(k))
                        total -= size
                if total > HELD:
                    for k in list(held):
                        yield pack(k, held.pop(k))
                    total = 0
        for k in list(held):
            yield pack(k, held.pop(k))

    return run


def nearest_list(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(len(d)), d.argmin(axis=1)


def other_lists(sizes: np.ndarray, probed: float):
    """Beside the nearest list, the share ``probed`` of all, and on until they hold ``LEAST`` vectors."""

    def run(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        wanted = (np.arange(d.shape[1]) < max(1, round(d.shape[1] * probed))) | (before < LEAST)
        wanted[:, 0] = False
        rows, at = np.nonzero(wanted)
        return rows, order[rows, at]

    return run


def survivors(q: np.ndarray, x: np.ndarray, bound: np.ndarray, epsilon: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs that the tests over rotated columns leave; ``bound`` in squared distance."""
    d = q.shape[1]

    def most(read: int) -> np.ndarray:
        """The largest partial distance that goes on."""
        if read >= d or epsilon is None:
            return bound * (1 + 1e-6)  # for rounding; survivors are measured anew
        return bound * ((1 + epsilon / np.sqrt(read)) ** 2 * read / d)

    read = min(COLUMN, d)
    partial = squared_differences(q[:, :read], x[:, :read])
    a, b = np.nonzero(partial <= most(read)[:, None])
    so_far = partial[a, b]
    while read < d and len(a):
        column = slice(read, read + COLUMN)
        so_far = so_far + ((q[a, column] - x[b, column]) ** 2).sum(axis=1)
        read = min(read + COLUMN, d)
        left = so_far <= most(read)[a]
        a, b, so_far = a[left], b[left], so_far[left]
    return a, b


def scan(rotation: np.ndarray, keep: int, epsilon: float | None):
    """Joined rows of a block and a chunk to hits (key, score, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}
                keys = np.frombuffer(row["keys"].as_py(), np.int64)
                bounds = np.frombuffer(row["bounds"].as_py(), np.float64)
                q = np.frombuffer(row["qv"].as_py(), np.float64).reshape(len(keys), -1)
                x = np.frombuffer(row["v"].as_py(), np.float64).reshape(-1, q.shape[1])
                middle = x.mean(axis=0)  # differences stay exact where all vectors are long
                a, b = survivors((q - middle) @ rotation, (x - middle) @ rotation, bounds * bounds, epsilon)
                score = np.sqrt(((q[a] - x[b]) ** 2).sum(axis=1))
                order = np.lexsort((score, a))
                a, b, score = a[order], b[order], score[order]
                starts = np.searchsorted(a, a)
                last = np.minimum(starts + keep - 1, np.searchsorted(a, a, side="right") - 1)
                left = score <= score[last] if len(a) else np.zeros(0, bool)
                ids = row["ids"].values.take(pa.array(b[left]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[a[left]]), pa.array(score[left]), ids], names=["key", "score", "ids"])

    return run


def hits(blocks: DataFrame, chunks: DataFrame, salts: int, scanner, keep: int) -> DataFrame:
    """(key, id, score), the ``keep`` best per key. A chunk goes to each salt, a block has one."""
    chunks = chunks.select("list", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "keys", "bounds", F.col("v").alias("qv"))
    pairs = blocks.select("list", "salt", "ids", "v").join(chunks.hint("merge"), ["list", "salt"]).select("ids", "v", "keys", "bounds", "qv")
    found = pairs.mapInArrow(scanner, "key long, score double, ids array<long>").select("key", "score", F.explode("ids").alias("id"))
    return best(found, "key", keep)


def best(found: DataFrame, key: str, keep: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def nearest(spark: SparkSession, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, neighbours: int = NEIGHBOURS, probed: float = PROBED, epsilon: float | None = EPSILON) -> DataFrame:
    """For each row whose identifier is divisible by ``every``: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    keep = neighbours + 1
    own = stage_table(spark, clean(rows, id_col, vector_col), "vectors")
    length = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    out = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], out)
    own = own.filter(F.size("v") == length["n"])
    first = Window.partitionBy("v").orderBy("id")
    distinct = own.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= keep).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    distinct = stage_table(spark, distinct.select(F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("bound"), "ids", "v"), "distinct-vectors")
    drawn = distinct.select("v", F.xxhash64(F.col("ids")[0]).alias("h")).orderBy("h", "v").limit(max(PER_LIST, min(SAMPLE, SAMPLE_BYTES // (8 * length["n"]))))
    sample = matrix(drawn.toArrow().column("v").combine_chunks())
    n = distinct.count()
    lists = max(1, min(round(n**0.5), len(sample) // PER_LIST))
    centroids, rotation = fit(sample, lists)
    packed = distinct.mapInArrow(packer(centroids, BLOCK, nearest_list), PACKED).withColumn("block", F.monotonically_increasing_id())
    blocks = stage_table(spark, packed, "blocks")
    sizes = np.zeros(lists, np.int64)
    counted = blocks.groupBy("list").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks")).collect()  # a row per list
    for r in counted:
        sizes[r["list"]] = r["n"]
    salts = max(1, sum(r["blocks"] for r in counted) // lists)
    blocks = blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    scanner = scan(rotation, keep, epsilon)
    asked = own.filter(F.col("id") % every == 0)
    queries = stage_table(spark, asked.groupBy("v").agg(F.min("id").alias("key")), "queries")
    no_ids = F.array().cast("array<long>").alias("ids")
    seed = queries.select("key", F.lit(float("inf")).alias("bound"), no_ids, "v").mapInArrow(packer(centroids, CHUNK, nearest_list), PACKED)
    seeds = stage_table(spark, hits(blocks, seed, salts, scanner, keep), "seed-hits")
    bounds = seeds.groupBy("key").agg(F.when(F.count(F.lit(1)) == keep, F.max("score")).alias("bound"))
    bounded = queries.join(bounds.hint("merge"), "key", "left").select("key", F.coalesce("bound", F.lit(float("inf"))).alias("bound"), no_ids, "v")
    chunks = bounded.mapInArrow(packer(centroids, CHUNK, other_lists(sizes, probed)), PACKED)
    found = best(seeds.drop("rank").unionByName(hits(blocks, chunks, salts, scanner, keep).drop("rank")), "key", keep).drop("rank")
    named = asked.join(queries.hint("merge"), "v").select(F.col("id").alias("query_id"), "key")
    others = named.hint("merge").join(found, "key").filter(F.col("id") != F.col("query_id"))
    return best(others, "query_id", neighbours).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
