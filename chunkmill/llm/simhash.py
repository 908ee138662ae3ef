"""SimHash near-dedup by anchor-point covering.

Fingerprint: A-Z in lower case, words, shingles of three words (repeats included; fewer words: all of them),
XXH64 with seed 42 of each; a bit is set if over half of the hashes set it. No word gives fingerprint zero.

Links (``DISTANCE`` = 2 or fewer differing bits) are found among distinct fingerprints. The anchors are the
words of the Hamming code on bits 1 to 63, whose covering radius is 1. Half of the threshold lies on either
side of a pair's midpoint, so both fingerprints of a linked pair are within covering radius + 1 = 2 of the
anchor nearest to the midpoint: a fingerprint is replicated to all anchors within distance 2, 32 at most, and
no link is lost. An anchor holds at most 4034 distinct fingerprints whatever the data (the points within 2 on
63 bits, times the bit outside the code), so no group is unbounded. Per anchor the fingerprints are compared
and a spanning forest of their links is kept, not all pairs.

Components: large-star / small-star rounds over the forest's edges, each staged in the shared folder, with
minima combined before the shuffle; nothing is collected but the number of edges that changed.

Nulls: a null text counts as empty, and empty texts are linked like any other. A null identifier is larger than
any other. Repeated rows each get a row. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import nested, row_hash, row_key, stage_table, text_of

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: Runs of one anchor up to this length are compared in shifts over the whole batch, longer ones by themselves.
SHORT_RUN = 48


def fingerprint(body: bytes) -> int:
    words = body.lower().split()  # of bytes: A-Z only, and the six white-space bytes
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends[:n] - np.fromiter(map(len, words[:n]), np.int64, n) - 1).tolist()
    stops = (ends[min(SHINGLE, len(words)) - 1 :] - 1).tolist()
    ones, view, digest = np.zeros(64, np.int64), memoryview(joined), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        h = np.array([digest(view[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *kept, body = batch.columns
        found = np.fromiter((fingerprint(x) for x in body.to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*kept, pa.array(found.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for all anchors within distance 2; bit 0 is outside the code and cleared."""
    word = fp & ~np.uint64(1)
    syndrome = np.zeros(len(fp), np.uint64)
    for bit in range(1, 64):
        syndrome ^= np.where((word >> np.uint64(bit)) & np.uint64(1), np.uint64(bit), np.uint64(0))
    at, one = np.arange(len(fp)), np.uint64(1)
    off = syndrome != 0
    s = syndrome[off]
    rows, found = [at[~off], at[off]], [word[~off], word[off] ^ (one << s)]
    for i in range(1, 64):  # the bits i and i ^ s, each pair once, neither of them 0
        j = np.uint64(i) ^ s
        take = j > i
        rows.append(at[off][take])
        found.append(word[off][take] ^ (one << np.uint64(i)) ^ (one << j[take]))
    return np.concatenate(rows), np.concatenate(found)


def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            fp = batch.column(0).slice(at, 8192).to_numpy(zero_copy_only=False).view(np.uint64)
            rows, found = anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(fp[rows].view(np.int64))], names=["anchor", "fp"])


def forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """(member, first member) over the links within one anchor: each fingerprint is compared with those not yet reached."""
    out, left = [], fp
    while len(left):
        root, left = left[0], left[1:]
        front = np.array([root], np.uint64)
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for x in front:
                near |= np.bitwise_count(left ^ x) <= DISTANCE
            front, left = left[near], left[~near]
            out += [(int(x), int(root)) for x in front]
    return out


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; a run that a batch cuts waits for the next one."""
    rest = None

    def links(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        lengths = np.diff(np.r_[starts, len(anchor)])
        pairs = [np.empty((0, 2), np.uint64)]
        short = np.repeat((lengths > 1) & (lengths <= SHORT_RUN), lengths)
        a, f = anchor[short], fp[short]
        for k in range(1, int(lengths[(lengths > 1) & (lengths <= SHORT_RUN)].max(initial=1))):
            hit = np.flatnonzero((a[k:] == a[:-k]) & (np.bitwise_count(f[k:] ^ f[:-k]) <= DISTANCE))
            pairs.append(np.stack([f[hit + k], f[hit]], axis=1))
        for i in np.flatnonzero(lengths > SHORT_RUN):
            pairs.append(np.array(forest(fp[starts[i] : starts[i] + lengths[i]]), np.uint64).reshape(-1, 2))
        found = np.unique(np.concatenate(pairs), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy().view(np.int64)), pa.array(found[:, 1].copy().view(np.int64))], names=["u", "v"])

    for batch in batches:
        anchor, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if rest is not None:
            anchor, fp = np.concatenate([rest[0], anchor]), np.concatenate([rest[1], fp])
        if not len(anchor):
            continue
        cut = int(np.searchsorted(anchor, anchor[-1]))
        rest = anchor[cut:], fp[cut:]
        if cut:
            yield links(anchor[:cut], fp[:cut].view(np.uint64))
    if rest is not None:
        yield links(rest[0], rest[1].view(np.uint64))


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs to (node, root): root is the smallest node reachable. Nodes without edges don't appear."""
    stars = stage_table(spark, edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage_table(spark, large, "large-star")
        down = large.filter("u > v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        small = stage_table(spark, small, "small-star")
        done = small.exceptAll(stars).isEmpty() and stars.exceptAll(small).isEmpty()
        stars = small
        if done:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def families(spark: SparkSession, rows: DataFrame, low: Column) -> DataFrame:
    """Distinct fingerprints of ``rows``: ``fp``, the least ``low`` of its rows, and the root of its component."""
    distinct = stage_table(spark, rows.groupBy("fp").agg(F.min(low).alias("low")), "distinct-fingerprints")
    spread = distinct.select("fp").mapInArrow(replicate, "anchor long, fp long")
    edges = spread.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(compare, "u long, v long")
    roots = components(spark, edges)
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def simhash_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``fingerprint`` (hex), ``component_id``."""
    made = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("body")).mapInArrow(fingerprints, "id long, fp long")
    rows = stage_table(spark, made, "fingerprints")
    grouped = families(spark, rows, F.col("id"))
    named = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    known = grouped.select("fp", "root").join(named, "root").select("fp", "component_id")
    return rows.join(known, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the row with the smallest identifier, with its columns, whatever names those have.

    A component names its row by identifier and text, as an identifier may be null or stand in several components.
    """
    key = row_key(id_col, text_col)
    made = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), text_of(text_col).cast("binary").alias("body")).mapInArrow(fingerprints, "id long, key string, fp long")
    rows = stage_table(spark, made, "fingerprints")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    keep = families(spark, rows, first).groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.key").alias("key"))
    once = Window.partitionBy("key").orderBy("order")
    at = docs.select(key.alias("key"), row_hash(docs).alias("order"), nested(docs)).join(keep, "key", "left_semi")
    return at.withColumn("nth", F.row_number().over(once)).filter("nth = 1").select("row.*")
