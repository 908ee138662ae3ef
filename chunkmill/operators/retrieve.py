"""Nearest records to queries: exact distances, k best per query.

Records are packed once into staged blocks and queries into chunks of bounded size. A first pass measures every query against
``FIRST_BLOCKS`` blocks and bounds its k-th distance; in the second pass a block sends on only what is within a query's bound, so what is
shuffled falls from k rows per query and block to little more than k per query. Blocks are dealt to as many salts as their number needs, a chunk
goes to each; nothing passes through the driver but counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_or_all
from ..sources.staging import stage_table

EMBED_BATCH = 1000
#: Blocks of a salt; each chunk of queries goes to every salt. Blocks that a first pass measures.
SALT_BLOCKS, FIRST_BLOCKS = 16, 4
#: Queries of a chunk, records of a block.
QUERY_CHUNK, RECORD_BLOCK = 256, 1024
METRICS = ("l2", "cosine", "ip")


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "ip":
        return 1 - q @ x.T
    if metric == "cosine":
        norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
        return 1 - np.divide(q @ x.T, norm, out=np.zeros((len(q), len(x))), where=norm > 0)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in q]) if len(q) else np.zeros((0, len(x)))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, v, bound) as rows (ids, v, bounds) of at most ``size`` vectors, as bytes of doubles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), size):
                own = batch.iloc[at : at + size]
                yield pd.DataFrame({"ids": [own["id"].to_numpy()], "v": [np.array(own["v"].tolist(), np.float64).tobytes()], "bounds": [own["bound"].to_numpy(np.float64).tobytes()]})

    return rows.mapInPandas(run, f"ids array<{dict(rows.dtypes)['id']}>, v binary, bounds binary")


def top_k(records: DataFrame, queries: DataFrame, k: int, metric: str = "l2", where: Column | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) by ascending distance, ties by id. ``queries``: query_id, embedding."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark, unbounded = records.sparkSession, F.lit(float("inf")).alias("bound")
    found = records if where is None else records.filter(where)
    found = found.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), unbounded).filter(F.col("v").isNotNull())
    asked = queries.select(F.col("query_id").alias("id"), F.col("embedding").alias("v"), unbounded).filter(F.col("v").isNotNull())
    blocks = stage_table(spark, packed(found, RECORD_BLOCK).drop("bounds").withColumn("block", F.monotonically_increasing_id()), "record-blocks")
    salts = max(1, -(-blocks.count() // SALT_BLOCKS))
    hits_ = f"query_id {dict(asked.dtypes)['id']}, id {dict(found.dtypes)['id']}, score double"
    first = blocks.orderBy(F.xxhash64("block")).limit(FIRST_BLOCKS)
    seeds = meet(first, asked, 1).mapInPandas(best_of(k, metric), hits_)
    bounds = best(seeds, k).groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) == k, F.max("score")).alias("kth"))
    bounded = asked.join(bounds, "id", "left").select("id", "v", F.coalesce("kth", "bound").alias("bound"))
    every = meet(blocks, bounded, salts).mapInPandas(best_of(k, metric), hits_)
    return best(every, k).select("query_id", "rank", "id", "score")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def meet(blocks: DataFrame, asked: DataFrame, salts: int) -> DataFrame:
    """Pairs of a block and a chunk of queries: every stated query against every record, in blocks."""
    chunks = packed(asked, QUERY_CHUNK).select(F.col("ids").alias("query_ids"), F.col("v").alias("q"), "bounds", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dealt = blocks.select("ids", "v", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"))
    return dealt.join(chunks.hint("merge"), "salt").drop("salt")


def best_of(k: int, metric: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, v, names, q, bounds in zip(batch["ids"], batch["v"], batch["query_ids"], batch["q"], batch["bounds"]):
                d = distances(np.frombuffer(q).reshape(len(names), -1), np.frombuffer(v).reshape(len(ids), -1), metric)
                by_id = np.argsort(ids, kind="stable")
                order = by_id[np.argsort(d[:, by_id], axis=1, kind="stable")[:, :k]]
                score = np.take_along_axis(d, order, axis=1)
                kept = score <= np.frombuffer(bounds)[:, None]
                yield pd.DataFrame({"query_id": np.repeat(names, kept.sum(axis=1)), "id": ids[order[kept]], "score": score[kept]})

    return run


def hits(nearest: DataFrame, records: DataFrame) -> DataFrame:
    """Hit rows with the records' columns, which are their metadata; a null document counts as empty."""
    own = nearest.join(records, "id")
    return own.withColumn("document", F.coalesce("document", F.lit(""))) if "document" in own.columns else own


def retrieve_texts(records: DataFrame, queries: DataFrame, embed_fn: Callable[[list[str]], np.ndarray], k: int = 3, metric: str = "l2", where: Column | None = None, where_document: str | None = None) -> DataFrame:
    """Hits to query texts, in one call: the texts are embedded, the records filtered by their metadata and by a substring of their document.

    ``records``: id, document, embedding and metadata; ``queries``: query_id, text. Hits carry the document and all metadata.
    """
    kept = records.filter((where if where is not None else F.lit(True)) & contains_or_all(F.col("document"), where_document))
    asked = embed(queries.select("query_id", "text"), embed_fn).select("query_id", "embedding")
    return hits(top_k(kept, asked, k, metric), kept.drop("embedding"))


def flat_hits(result: DataFrame) -> DataFrame:
    """Parallel arrays (ids, distances, documents, and metadatas if there) of a query to hit rows; absent values are null."""
    names = [c for c in ("ids", "distances", "documents", "metadatas") if c in result.columns]
    zipped = F.arrays_zip(*[F.coalesce(c, F.array()).alias(c) for c in names])
    rows = result.select("query_id", F.posexplode(F.slice(zipped, 1, F.size("ids"))).alias("rank", "h"))
    flat = [F.col("h")[c].alias(new) for c, new in zip(("ids", "distances", "documents", "metadatas"), ("id", "score", "document", "metadata")) if c in names]
    return rows.select("query_id", (F.col("rank") + 1).alias("rank"), *flat)


def embed(records: DataFrame, embed_fn: Callable[[list[str]], np.ndarray], text_col: str = "text", out_col: str = "embedding", batch: int = EMBED_BATCH) -> DataFrame:
    """Adds vectors from a user's function, called once per batch of texts."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            made = [np.asarray(embed_fn(texts.iloc[i : i + batch].fillna("").tolist()), np.float32) for i in range(0, len(texts), batch)]
            yield pd.Series([row for m in made for row in m], dtype=object)

    return records.withColumn(out_col, run(F.col(text_col)))


def hashing_embedder(width: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder for tests: words counted in hashed places."""
    import zlib

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, zlib.crc32(w.encode()) % width] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return run
