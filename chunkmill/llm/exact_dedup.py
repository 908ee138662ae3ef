"""Exact dedup by Patricia-trie owners.

Texts are equal when identical after each run of white space became one space. Each input task inserts its
texts into a radix trie first, so a group of copies leaves a task once, however large it is. The distinct
texts are dealt out by length and content hash; each partition inserts the full byte strings into a trie whose
terminal nodes hold the smallest identifier, and spills by subtree. The owners go back to the rows by hash,
in a join that Spark splits where one hash holds many rows.

Nulls: a null text counts as empty; a null identifier counts as larger than any other. Repeated rows (equal
identifier and text) each count in ``group_size``; of those with the smallest identifier one is kept. An empty
table gives an empty result. Columns other than the two named play no part and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import nested, one_space, row_hash, text_of
from .radix_trie import RadixTrie

#: Bytes of trie that a task holds before it emits (first pass) or spills (second pass).
MEMORY_BYTES = 96 << 20
OWNED = pa.schema([("length", pa.int64()), ("sha", pa.binary()), ("body", pa.binary()), ("keep_id", pa.int64()), ("keep_rows", pa.int64()), ("group_size", pa.int64())])


def merged(a: tuple, b: tuple) -> tuple:
    """Payloads (hash, smallest identifier or None, rows that have it, rows)."""
    if a[1] == b[1]:
        low, rows = a[1], a[2] + b[2]
    elif b[1] is None or a[1] is not None and a[1] < b[1]:
        low, rows = a[1], a[2]
    else:
        low, rows = b[1], b[2]
    return a[0], low, rows, a[3] + b[3]


def local_owners(memory_bytes: int):
    """First pass: the distinct texts of a task, emitted whenever the trie has reached its budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, bodies = RadixTrie(merged, 1 << 62), {}

        def emit() -> Iterator[pa.RecordBatch]:
            rows, held = [], 0
            for sha, low, n_low, n in trie.items():
                body = bodies.pop(sha)
                rows.append((len(body), sha, body, low, n_low, n))
                held += len(body)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), OWNED.types)], schema=OWNED)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), OWNED.types)], schema=OWNED)

        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sha = hashlib.sha256(body).digest()
                trie.insert(body, (sha, doc_id, 1, 1))
                bodies[sha] = body
                if trie.bytes > memory_bytes // 2:  # the strings are held twice: as labels and whole
                    yield from emit()
                    trie, bodies = RadixTrie(merged, 1 << 62), {}
        yield from emit()

    return run


def owners(memory_bytes: int):
    """Second pass: for each distinct text of a partition its owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie(merged, memory_bytes)
        for batch in batches:
            for sha, body, low, n_low, n in zip(*(c.to_pylist() for c in batch.columns)):
                trie.insert(body, (sha, low, n_low, n))
        rows = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["sha", "keep_id", "keep_rows", "group_size"])

        for x in trie.items():
            rows.append(x)
            if len(rows) == 20_000:
                yield made()
                rows = []
        if rows:
            yield made()

    return run


def normalised(text_col: str = "text") -> Column:
    return one_space(text_of(text_col))


def text_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """One row per distinct text: ``sha`` (SHA-256), ``keep_id``, ``keep_rows`` (rows with that id), ``group_size``."""
    local = docs.select(F.col(id_col).cast("long").alias("id"), normalised(text_col).cast("binary").alias("body")).mapInArrow(
        local_owners(memory_bytes), "length long, sha binary, body binary, keep_id long, keep_rows long, group_size long"
    )
    return local.repartition("length", "sha").select("sha", "body", "keep_id", "keep_rows", "group_size").mapInArrow(owners(memory_bytes), "sha binary, keep_id long, keep_rows long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    rows = docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(normalised(text_col), 256)).alias("sha")).groupBy("_id", "sha").agg(F.count(F.lit(1)).alias("_n"))
    found = rows.join(text_owners(docs, id_col, text_col, memory_bytes), "sha")
    copy = F.posexplode(F.array_repeat(F.lit(0), F.col("_n").cast("int"))).alias("_copy", "_")
    return found.select("*", copy).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 0)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their columns, whatever names those have.

    Of rows alike in identifier and text the one with the smallest hash over its columns stays.
    """
    own = text_owners(docs, id_col, text_col).select(F.col("keep_id").alias("keep"), F.col("sha").alias("owned"))
    at = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(normalised(text_col), 256)).alias("sha"), row_hash(docs).alias("order"), nested(docs))
    kept = at.join(own, F.col("id").eqNullSafe(F.col("keep")) & (F.col("sha") == F.col("owned")), "left_semi")
    once = Window.partitionBy("sha", "id").orderBy("order")
    return kept.withColumn("nth", F.row_number().over(once)).filter("nth = 1").select("row.*")


SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM {docs}),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256 FROM n JOIN g USING (text_sha256)
"""
