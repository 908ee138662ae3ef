"""Compression of vectors to codes: per part of the vector the nearest entry of that part's codebook, in whole numbers throughout.

Each component x becomes the integer floor(4096 x). A distance is |x|^2 - 2 x.c + |c|^2, and the dot products are a matrix
product. To be exact in BLAS, integers are broken into limbs of so few bits that every product of two limb matrices stays
below 2^53 in double precision; the products are put together in 64-bit integers, and the first smallest distance wins. Integers of
one limb, as embeddings mostly have, need one product. Where distances could pass 2^63 the block is worked out in Python's integers.

Vectors are packed once into staged blocks of integers. A round is one pass over the blocks: a task assigns its parts and
sums them per entry, in a low and a high half of each integer so that no sum overflows; what tasks send has the size of the codebooks,
and so has what comes to the driver, which sends the new entries along with the next pass. Sums are added by Spark and exact, so reruns agree.

Nulls: vectors that are null or hold null, NaN or infinite components are dropped. A null identifier keeps its row and comes after all
others in the first codebooks; rows of equal identifiers are taken in order of their vectors, each by itself. A table with
fewer vectors than entries has smaller codebooks, an empty one an empty result. Shorter vectors, and all
vectors whose length 8 doesn't divide, count as filled up with zeros to a common length, an empty vector as zeros. A component of 2^50 or more in size is an
error; an error, or a sum of errors, past 2^63 - 1 is that number. Other columns are kept by ``assign_codes``; where one has the name of an added column, the added one
gets ``_`` behind its name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import free_names, numbered, quoted, stage_table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Bytes of integers in a block.
BLOCK_BYTES = 1 << 21
#: Sums are gathered in halves of so many bits.
HALF = 31
LARGEST = (1 << 63) - 1


def whole(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def integers(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Rows of floor(4096 x), filled up with zeros to the width."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and np.abs(flat).max() >= SCALE * 2.0**50:
        raise ValueError("vector codes take components below 2^50 in size")
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat.astype(np.int64)
    return out


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """x as double matrices, the sum of limb << (bits * place); all but the last lie in [0, 2^bits), that one in [-2^bits, 2^bits)."""
    out = []
    while len(x) and max(int(x.max()), -int(x.min())) >= 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x @ c.T of 64-bit integer matrices, exact if the results fit."""
    bits = (53 - int(x.shape[1]).bit_length()) // 2
    out = np.zeros((len(x), len(c)), np.int64)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(limbs(c, bits)):
            out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row and part the first nearest entry, and per row the sum of the squared distances. ``codebooks``: part, entry, position."""
    parts, entries, width = codebooks.shape
    codes, errors = np.zeros((len(x), parts), np.int64), np.zeros(len(x), np.int64)
    if not len(x):
        return codes, errors
    most = max(int(x.max()), -int(x.min()), int(codebooks.max()), -int(codebooks.min()))
    small = parts * width * (2 * most) ** 2 <= LARGEST
    if not small:
        x, codebooks, errors = x.astype(object), codebooks.astype(object), errors.astype(object)
    for p in range(parts):
        own, c = x[:, p * width : (p + 1) * width], codebooks[p]
        if small:
            d = (own * own).sum(axis=1)[:, None] - 2 * dots(own, c) + (c * c).sum(axis=1)
        else:
            d = np.stack([((own - entry) ** 2).sum(axis=1) for entry in c], axis=1)
        codes[:, p] = np.argmin(d, axis=1)
        errors += d[np.arange(len(d)), codes[:, p]]
    return codes, np.minimum(errors, LARGEST).astype(np.int64)


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, entry and position, whole numbers."""

    entries: np.ndarray

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def block_rows(width: int) -> int:
    return max(1, BLOCK_BYTES // (8 * width))


def packed(rows: DataFrame, width: int) -> DataFrame:
    """The vectors as blocks: ``ints`` (64-bit integers, row after row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows(width)):
                own = integers(batch.column(0).slice(at, block_rows(width)), width)
                yield pa.RecordBatch.from_arrays([pa.array([own.astype("<i8").tobytes()], pa.binary())], names=["ints"])

    return rows.mapInArrow(run, "ints binary")


def sums(blocks: DataFrame, codebooks: Codebooks) -> DataFrame:
    """(part, entry, position, n, low, high): of the parts that each entry is nearest to, their number and sum, in halves; a task adds up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = codebooks.entries.shape
        n, low, high = np.zeros((parts, entries), np.int64), *(np.zeros((parts, entries, width), np.int64) for _ in range(2))
        for batch in batches:
            for block in batch.column(0):
                x = np.frombuffer(block.as_py(), "<i8").reshape(-1, parts * width)
                codes, _ = nearest(x, codebooks.entries)
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    n[p] += np.bincount(codes[:, p], minlength=entries)
                    np.add.at(low[p], codes[:, p], own & ((1 << HALF) - 1))
                    np.add.at(high[p], codes[:, p], own >> HALF)
        at = np.indices(low.shape).reshape(3, -1).astype(np.int32)
        used = np.repeat(n.ravel() > 0, width)
        columns = [*at, np.repeat(n.ravel(), width), low.ravel(), high.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c[used]) for c in columns], names=["part", "entry", "position", "n", "low", "high"])

    out = blocks.mapInArrow(run, "part int, entry int, position int, n long, low long, high long")
    return out.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"))


def updated(found: pa.Table, before: Codebooks) -> Codebooks:
    """Each entry that was used becomes floor(sum / count) by components; the others stay."""
    out = before.entries.copy()
    for part, entry, position, n, low, high in zip(*(found.column(c).to_pylist() for c in ("part", "entry", "position", "n", "low", "high"))):
        out[part, entry, position] = ((high << HALF) + low) // n
    return Codebooks(out)


def fit(spark: SparkSession, rows: DataFrame, id_col: str, vector_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, int] | None:
    """The codebooks after the rounds, and the common length; None for a table without whole vectors."""
    kept = rows.filter(whole(quoted(vector_col))).select(quoted(id_col).alias("id"), quoted(vector_col).cast("array<double>").alias("v"))
    longest = kept.agg(F.max(F.size("v")).alias("n")).first()["n"]
    if longest is None:
        return None
    width = max(1, -(-longest // parts)) * parts
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).toArrow().column("v").combine_chunks()
    start = integers(first, width).reshape(len(first), parts, -1).transpose(1, 0, 2)
    blocks = stage_table(spark, packed(kept.select("v"), width), "vector-blocks")
    made = Codebooks(np.ascontiguousarray(start))
    for _ in range(rounds):
        made = updated(sums(blocks, made).toArrow(), made)
    return made, width


def assign_codes(rows: DataFrame, codebooks: Codebooks, width: int, vector_col: str = "embedding") -> DataFrame:
    """Each row with a whole vector, with its columns, ``code`` (two hex digits a part) and ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, block_rows(width)):
                batch = whole_batch.slice(at, block_rows(width))
                codes, errors = nearest(integers(batch.column(batch.num_columns - 1), width), codebooks.entries)
                told = codes.astype(np.uint8).tobytes().hex()
                digits = 2 * codes.shape[1]
                code = [told[i * digits : (i + 1) * digits] for i in range(len(codes))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(code, pa.string()), pa.array(errors)], names=names)

    schema = StructType([*rows.schema.fields, *[StructField(n, t) for n, t in zip(free_names(rows, "code", "error"), (StringType(), LongType()))]])
    names = schema.names
    kept = rows.filter(whole(quoted(vector_col)))
    return kept.select(*numbered(rows), quoted(vector_col).cast("array<double>").alias("v")).mapInArrow(run, schema)


def vector_codes(spark: SparkSession, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per whole vector: id, ``code``, ``error``, ``label_error`` (summed over equal labels, nulls together), ``codebooks_sha256``."""
    own = rows.select(quoted(id_col).alias("id"), quoted(label_col).alias("label"), quoted(vector_col).alias("v"))
    fitted = fit(spark, own, "id", "v")
    if fitted is None:
        none = own.filter("false").select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.select("*", F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codebooks, width = fitted
    coded = stage_table(spark, assign_codes(own, codebooks, width, "v").drop("v"), "vector-codes")
    summed = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy("label").agg(summed.alias("label_error")).withColumnRenamed("label", "of_label")
    found = coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
    return found.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebooks.digest).alias("codebooks_sha256"))


def round_sql(r: int) -> str:
    """SQL for one round: ``a{r}`` the nearest entry of every part, ``c{r + 1}`` the next codebooks."""
    distance = "CAST(list_inner_product(s.v, s.v) - 2 * list_inner_product(s.v, c.v) + list_inner_product(c.v, c.v) AS BIGINT)"
    return f"""a{r} AS MATERIALIZED (SELECT r, p, min(d) AS d, arg_min(e, (d, e)) AS e FROM (SELECT s.r, s.p, c.e, {distance} AS d FROM s JOIN c{r} c ON c.p = s.p) GROUP BY r, p),
u{r} AS (SELECT p, e, i, CAST(floor(sum(s.v[i]) / count(*)) AS DOUBLE) AS x FROM a{r} JOIN s USING (r, p), w, unnest(range(1, w.n + 1)) AS t(i) GROUP BY p, e, i),
n{r} AS (SELECT p, e, list(x ORDER BY i) AS v FROM u{r} GROUP BY p, e),
c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN n{r} n ON n.p = c.p AND n.e = c.e)"""


#: DuckDB SQL for ``vector_codes`` over a table whose vectors have one length that 8 divides; whole numbers in doubles, exact below 2^53.
SQL = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM {{rows}}
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT CAST(max(len(v)) // {PARTS} AS BIGINT) AS n FROM k),
s AS MATERIALIZED (SELECT r, p, v[p * w.n + 1 : p * w.n + w.n] AS v FROM k, w, range({PARTS}) AS t(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM s WHERE r <= {ENTRIES}),
{", ".join(round_sql(r) for r in range(ROUNDS + 1))},
f AS (SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
b AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS digest FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM f JOIN k USING (r), b"""
