"""Tokenizers, those by delimiters on columns too, and vocabularies as DataFrames (token, id)."""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage_table
from .text import utf16_length

#: The delimiters of the sentence preset.
SENTENCE_DELIMITERS = ("!\n", ". ", "? ", "\n", ".", "?", "!")


def alternation(delimiters: tuple[str, ...]) -> str:
    """In the order given: a list's first delimiter wins, unlike in the chunkers."""
    return "|".join(re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", d) for d in delimiters)


class TextTokenizer:
    """What chunkers ask of a tokenizer, inside tasks: the tokens of a text, the text of tokens, and numbers of tokens, of many texts at once.

    Tokens may be of any kind. Subclasses are sent to tasks with the settings that hold them, so they must be picklable.
    """

    #: Whether ``tokens`` and ``count`` do the same on columns.
    on_columns = False

    def split_text(self, text: str) -> Sequence:
        raise NotImplementedError

    def join_tokens(self, tokens: Sequence) -> str:
        raise NotImplementedError

    def count_texts(self, texts: list[str]) -> list[int]:
        return [len(self.split_text(t)) for t in texts]

    def count_text(self, text: str) -> int:
        return self.count_texts([text])[0]

    def count_window(self, tokens: Sequence, text: str) -> int:
        """The number that a window of tokens counts as; ``text`` is their text."""
        return len(tokens)


@dataclass(frozen=True)
class Tokenizer(TextTokenizer):
    """``delimiter``: a string (empty parts stay), a tuple of strings (empty parts go) or "" (characters)."""

    delimiter: str | tuple[str, ...]
    joiner: str | None = None
    on_columns = True

    @property
    def joined_by(self) -> str:
        if self.joiner is not None:
            return self.joiner
        return self.delimiter if isinstance(self.delimiter, str) else self.delimiter[0]

    def tokens(self, text: Column) -> Column:
        if self.delimiter == "":
            return F.split(text, "")
        if isinstance(self.delimiter, str):
            return F.when(text == "", F.array(F.lit(""))).otherwise(F.split(text, alternation((self.delimiter,)), -1))
        return F.filter(F.split(text, alternation(self.delimiter), -1), lambda t: t != "")

    def count(self, text: Column) -> Column:
        """Characters count in UTF-16 units and are never cut apart."""
        return utf16_length(text) if self.delimiter == "" else F.size(self.tokens(text))

    def count_texts(self, texts: list[str]) -> list[int]:
        if self.delimiter == "":
            return [len(t) if t.isascii() else len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in texts]
        if isinstance(self.delimiter, str):
            return [t.count(self.delimiter) + 1 for t in texts]
        return super().count_texts(texts)

    def split_text(self, text: str) -> list[str]:
        if self.delimiter == "":
            return list(text)
        if isinstance(self.delimiter, str):
            return text.split(self.delimiter)
        return [t for t in re.split(alternation(self.delimiter), text) if t]

    def join_tokens(self, tokens: Sequence[str]) -> str:
        return ("" if self.delimiter == "" else self.joined_by).join(tokens)

    def count_window(self, tokens: Sequence[str], text: str) -> int:
        return self.count_text(text) if self.delimiter == "" else len(tokens)


@functools.lru_cache(maxsize=4)
def library_tokenizer(path: str):
    """One per Python worker and file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer as Library

    return Library.from_file(path)


@dataclass(frozen=True)
class LibraryTokenizer(TextTokenizer):
    """A tokenizer file of the ``tokenizers`` library at a path that all executors have; no special tokens are added. Tokens are ids."""

    path: str

    def split_text(self, text: str) -> list[int]:
        return library_tokenizer(self.path).encode(text, add_special_tokens=False).ids

    def join_tokens(self, tokens: Sequence[int]) -> str:
        return library_tokenizer(self.path).decode(list(tokens), skip_special_tokens=False)

    def count_texts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in library_tokenizer(self.path).encode_batch_fast(texts, add_special_tokens=False)]


CHARACTER, WORD, SENTENCE = Tokenizer(""), Tokenizer(" "), Tokenizer(SENTENCE_DELIMITERS, ". ")


#: Bytes of tokens that a block holds, unless one document has more.
BLOCK_BYTES = 1 << 23


def blocks_of(rows: DataFrame, kind: str, delimiter: str | None = None) -> DataFrame:
    """Rows (doc_order, items), the items a list or a text that is split at ``delimiter``, in staged blocks of documents, which share a dictionary: the different items of a block and, per
    document, their places in it. Whatever joins items later has a row per block and item, not one per position.

    A block: ``block``, ``orders``, ``sizes`` (-1: no list), ``codes`` (32-bit places, -1: null), ``items``, and per item the place where it first appears,
    ``first_order`` and ``first_pos``, in the order of the documents. Staged, because all that reads a block must see the same one.
    """
    order = dict(rows.dtypes)["doc_order"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), itertools.count()
        for whole in batches:
            at = 0
            lengths = (pc.list_value_length if delimiter is None else pc.binary_length)(whole.column(1))
            lengths = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            per_item = max(1, whole.column(1).nbytes // max(1, int(lengths.sum())))
            upto = np.cumsum(lengths * per_item)
            while at < whole.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK_BYTES, side="right")))
                batch = whole.slice(at, end - at).sort_by([(whole.schema.names[0], "ascending")])
                at = end
                orders, lists = batch.column(0), batch.column(1) if delimiter is None else pc.split_pattern(batch.column(1), delimiter)
                sizes = pc.fill_null(pc.list_value_length(lists), -1)
                coded = lists.flatten().dictionary_encode()
                codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype("<i4")
                n = np.maximum(sizes.to_numpy(zero_copy_only=False), 0)
                first, at_all = np.zeros(len(coded.dictionary), np.int64), np.flatnonzero(codes >= 0)[::-1]
                first[codes[at_all]] = at_all  # of a code's places the first is written last
                doc = np.repeat(np.arange(len(n)), n)
                pos = first - (np.cumsum(n) - n)[doc[first]]
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                columns = [pa.array([f"{task}-{next(number)}"]), one(orders), one(sizes), pa.array([codes.tobytes()]), one(coded.dictionary), one(orders.take(pa.array(doc[first]))), one(pa.array(pos.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "orders", "sizes", "codes", "items", "first_order", "first_pos"])

    schema = f"block string, orders array<{order}>, sizes array<int>, codes binary, items array<{kind}>, first_order array<{order}>, first_pos array<int>"
    return stage_table(rows.sparkSession, rows.mapInArrow(run, schema), "token-blocks")


def token_blocks(docs: DataFrame, tokenizer: Tokenizer, order_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text, delimiter = F.col(text_col), tokenizer.delimiter if isinstance(tokenizer.delimiter, str) and tokenizer.delimiter else None
    return blocks_of(docs.select(F.col(order_col).alias("doc_order"), (tokenizer.tokens(text) if delimiter is None else text).alias("items")), "string", delimiter)


def vocabulary(docs: DataFrame, tokenizer: Tokenizer, order_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(token, id), numbered by first appearance; ``known`` keeps its ids and new tokens follow it."""
    return vocabulary_of(token_blocks(docs, tokenizer, order_col, text_col), known)


def vocabulary_of(blocks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The vocabulary of token blocks.

    A row per block and token; their minima are combined before the shuffle. The first appearances are dealt out by ranges and
    staged, and ids are a place in the range and the counts of the ranges before, so no task holds all tokens.
    """
    rows = blocks.select(F.inline(F.arrays_zip(F.col("items").alias("token"), "first_order", "first_pos")))
    first = rows.groupBy("token").agg(F.min(F.struct("first_order", "first_pos")).alias("first")).select("token", F.col("first.first_order").alias("o"), F.col("first.first_pos").alias("p"))
    if known is not None:
        first = first.join(known, "token", "left_anti")
    ranged = first.repartitionByRange("o", "p").sortWithinPartitions("o", "p").withColumn("at", F.monotonically_increasing_id())  # part and place in it
    dealt = stage_table(blocks.sparkSession, ranged.select("token", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "first-appearances")
    parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    fresh = dealt.join(F.broadcast(parts), "part").select("token", (F.col("before") + F.col("place")).cast("long").alias("id"))
    if known is None:
        return fresh
    start = known.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("start"))
    fresh = fresh.crossJoin(F.broadcast(start)).select("token", (F.col("id") + F.col("start")).cast("long").alias("id"))  # one row
    return known.select("token", F.col("id").cast("long").alias("id")).unionByName(fresh)


def running_total(counts: DataFrame, order_col: str, count_col: str) -> DataFrame:
    """(order, before): the sum of the counts of all smaller orders.

    The rows are dealt out by ranges of the order, however sparse it is, and staged with their range's number; each
    range is summed by itself, and only the ranges' sums pass through one task.
    """
    spark = counts.sparkSession
    ranged = counts.select(F.col(order_col).alias("o"), F.col(count_col).alias("n")).repartitionByRange("o").withColumn("part", F.spark_partition_id())
    ranged = stage_table(spark, ranged, "ranges")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(F.sum("n").alias("part_sum"))
    parts = parts.select("part", F.coalesce(F.sum("part_sum").over(upto(Window.orderBy("part"))), F.lit(0)).alias("part_before"))
    own = ranged.withColumn("own_before", F.coalesce(F.sum("n").over(upto(Window.partitionBy("part").orderBy("o"))), F.lit(0)))
    return own.join(parts, "part").select(F.col("o").alias(order_col), (F.col("own_before") + F.col("part_before")).alias("before"))


def looked_up(blocks: DataFrame, table: DataFrame, key: str, value: str, *kept: str) -> DataFrame:
    """Blocks (orders, sizes, codes, those kept) with ``values``: of each item its place and what the table has for it, null if nothing, in any order. An item is joined once per block."""
    items = blocks.select("block", F.posexplode("items").alias("k", "item"))
    found = items.join(table.select(F.col(key).alias("item"), F.col(value).alias("value")), "item", "left")
    values = found.groupBy("block").agg(F.collect_list(F.struct("k", "value")).alias("values"))
    return blocks.select("block", "orders", "sizes", "codes", *kept).join(values, "block", "left").drop("block")


def by_place(values: pa.ListScalar) -> pa.Array:
    """A block's values in the order of its items."""
    if values.values is None:
        return pa.array([], values.type.value_type.field("value").type)
    places = values.values.field("k").to_numpy(zero_copy_only=False)
    order = np.empty(len(places), np.int64)
    order[places] = np.arange(len(places))
    return values.values.field("value").take(pa.array(order))


def encode(docs: DataFrame, tokenizer: Tokenizer, vocab: DataFrame, order_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(order_col, ids); tokens that the vocabulary lacks are left out."""
    return encode_blocks(token_blocks(docs, tokenizer, order_col, text_col), vocab, order_col)


def encode_blocks(blocks: DataFrame, vocab: DataFrame, order_col: str = "doc_id") -> DataFrame:
    """(order_col, ids) of token blocks: ids are put in by their places in the block's dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                orders, sizes, codes, values = (column[b] for column in batch.columns)
                codes = np.frombuffer(codes.as_py(), "<i4")
                ids = by_place(values).take(pa.array(codes, mask=codes < 0))
                kept = pc.is_valid(ids).to_numpy(zero_copy_only=False)
                ends = np.r_[0, np.cumsum(kept)][np.r_[0, np.cumsum(np.maximum(sizes.values.to_numpy(), 0))]]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pc.drop_null(ids))
                yield pa.RecordBatch.from_arrays([orders.values, lists], names=[order_col, "ids"])

    order = dict(blocks.dtypes)["orders"][6:-1]
    return looked_up(blocks, vocab, "token", "id").mapInArrow(run, f"`{order_col}` {order}, ids array<bigint>")


def decode(encoded: DataFrame, tokenizer: Tokenizer, vocab: DataFrame, order_col: str = "doc_id") -> DataFrame:
    """(order_col, text, error): an id that the vocabulary lacks gives the error, of the first such id, and no text. Null ids are left out."""
    joiner = tokenizer.joined_by

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                orders, sizes, codes, items, values = (column[b] for column in batch.columns)
                codes = np.frombuffer(codes.as_py(), "<i4")
                kept = np.flatnonzero(codes >= 0)
                ends = np.searchsorted(kept, np.r_[0, np.cumsum(np.maximum(sizes.values.to_numpy(), 0))])
                codes, tokens = codes[kept], by_place(values).cast(pa.large_string())
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), tokens.take(pa.array(codes)))
                unknown = np.flatnonzero(pc.is_null(tokens).to_numpy(zero_copy_only=False)[codes])
                docs, first = np.unique(np.searchsorted(ends, unknown, side="right") - 1, return_index=True)
                errors = np.full(len(lists), None, object)
                errors[docs] = [f"Unknown token id: {i}" for i in items.values.take(pa.array(codes[unknown[first]])).to_pylist()]
                texts = pc.binary_join(lists, pa.scalar(joiner, pa.large_string())).cast(pa.string())  # none where a token is
                yield pa.RecordBatch.from_arrays([orders.values, texts, pa.array(errors, pa.string())], names=[order_col, "text", "error"])

    rows = encoded.select(F.col(order_col).alias("doc_order"), F.col("ids").cast("array<bigint>").alias("items"))
    order = dict(rows.dtypes)["doc_order"]
    return looked_up(blocks_of(rows, "bigint"), vocab, "id", "token", "items").mapInArrow(run, f"`{order_col}` {order}, text string, error string")
