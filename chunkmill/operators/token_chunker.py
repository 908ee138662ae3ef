"""Token windows, in column functions where tokens are cut by delimiters: no token is ever exploded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.config import TokenConfig
from ..functions.text import is_blank, starts_of, utf16_length
from ..functions.tokenizers import Tokenizer
from . import cuts
from .chunk_lists import chunk_column

CHUNK = "array<struct<text:string,start_idx:int,end_idx:int,token_count:int>>"


def window_numbers(n: Column, size: int, stride: int) -> Column:
    """0 .. windows - 1; the window that reaches the end is the last one."""
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / stride))
    return F.when(n > 0, F.sequence(F.lit(0), last.cast("int"))).otherwise(F.array().cast("array<int>"))


def token_chunks(text: Column, config: TokenConfig = TokenConfig(), keep_blank: bool = False) -> Column:
    """Array of (text, start_idx, end_idx, token_count); with a tokenizer of another kind than delimiters by a helper in tasks.

    A window starts where the one before ended less the length of the overlap as decoded; without overlap the
    joiner between two windows isn't counted. Blank texts have no chunks, unless ``keep_blank`` asks for the windows of any text's tokens.
    """
    if not config.tokenizer.on_columns:
        return F.transform(chunk_column(text, lambda t: cuts.windows(t, config), keep_blank), lambda c: F.struct(*[c[k].alias(k) for k in ("text", "start_idx", "end_idx", "token_count")]))
    size, stride, over = config.chunk_size, config.chunk_size - config.chunk_overlap, config.chunk_overlap

    def windows(t: Column) -> Column:
        made = character_windows(t, size, stride) if config.tokenizer.delimiter == "" else joined_windows(config.tokenizer, config.tokenizer.tokens(t), size, stride, over)
        return F.when(t.isNull() if keep_blank else is_blank(t), F.array().cast(CHUNK)).otherwise(made)

    return bound(text, windows)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: inside a lambda an expression would be computed at every call."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunk(text: Column, start: Column, count: Column) -> Column:
    return F.struct(text.alias("text"), start.cast("int").alias("start_idx"), (start + utf16_length(text)).cast("int").alias("end_idx"), count.cast("int").alias("token_count"))


def character_windows(text: Column, size: int, stride: int) -> Column:
    """Characters need no running sum where each is a byte: a window is cut by its place. Other texts are first cut into parts of a
    stride's length; a window joins the parts that it reaches into, so that none is looked for from the text's start."""

    def narrow(s: Column) -> Column:
        def one(k: Column) -> Column:
            start, n = k * stride, F.least(F.lit(size), s["n"] - k * stride)
            return F.struct(F.substr(s["bytes"], start + 1, F.lit(size)).cast("string").alias("text"), start.alias("start_idx"), (start + n).alias("end_idx"), n.alias("token_count"))

        return F.transform(window_numbers(s["n"], size, stride), one)

    def wide(s: Column) -> Column:
        numbers = window_numbers(s["n"], size, stride)
        joined = lambda k: F.substr(F.array_join(F.slice(s["parts"], k + 1, -(-size // stride)), ""), F.lit(1), F.lit(size))
        sized = F.transform(F.transform(numbers, joined), lambda t: F.struct(t.alias("text"), utf16_length(t).alias("n")))
        starts = F.slice(starts_of(F.transform(s["parts"], utf16_length)), F.lit(1), F.size(numbers))
        return F.zip_with(sized, starts, lambda w, at: F.struct(w["text"].alias("text"), at.alias("start_idx"), (at + w["n"]).alias("end_idx"), w["n"].alias("token_count")))

    n = F.length(text)
    plain = F.struct(n.alias("n"), text.cast("binary").alias("bytes"))
    cut = F.struct(n.alias("n"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0)).alias("parts"))
    return F.when(n == F.octet_length(text), bound(plain, narrow)).otherwise(bound(cut, wide))


def joined_windows(tokenizer: Tokenizer, tokens: Column, size: int, stride: int, over: int) -> Column:
    """Windows as texts, with the length that each steps back; starts are the running sum of both."""
    joined = lambda a: F.array_join(a, tokenizer.joined_by)

    def part(tokens: Column, k: Column) -> Column:
        own = joined(F.slice(tokens, k * stride + 1, size))
        back = F.when(k > 0, utf16_length(joined(F.slice(tokens, k * stride + 1, over)))).otherwise(0) if over else F.lit(0)
        return F.struct(own.alias("text"), utf16_length(own).alias("chars"), back.alias("back"), F.least(F.lit(size), F.size(tokens) - k * stride).alias("n"))

    def starts(parts: Column) -> Column:
        moved = starts_of(F.transform(parts, lambda p: p["chars"] - p["back"]))  # with each window's own step back still to take
        return F.zip_with(moved, parts, lambda at, p: at - p["back"])

    parts = bound(tokens, lambda t: F.transform(window_numbers(F.size(t), size, stride), lambda k: part(t, k)))
    return bound(parts, lambda ps: F.zip_with(ps, starts(ps), lambda p, at: chunk(p["text"], at, p["n"])))
