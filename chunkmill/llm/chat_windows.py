"""Chat formatting in budgeted windows.

Turns of a conversation get running sums of their tokens (words plus the template's share). A window holds the
turns whose sum ends within one stride, so spans are aligned to turns. A stride is half of what the system turn leaves
of the budget (a quarter of the budget at least): as a window's first turn may begin in the stride before, its turns come
to less than two strides. Every window after the conversation's system turn (the first turn of that role) begins with it,
cut to its first words if it is longer than half of the budget, and repeats, nearest first, up to ``HISTORY`` turns before its span, as many as the budget leaves room for; what is
repeated is masked, so each assistant text is under exactly one loss mask. ``tokens`` is a window's whole sum. It exceeds
the budget only where a single turn is longer than a stride, as a window's own turns aren't cut; such a window has no history.

A turn is written ``### role: text </turn>`` and a line end. In texts and roles every backslash, ``#`` and ``<``
gets a backslash in front (in roles the colon too), so control strings never appear inside and reading back is
exact.

Running sums need no task per conversation: turns are dealt out by ranges of conversation and turn, each partition sums
its own part of a conversation, and only the parts' totals are summed along a conversation. History is found by
equi-join on the turn's number. The digest over a whole conversation is sequential by its definition: its windows are
sorted and streamed through one hash state, in memory for one window at a time.

Nulls: a null text or role counts as empty, a null turn sorts first, and null identifiers form one conversation.
Rows with equal turn are ordered by role and MD5 of the text; repeated rows are turns of their own. A very long text is
one turn, held once per window that it is in. An empty table gives an empty result. Other columns play no part, whatever
their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stage_table

BUDGET, HISTORY, TURN_COST = 1024, 2, 4
#: Tokens of the system turn that windows repeat at most.
SYSTEM_SHARE = BUDGET // 2
#: Conversations by a key that tells null from every number.
NONE = "n"


def escaped(column: Column, also: str = "") -> Column:
    return F.regexp_replace(column, rf"([\\#<{also}])", r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def local_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns with their number and running sum of tokens in this partition's part of the conversation."""
    part, conv, nth, ends = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        names, tokens = batch.column(0).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
        new = np.flatnonzero(np.r_[names[0] != conv, names[1:] != names[:-1]])
        upto, number = np.cumsum(tokens), np.arange(1, len(names) + 1)
        base = np.zeros((2, len(names)), np.int64)
        base[:, 0] = -nth, -ends
        base[:, new] = new, upto[new] - tokens[new]
        at = np.zeros(len(names), np.int64)
        at[new] = new
        at = np.maximum.accumulate(at)
        own, sums = number - base[0, at], upto - base[1, at]
        conv, nth, ends = names[-1], own[-1], sums[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(names), part, np.int64)), pa.array(own), pa.array(sums)], names=[*batch.schema.names, "part", "nth", "ends"])


def numbered_turns(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Each turn with its number in the conversation, its window, and number of the system turn and the tokens that windows repeat of it (null and 0 without one)."""
    key = F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("long").cast("string")), F.lit(NONE))
    turn = F.col("turn").cast("long")
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = (F.regexp_count(text, F.lit(WORD)) + TURN_COST).cast("long")
    order = ["conv", "turn", "role", "tie", "row"]
    rows = turns.select(key.alias("conv"), F.coalesce(F.col("role"), F.lit("")).alias("role"), text.alias("text"), tokens.alias("tokens"), turn.alias("turn"), F.md5(text.cast("binary")).alias("tie"), F.monotonically_increasing_id().alias("row"))
    sums = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text", "tokens").mapInArrow(local_sums, "conv string, role string, text string, tokens long, part long, nth long, ends long")
    placed = stage_table(spark, sums, "turns")
    whole = Window.partitionBy("conv")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("part_tokens"), F.min(F.when(F.col("role") == "system", F.struct("nth", "tokens"))).alias("system"))
    parts = parts.select("conv", "part", "system", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("tokens_before"))
    first = F.min(F.when(F.col("system").isNotNull(), F.struct((F.col("system.nth") + F.col("rows_before")).alias("n"), F.col("system.tokens").alias("tokens")))).over(whole)
    parts = parts.withColumn("first_system", first)
    found = placed.join(parts.hint("merge"), ["conv", "part"])
    system_tokens = F.least(F.coalesce("first_system.tokens", F.lit(0)), F.lit(SYSTEM_SHARE))
    stride = F.greatest(F.floor((BUDGET - system_tokens) / 2), F.lit(BUDGET // 4))
    ends = F.col("ends") + F.col("tokens_before")
    return found.select("conv", (F.col("nth") + F.col("rows_before")).alias("n"), "role", "text", "tokens", F.floor((ends - 1) / stride).alias("window"), F.col("first_system.n").alias("system_n"), system_tokens.alias("system_tokens"))


def chat_windows(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """``turns``: conv_id, turn, role, text. A row per window: ``conv_id``, ``window``, ``formatted``, ``repeated`` (leading turns that are repeated), ``loss_spans`` (code points, end exclusive), ``tokens``."""
    own = stage_table(spark, numbered_turns(spark, turns), "numbered")
    later = F.col("first") > F.col("system_n")
    windows = own.groupBy("conv", "window", "system_n", "system_tokens").agg(F.min("n").alias("first"), F.sum("tokens").alias("new_tokens"))
    windows = windows.withColumn("room", BUDGET - F.col("new_tokens") - F.when(later, F.col("system_tokens")).otherwise(0))
    part = lambda repeated: F.struct(F.lit(repeated).alias("own"), "n", "role", "text", "tokens").alias("part")
    new = own.select("conv", "window", part(1))
    wanted = windows.select("conv", "window", "room", F.explode(F.array(*[F.col("first") - k for k in range(1, HISTORY + 1)])).alias("n"), "system_n").filter("n >= 1 AND NOT (n <=> system_n)").drop("system_n")
    nearest = Window.partitionBy("conv", "window").orderBy(F.desc("n"))  # HISTORY rows
    history = wanted.join(own.select("conv", "n", "role", "text", "tokens"), ["conv", "n"]).withColumn("repeats", F.sum("tokens").over(nearest)).filter("repeats <= room").select("conv", "window", part(0))
    space = WORD.replace("^", "")
    start = F.regexp_extract("text", rf"\A{space.replace('+', '*+')}(?:{WORD}+{space.replace('+', '*+')}){{0,{SYSTEM_SHARE - TURN_COST}}}+", 0)
    system = own.filter("n = system_n").select("conv", "n", "role", F.when(F.col("tokens") > SYSTEM_SHARE, start).otherwise(F.col("text")).alias("text"), F.least("tokens", F.lit(SYSTEM_SHARE)).alias("tokens"))
    kept = windows.filter(later).select("conv", "window").join(system, "conv").select("conv", "window", part(0))
    parts = new.unionByName(history).unionByName(kept).groupBy("conv", "window").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.sum("part.tokens").alias("tokens"))  # a budget's worth
    head = lambda p: F.concat(F.lit("### "), escaped(p["role"], ":"), F.lit(": "))
    body = lambda p: escaped(p["text"])
    tail = " </turn>\n"

    def add(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(head(p))
        stop = start + F.length(body(p))
        spans = F.when((p["own"] == 1) & (p["role"] == "assistant"), F.array(F.struct(start.alias("start"), stop.alias("stop")))).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))
        return F.struct((stop + len(tail)).alias("at"), F.concat(state["spans"], spans).alias("spans"))

    spans = F.aggregate("parts", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")), add)["spans"]
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(head(p), body(p), F.lit(tail))), "")
    repeated = F.size(F.filter("parts", lambda p: p["own"] == 0))
    conv = F.when(F.col("conv") != NONE, F.substr("conv", F.lit(2)).cast("long"))
    return parts.select(conv.alias("conv_id"), "window", formatted.alias("formatted"), repeated.alias("repeated"), spans.alias("loss_spans"), "tokens")


TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\#<])*) </turn>\n", re.S)


def read_window(formatted: str) -> list[tuple[str, str]]:
    """The turns of a window, unescaped."""
    out, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by conversation and window; one conversation's hash state at a time."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, rows = None, []

    def closed(state):
        return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

    for batch in batches:
        for row in batch.to_pylist():
            if now is None or now[0] != row["conv_id"]:
                if now is not None:
                    rows.append(closed(now))
                now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            own = read_window(row["formatted"])[row["repeated"] :]
            now[1] += len(own)
            for role, text in own:
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
            for span in row["loss_spans"]:
                text = unescape(row["formatted"][span["start"] : span["stop"]])
                now[3] += len(text)
                now[4].update(text.encode("utf-8", "replace"))
            now[5] += len(row["formatted"])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
            rows = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(closed(now), kinds)], names=names)


def chat_digests(windows: DataFrame) -> DataFrame:
    """A row per conversation, read back from the windows."""
    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(digest, DIGESTS)
