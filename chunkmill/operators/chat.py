"""Chat logs: model parts to events, the fold of events to a session's state, histories, usage and summaries."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

MAX_ITERATIONS = 12
TOOL = "struct<id:string,name:string,arguments:string,arguments_text:string,status:string,result:string,success:boolean>"
SEGMENT = f"struct<kind:string,content:string,is_complete:boolean,tool:{TOOL}>"
STATE = (
    f"session_id string, _tag string, segments array<{SEGMENT}>, thinking string, current_iteration int, finish_reason string, prompt_tokens long, "
    "completion_tokens long, total_tokens long, error_message string, recoverable boolean"
)
STATE_FIELDS = ("_tag", "segments", "thinking", "current_iteration", "finish_reason", "prompt_tokens", "completion_tokens", "total_tokens", "error_message", "recoverable")
TOOL_EVENTS = ("tool-call-delta", "tool-call-complete", "tool-execution-start", "tool-execution-complete")
#: What an event has besides its session, number and tag.
EVENT_FIELDS = {
    "delta": "string", "message": "string", "iteration": "int", "id": "string", "name": "string", "arguments_delta": "string", "arguments": "string", "result": "string",
    "success": "boolean", "finish_reason": "string", "prompt_tokens": "bigint", "completion_tokens": "bigint", "total_tokens": "bigint", "recoverable": "boolean",
}
EVENTS = "session_id string, seq long, _tag string, " + ", ".join(f"{k} {t}" for k, t in EVENT_FIELDS.items())


class Segments:
    """A session's segments in order, and the tools among them by id. Whoever asks for one may change it."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.items: list[dict] = []
        self.by_id: dict[str | None, list[dict]] = {}

    def last(self) -> dict | None:
        return self.items[-1] if self.items else None

    def add(self, segment: dict) -> None:
        self.items.append(segment)
        if segment["tool"] is not None:
            self.by_id.setdefault(segment["tool"]["id"], []).append(segment["tool"])

    def tools(self, tool_id: str | None) -> list[dict]:
        return self.by_id.get(tool_id, [])


def initial_state(segments: Segments | None = None) -> dict:
    return dict.fromkeys(STATE_FIELDS) | {"_tag": "initial", "segments": segments or Segments()}


def fields_of(state: dict) -> dict:
    return {k: state[k] for k in STATE_FIELDS} | {"segments": state["segments"].items}


def some(value):
    """pandas marks absent values in several ways."""
    return None if value is None or value != value else value


def enter(state: dict, tag: str, **changes) -> None:
    """The state under another tag, with nothing but its segments and the changes."""
    state.update(dict.fromkeys(STATE_FIELDS) | {"_tag": tag, "segments": state["segments"]} | changes)


def stream_on(state: dict, **changes) -> None:
    """Streaming; thinking and iteration stay only if it was so before."""
    kept = {k: state[k] for k in ("thinking", "current_iteration")} if state["_tag"] == "streaming" else {}
    enter(state, "streaming", **kept | changes)


def step(state: dict, e: dict) -> dict:
    """The state after one event; it is changed in place, so an event costs the same however long the session is."""
    tag, live, segments = e["_tag"], state["_tag"] == "streaming", state["segments"]
    last = segments.last() if tag in ("text-delta", "text-complete") else None
    opened = last is not None and last["kind"] == "text" and not last["is_complete"]
    if tag == "text-delta":
        if opened:
            last["content"] += some(e["delta"]) or ""
        else:
            segments.add({"kind": "text", "content": some(e["delta"]) or "", "is_complete": False, "tool": None})
        stream_on(state)
    elif tag == "tool-call-start":
        tool = {"id": some(e["id"]), "name": some(e["name"]), "arguments": None, "arguments_text": "", "status": "proposed", "result": None, "success": None}
        segments.add({"kind": "tool-call", "content": None, "is_complete": None, "tool": tool})
        stream_on(state)
    elif tag == "iteration-start":
        stream_on(state, current_iteration=int(e["iteration"]))
    elif tag == "thinking":
        stream_on(state, thinking=some(e["message"]))
    elif tag in ("finish", "error"):
        if not live:
            segments.clear()
        if tag == "error":
            enter(state, "error", error_message=some(e["message"]), recoverable=some(e["recoverable"]))
        else:
            enter(state, "complete", finish_reason=some(e["finish_reason"]), **{k: None if some(e[k]) is None else int(e[k]) for k in ("prompt_tokens", "completion_tokens", "total_tokens")})
    elif live and tag == "text-complete" and opened:
        last["is_complete"] = True
    elif live and tag == "iteration-end":
        state["current_iteration"] = None
    elif live and tag in TOOL_EVENTS:
        for tool in segments.tools(some(e["id"])):
            tool.update(tool_change(tool, e))
    return state


def tool_change(tool: dict, e: dict) -> dict:
    tag = e["_tag"]
    if tag == "tool-call-delta":
        return {"arguments_text": tool["arguments_text"] + (some(e["arguments_delta"]) or "")}
    if tag == "tool-call-complete":
        return {"arguments": some(e["arguments"])}
    if tag == "tool-execution-start":
        return {"status": "executing"}
    good = bool(some(e["success"]))
    return {"status": "complete" if good else "failed", "result": some(e["result"]), "success": good}


def merged_deltas(events: DataFrame) -> DataFrame:
    """Runs of deltas of one text or one tool call as one event, concatenated in order, so that a fold sees one row per run."""
    per = Window.partitionBy("session_id").orderBy("seq")
    key = F.concat_ws("|", "_tag", F.when(F.col("_tag") == "tool-call-delta", F.col("id")))
    delta = F.col("_tag").isin("text-delta", "tool-call-delta")
    starts = F.coalesce(~(delta & (key == F.lag(key).over(per))), F.lit(True))
    runs = events.withColumn("_run", F.sum(starts.cast("int")).over(per))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "delta", "arguments_delta")))
    joined = lambda name: F.array_join(F.transform(ordered, lambda x: x[name]), "")
    others = [c for c in events.columns if c not in ("session_id", "delta", "arguments_delta")]
    first = [F.min_by(c, "seq").alias(c) for c in others]
    return runs.groupBy("session_id", "_run").agg(*first, joined("delta").alias("delta"), joined("arguments_delta").alias("arguments_delta")).select(*events.columns)


def fold_chat(events: DataFrame) -> DataFrame:
    """Last state per session: events sorted by session and number stream through one state at a time, deltas joined before."""
    arrow = to_arrow_schema(_parse_datatype_string(STATE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, state, out = None, None, []
        for batch in batches:
            for e in batch.to_pylist():
                if state is None or e["session_id"] != session:
                    if state is not None:
                        out.append({"session_id": session} | fields_of(state))
                    session, state = e["session_id"], initial_state()
                state = step(state, e)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"session_id": session} | fields_of(state)], schema=arrow)

    return merged_deltas(events).repartition("session_id").sortWithinPartitions("session_id", "seq").mapInArrow(run, STATE)


class Loop:
    """Where a session's model loop stands: the iteration, whether a part of it has come, its tool calls' arguments by id, and the next event's number."""

    def __init__(self, iteration: int = 0, opened: bool = False, seq: int = 0):
        self.iteration, self.opened, self.seq = iteration, opened, seq
        self.calls: dict[str | None, str] = {}


def json_object(text: str) -> str:
    """A JSON object as it is; anything else as an empty one."""

    def refuse(name: str):
        raise ValueError(name)

    try:
        return text if isinstance(json.loads(text, parse_constant=refuse), dict) else "{}"
    except (ValueError, RecursionError):
        return "{}"


def part_step(loop: Loop, p: dict, max_iterations: int) -> Iterator[dict]:
    """The events of one model part; the loop is changed in place. A finish ends the iteration, and the next part opens another with calls of its own."""
    kind, tool = p["type"], some(p["id"])
    if not loop.opened:
        loop.iteration, loop.opened = loop.iteration + 1, True
        loop.calls.clear()
        yield {"_tag": "iteration-start", "iteration": loop.iteration}
    if kind == "text-delta":
        yield {"_tag": "text-delta", "delta": some(p["delta"])}
    elif kind == "tool-params-start":
        loop.calls[tool] = ""
        yield {"_tag": "tool-call-start", "id": tool, "name": some(p["name"])}
    elif kind == "tool-params-delta" and tool in loop.calls:
        loop.calls[tool] += some(p["delta"]) or ""
        yield {"_tag": "tool-call-delta", "id": tool, "arguments_delta": some(p["delta"])}
    elif kind == "tool-params-end" and tool in loop.calls:
        yield {"_tag": "tool-call-complete", "id": tool, "arguments": json_object(loop.calls[tool])}
        yield {"_tag": "tool-execution-start", "id": tool}
    elif kind == "tool-result" and tool in loop.calls:
        yield {"_tag": "tool-execution-complete", "id": tool, "result": some(p["result"]), "success": not some(p["is_failure"])}
    elif kind == "error":
        yield {"_tag": "error", "message": some(p["error"]), "recoverable": False}
    elif kind == "finish":
        loop.opened = False
        reason, prompt, completion = some(p["reason"]), int(some(p["input_tokens"]) or 0), int(some(p["output_tokens"]) or 0)
        if reason != "tool-calls":
            yield {"_tag": "finish", "finish_reason": reason, "prompt_tokens": prompt, "completion_tokens": completion, "total_tokens": prompt + completion}
        elif loop.iteration == max_iterations:
            yield {"_tag": "thinking", "message": f"Reached maximum iterations ({max_iterations}). Stopping here."}


def numbered_events(loop: Loop, session_id: str, parts: Iterable[dict], max_iterations: int) -> Iterator[dict]:
    for p in parts:
        for e in part_step(loop, p, max_iterations):
            yield {"session_id": session_id, "seq": loop.seq} | e
            loop.seq += 1


#: Events of a batch that a fold hands on at once.
FLUSH = 8192


def part_events(parts: DataFrame, max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """Model parts to chat events, numbered per session.

    ``parts``: session_id, seq, type, id, name, delta, result, is_failure, reason, input_tokens, output_tokens, error.
    Iterations end with a finish part; ``iteration-start`` opens each, and a thinking event tells of the limit. Parts of a
    tool call that did not start in the same iteration are dropped. One shuffle: parts stream through a loop's state in sorted order.
    """
    arrow = to_arrow_schema(_parse_datatype_string(EVENTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        out: list[dict] = []
        for session, own in itertools.groupby(rows, key=lambda r: r["session_id"]):
            for e in numbered_events(Loop(), session, own, max_iterations):
                out.append(e)
                if len(out) == FLUSH:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return parts.repartition("session_id").sortWithinPartitions("session_id", "seq").mapInArrow(run, EVENTS)


def tool_calls(events: DataFrame) -> DataFrame:
    """One row per tool call of a session: name, arguments, result; results of unknown calls are dropped."""
    tag, seq = F.col("_tag"), F.col("seq")
    at = lambda kind: F.when(tag == kind, seq)
    deltas = F.transform(F.array_sort(F.collect_list(F.when(tag == "tool-call-delta", F.struct("seq", "arguments_delta")))), lambda x: x["arguments_delta"])
    out = events.filter(tag.startswith("tool-")).groupBy("session_id", "id").agg(
        F.max_by("name", at("tool-call-start")).alias("name"),
        F.max(at("tool-call-start")).alias("started"),
        F.array_join(deltas, "").alias("arguments_text"),
        F.max_by("arguments", at("tool-call-complete")).alias("arguments"),
        F.max_by("result", at("tool-execution-complete")).alias("result"),
        F.max_by("success", at("tool-execution-complete")).alias("success"),
    )
    return out.filter("started IS NOT NULL").drop("started")


def token_usage(parts: DataFrame) -> DataFrame:
    """Tokens per session, from finishes that don't call tools."""
    prompt, completion = F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0))
    ended = parts.filter((F.col("type") == "finish") & ~F.col("reason").eqNullSafe("tool-calls"))
    return ended.groupBy("session_id").agg(F.sum(prompt).alias("prompt_tokens"), F.sum(completion).alias("completion_tokens"), F.sum(prompt + completion).alias("total_tokens"))


def session_summary(parts: DataFrame, max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """Iterations run, last finish reason, and whether the limit stopped the session."""
    ended = F.col("type") == "finish"
    out = parts.groupBy("session_id").agg(F.count_if(ended).cast("int").alias("finishes"), F.max_by("reason", F.when(ended, F.col("seq"))).alias("reason"), F.max("seq").alias("last"), F.max(F.when(ended, F.col("seq"))).alias("last_finish"))
    reason = F.coalesce("reason", F.lit("stop"))
    iterations = F.col("finishes") + F.coalesce((F.col("last") > F.col("last_finish")).cast("int"), F.lit(1))
    return out.select("session_id", iterations.alias("iterations"), reason.alias("finish_reason"), ((reason == "tool-calls") & (iterations >= max_iterations)).alias("hit_limit"))


def ordered_text(events: DataFrame, *keys: str) -> DataFrame:
    """Text deltas per key, concatenated in order."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("delta", F.lit("")).alias("delta")))), lambda d: d["delta"])
    return events.filter("_tag = 'text-delta'").groupBy(*keys).agg(F.array_join(said, "").alias("text"))


def history_messages(history: DataFrame) -> DataFrame:
    """``history``: role, message, segments. Content: an assistant's text segments joined, or its message if they are empty."""
    said = F.array_join(F.transform(F.filter("segments", lambda s: s["kind"] == "text"), lambda s: s["content"]), "")
    return history.withColumn("content", F.when(F.col("role") == "assistant", F.coalesce(F.nullif(said, F.lit("")), F.col("message"))).otherwise(F.col("message")))
