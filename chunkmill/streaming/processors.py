"""Stateful processors: uploads, model loops and chat sessions, one state per file or session in the state store.

Each takes a key's rows of a micro-batch in order of ``seq``, works with what the batch touches, and writes that back once;
state is kept by part, tool call and segment, so a batch costs what it touches, however long the upload or session is.
They need the RocksDB state store (``jobs.run_until_done`` sets it).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import chat, uploads


def by_name(name: str | None) -> tuple[str]:
    """The state's key of an id that may be null."""
    return ("n",) if name is None else (f"v{name}",)


class Held:
    """A map state, read by key when asked for and written back once."""

    def __init__(self, state, value=lambda x: x, stored=lambda x: x, key=lambda k: (k,)):
        self.state, self.value, self.stored, self.key = state, value, stored, key
        self.known: dict = {}
        self.emptied = False

    def get(self, key):
        if key not in self.known:
            found = None if self.emptied or not self.state.containsKey(self.key(key)) else self.state.getValue(self.key(key))
            self.known[key] = None if found is None else self.value(found[0])
        return self.known[key]

    def __contains__(self, key) -> bool:
        return self.get(key) is not None

    def __getitem__(self, key):
        return self.get(key)

    def __setitem__(self, key, value) -> None:
        self.known[key] = value

    def clear(self) -> None:
        self.known, self.emptied = {}, True

    def store(self) -> None:
        if self.emptied:
            self.state.clear()
        for key, value in self.known.items():
            if value is not None:
                self.state.updateValue(self.key(key), (self.stored(value),))


def named(schema: str) -> Row:
    """A maker of rows with a schema's names."""
    return Row(*(f.split()[0] for f in schema.split(", ")))


UploadEvent, ChatEvent = named(uploads.EVENTS), named(chat.EVENTS)


def in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: r["seq"])


class HeldUpload(uploads.Upload):
    """An upload whose parts lie in the state store."""

    def __init__(self, held: Held, count: int, size: int):
        self.held = held
        self.count, self.size = count, size

    def clear(self) -> None:
        self.held.clear()
        self.count = self.size = 0

    def part(self, index: int) -> bytes | None:
        return self.held.get(index) if self.count else None

    def keep(self, index: int, data: bytes) -> None:
        self.held[index] = data


class Assembly(StatefulProcessor):
    """Parts to ``uploads.EVENTS``. An upload that gets no part for ``timeout_ms`` of processing time is given up."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "chunk_index int", "data binary")
        self.so_far = handle.getValueState("so_far", "file_name string, count int, size long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        file_id, before = key[0], self.so_far.get()
        upload = HeldUpload(Held(self.parts, bytes, bytes), *(before[1:] if before else (0, 0)))
        name = None
        for r in in_order(rows):
            name = r["file_name"]
            for event in uploads.events_of(upload, file_id, name, r["chunk_index"], r["total_chunks"], bytes(r["bytes"])):
                yield UploadEvent(*event)
        upload.held.store()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if upload.count:
            self.so_far.update((name, upload.count, upload.size))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        else:
            self.so_far.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self.so_far.get()
        self.parts.clear()
        self.so_far.clear()
        yield UploadEvent("ingest-failed", key[0], before[0] if before else None, None, None, f"Upload abandoned: {key[0]}")

    def close(self) -> None:
        pass


class ModelLoop(StatefulProcessor):
    """Model parts to ``chat.EVENTS``: the iteration, the open calls' arguments and the next event's number."""

    def __init__(self, max_iterations: int):
        self.max_iterations = max_iterations

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.loop = handle.getValueState("loop", "iteration int, opened boolean, seq long")
        self.calls = handle.getMapState("calls", "id string", "arguments string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.loop.get()
        loop = chat.Loop(*before) if before else chat.Loop()
        loop.calls = Held(self.calls, key=by_name)
        for e in chat.numbered_events(loop, key[0], (r.asDict() for r in in_order(rows)), self.max_iterations):
            yield ChatEvent(e["session_id"], e["seq"], e["_tag"], *[e.get(k) for k in chat.EVENT_FIELDS])
        loop.calls.store()
        self.loop.update((loop.iteration, loop.opened, loop.seq))

    def close(self) -> None:
        pass


class HeldSegments(chat.Segments):
    """Segments that lie in the state store by place, and the places of tools by id."""

    def __init__(self, segments: Held, places: Held, size: int, epoch: int):
        self.segments, self.places, self.size, self.epoch = segments, places, size, epoch

    def clear(self) -> None:
        self.segments.clear()
        self.places.clear()
        self.size, self.epoch = 0, self.epoch + 1

    def last(self) -> dict | None:
        return self.segments.get(self.size - 1) if self.size else None

    def add(self, segment: dict) -> None:
        if segment["tool"] is not None:
            tool = segment["tool"]["id"]
            self.places[tool] = [*(self.places.get(tool) or []), self.size]
        self.segments[self.size] = segment
        self.size += 1

    def tools(self, tool_id: str | None) -> list[dict]:
        return [self.segments.get(at)["tool"] for at in self.places.get(tool_id) or []]


#: Rows of a session's changes: the head has no place; a segment counts if it is of the head's epoch. ``told`` is JSON.
CHANGES = "session_id string, changed long, epoch int, pos int, told string"
Change = named(CHANGES)


class ChatSession(StatefulProcessor):
    """Chat events to the parts of a session's state that they change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "fields string, size int, epoch int")
        self.segments = handle.getMapState("segments", "pos int", "told string")
        self.places = handle.getMapState("places", "id string", "at string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.head.get()
        told, size, epoch = before if before else ("{}", 0, 0)
        segments = HeldSegments(Held(self.segments, json.loads, json.dumps), Held(self.places, json.loads, json.dumps, by_name), size, epoch)
        state, seq = chat.initial_state(segments) | json.loads(told), None
        for r in in_order(rows):
            state, seq = chat.step(state, r.asDict()), r["seq"]
        segments.segments.store()
        segments.places.store()
        fields = json.dumps({k: state[k] for k in chat.STATE_FIELDS if k != "segments"})
        self.head.update((fields, segments.size, segments.epoch))
        yield Change(key[0], seq, segments.epoch, None, fields)
        for pos, segment in segments.segments.known.items():
            if segment is not None:
                yield Change(key[0], seq, segments.epoch, pos, json.dumps(segment))

    def close(self) -> None:
        pass
