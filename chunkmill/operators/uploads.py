"""Upload parts to files, the events of an ingest, and the fold of upload events to states."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MAX_FILE_BYTES

BATCH = 1000
ASSEMBLED = "file_id string, file_name string, total_chunks int, received int, complete boolean, missing int, content binary, error string"
EVENTS = "event string, file_id string, file_name string, chunk_index int, content binary, error string"
ASSEMBLED_NAMES, EVENT_NAMES = ([c.split()[0] for c in x.split(", ")] for x in (ASSEMBLED, f"{EVENTS}, n int"))
ASSEMBLED_ARROW = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.string())
EVENTS_ARROW = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int32())
INGEST_FAILED = "Ingest failed. Check server logs."


def latest_parts(parts: DataFrame) -> DataFrame:
    """Of equal parts the last to arrive, decoded."""
    last = parts.groupBy("file_id", "chunk_index").agg(F.max_by(F.struct("file_name", "total_chunks", "data"), "seq").alias("p"), F.max("seq").alias("seq"))
    return last.select("file_id", "chunk_index", "seq", "p.file_name", "p.total_chunks", F.coalesce(F.try_to_binary("p.data", F.lit("base64")), F.lit(b"")).alias("bytes"))


class Upload:
    """The parts of one upload so far."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.parts: dict[int, bytes] = {}
        self.count = self.size = 0

    def put(self, index: int, data: bytes) -> None:
        before = self.part(index)
        self.count += before is None
        self.size += len(data) - len(before or b"")
        self.keep(index, data)

    def part(self, index: int) -> bytes | None:
        return self.parts.get(index)

    def keep(self, index: int, data: bytes) -> None:
        self.parts[index] = data


def received(upload: Upload, file_id: str, file_name: str, index: int, total: int, data: bytes) -> tuple[str, bytes | None, int | None, str | None] | None:
    """Take a part in. With as many different parts as its message tells, or more, the upload ends: its outcome is
    (event, content, first missing part, error), and a later part opens a new one. An upload past the size limit ends, too."""
    upload.put(index, data)
    if upload.size > MAX_FILE_BYTES:
        outcome = "ingest-failed", None, None, f"{file_name}: exceeds 100MB limit"
    elif upload.count < total:
        return None
    else:
        parts = [upload.part(i) for i in range(total)]
        missing = next((i for i, p in enumerate(parts) if not p), None)
        outcome = ("file", b"".join(parts), None, None) if missing is None else ("ingest-failed", None, missing, f"Missing chunk {missing} for {file_id}")
    upload.clear()
    return outcome


def in_order(parts: DataFrame) -> DataFrame:
    """Parts, decoded, file by file in the order of their messages; each task gets whole files."""
    data = F.coalesce(F.try_to_binary("data", F.lit("base64")), F.lit(b""))
    own = parts.select("file_id", "file_name", F.coalesce("chunk_index", F.lit(-1)).cast("int").alias("chunk_index"), F.coalesce("total_chunks", F.lit(0)).cast("int").alias("total_chunks"), data.alias("bytes"), "seq")
    return own.repartition("file_id").sortWithinPartitions("file_id", "seq", "chunk_index", "bytes")


def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[tuple]]]:
    """Files with their messages (file_name, chunk_index, total_chunks, bytes)."""
    rows = ((r[0], r[1:5]) for b in batches for i in range(b.num_rows) for r in [tuple(c[i].as_py() for c in b.columns)])
    for file_id, own in itertools.groupby(rows, key=lambda r: r[0]):
        yield file_id, (r for _, r in own)


def assemble(parts: DataFrame) -> DataFrame:
    """``parts``: file_id, file_name, chunk_index, total_chunks, data, seq. One row per file.

    Messages are taken in order of ``seq``, and an upload is complete with the message that tells of no more parts than have come;
    of equal parts the last wins. The row is that of the file's last complete upload, if there is one: ``total_chunks`` and
    ``received`` parts at that message, and ``content``, or ``missing`` and ``error`` for the first part that is absent or empty. Else it is that of
    the open one. Files stream through in sorted order; a task holds one upload, bounded by the size limit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file_id, own in messages(batches):
            upload, row = Upload(), None
            for name, index, total, data in own:
                count = upload.count + (upload.part(index) is None)
                outcome = received(upload, file_id, name, index, total, data)
                if outcome is not None:
                    event, content, missing, error = outcome
                    row = file_id, name, total, count, event == "file" or missing is not None, missing, content, error
                elif row is None or not row[4]:
                    row = file_id, name, total, count, False, None, None, None
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, ASSEMBLED_ARROW)], names=ASSEMBLED_NAMES)

    return in_order(parts).mapInArrow(run, ASSEMBLED)


def assembly_events(parts: DataFrame) -> DataFrame:
    """All that happens to uploads, in order of ``n`` per file: ``chunk-received`` per part, then ``file`` with its content or ``ingest-failed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file_id, own in messages(batches):
            upload, n = Upload(), itertools.count()
            for message in own:
                rows = [(*r, next(n)) for r in events_of(upload, file_id, *message)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), EVENTS_ARROW)], names=EVENT_NAMES)

    return in_order(parts).mapInArrow(run, f"{EVENTS}, n int")


def events_of(upload: Upload, file_id: str, name: str, index: int, total: int, data: bytes) -> Iterator[tuple]:
    """Rows of ``EVENTS`` for one part."""
    outcome = received(upload, file_id, name, index, total, data)
    yield "chunk-received", file_id, name, index, None, None
    if outcome is not None:
        event, content, _, error = outcome
        yield event, file_id, name, None, content, error


def ingest_events(files: DataFrame, batch: int = BATCH) -> DataFrame:
    """``files``: file_id, chunks (their number), error. Start, progress per batch, complete; or failed."""
    event = lambda order, tag, processed=None, total=None, message=None: F.struct(
        order.cast("int").alias("ord"), F.lit(tag).alias("_tag"), (processed if processed is not None else F.lit(None)).cast("int").alias("processed"),
        (total if total is not None else F.lit(None)).cast("int").alias("total"), (message if message is not None else F.lit(None)).cast("string").alias("message"),
    )
    n = F.coalesce(F.col("chunks"), F.lit(0))
    batches = F.ceil(n / batch).cast("int")
    steps = F.when(batches > 0, F.sequence(F.lit(1), batches)).otherwise(F.array().cast("array<int>"))
    progress = F.transform(steps, lambda k: event(k, "ingest-progress", F.least(k * batch, n), n))
    good = F.concat(F.array(event(F.lit(0), "ingest-start")), progress, F.array(event(batches + 1, "ingest-complete", None, n)))
    failed = F.array(event(F.lit(0), "ingest-failed", None, None, F.col("error")))
    return files.select(F.col("file_id").alias("id"), F.inline(F.when(F.col("error").isNull(), good).otherwise(failed)))


def batch_progress(chunks: DataFrame, batch: int = BATCH) -> DataFrame:
    """Each chunk's batch number and how many are processed after that batch: arithmetic, no window."""
    number = F.floor(F.col("chunk_index") / batch).cast("int")
    return chunks.withColumn("batch", number).withColumn("processed", F.least((number + 1) * batch, F.col("chunk_count")).cast("int"))


def folded_states() -> list[Column]:
    """Aggregates of a file's events: its last values. Combined before the shuffle, and as fit for a stream."""
    tag, seq, status = F.col("_tag"), F.col("seq"), F.col("status")
    ended = (tag == "ingest") & status.isin("complete", "error")
    new_status = F.when((tag == "status") | ended, status)
    new_error = F.when(tag == "status", F.col("error")).when(ended, F.lit(INGEST_FAILED))
    at = lambda which: F.when(which, seq)
    return [
        F.max_by(new_status, at((tag == "status") | ended)).alias("e_status"),
        F.max_by(F.struct(new_error.alias("e")), at((tag == "status") | (tag == "ingest") & (status == "error"))).alias("e_error"),
        F.max_by(status == "start", at(tag == "ingest")).alias("e_ingesting"),
        F.max_by(F.struct("chunks_uploaded", "progress"), at(tag == "progress")).alias("e_progress"),
    ]


def upload_states(files: DataFrame, events: DataFrame) -> DataFrame:
    """Folds events by id onto the initial states; events of unknown ids are dropped.

    ``events``: _tag (status, progress, ingest), id, status (of an ingest event: start, complete, error), error,
    chunks_uploaded, progress, seq.
    """
    return states_of(files, events.groupBy("id").agg(*folded_states()))


def states_of(files: DataFrame, folded: DataFrame) -> DataFrame:
    """Initial states under the last values of those files that have events."""
    return files.join(folded, "id", "left").select(
        *[c for c in files.columns if c not in ("status", "error", "ingesting", "chunks_uploaded", "progress")],
        F.coalesce("e_status", "status").alias("status"),
        F.when(F.col("e_error").isNotNull(), F.col("e_error.e")).alias("error"),
        F.coalesce("e_ingesting", F.lit(False)).alias("ingesting"),
        F.coalesce("e_progress.chunks_uploaded", F.lit(0)).alias("chunks_uploaded"),
        F.coalesce("e_progress.progress", F.lit(0)).alias("progress"),
    )


def upload_summary(states: DataFrame) -> DataFrame:
    """Files by status: completed of total, and whether any is uploading."""
    status = F.col("status")
    return states.agg(F.count_if(status == "complete").alias("completed"), F.count(F.lit(1)).alias("total"), F.coalesce(F.bool_or(status.isin("uploading", "reading")), F.lit(False)).alias("uploading"))


def chunk_numbers(chunks: DataFrame, *order: str) -> DataFrame:
    """Numbers chunks of a file that came apart; inside one row the array position does without a shuffle."""
    per_file = Window.partitionBy("file_id")
    return chunks.withColumn("chunk_index", F.row_number().over(per_file.orderBy(*order)) - 1).withColumn("chunk_count", F.count(F.lit(1)).over(per_file))
