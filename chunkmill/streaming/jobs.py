"""Structured Streaming twins of the batch jobs: upload assembly, ingest, upload states, model loops and chat states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import chat, chunking, uploads
from ..sources import files as source
from ..sources.collection import Collection
from ..sources.staging import stage_table
from . import processors

#: For a run to the end of what is there: state in RocksDB, and no batch without data, as with processing-time timers such batches never end.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def assemble_stream(parts: DataFrame, timeout_ms: int = 3_600_000) -> DataFrame:
    """Stream of parts to ``uploads.EVENTS``: ``chunk-received`` per part, then ``file`` with its content or ``ingest-failed``.

    When as many different parts have come as the message at hand says, or more, the upload ends and its state with it; a part
    that comes later opens a new one. An upload past the size limit fails, and so does one that gets no part for ``timeout_ms``.
    """
    data = F.coalesce(F.try_to_binary("data", F.lit("base64")), F.lit(b""))
    own = parts.select("file_id", "file_name", F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index"), F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"), data.alias("bytes"), "seq")
    return own.groupBy("file_id").transformWithState(processors.Assembly(timeout_ms), uploads.EVENTS, "append", "processingTime")


def part_event_stream(parts: DataFrame, max_iterations: int = chat.MAX_ITERATIONS) -> DataFrame:
    """Stream of model parts to chat events, as ``chat.part_events``."""
    return parts.groupBy("session_id").transformWithState(processors.ModelLoop(max_iterations), chat.EVENTS, "append", "none")


def chat_changes(events: DataFrame) -> DataFrame:
    """Stream of chat events to ``processors.CHANGES``: what each batch changes in a session's state. ``chat_states`` makes states of them."""
    return events.groupBy("session_id").transformWithState(processors.ChatSession(), processors.CHANGES, "update", "none")


def chat_states(changes: DataFrame) -> DataFrame:
    """Changes to the columns of the batch fold: of each session the last head, and of each place the last segment of its epoch."""
    last = changes.groupBy("session_id", "pos").agg(F.max_by(F.struct("epoch", "told"), "changed").alias("c"))
    scalars = ", ".join(f for f in chat.STATE.split(", ")[1:] if not f.startswith("segments"))
    heads = last.filter("pos IS NULL").select("session_id", F.col("c.epoch").alias("epoch"), F.from_json("c.told", scalars).alias("s"))
    own = last.filter("pos IS NOT NULL").select("session_id", F.col("c.epoch").alias("epoch"), "pos", F.from_json("c.told", chat.SEGMENT).alias("segment"))
    ordered = own.groupBy("session_id", "epoch").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "segment"))), lambda x: x["segment"]).alias("segments"))
    out = heads.join(ordered, ["session_id", "epoch"], "left")
    segments = F.coalesce("segments", F.array().cast(f"array<{chat.SEGMENT}>"))
    return out.select("session_id", *[segments.alias(f) if f == "segments" else F.col(f"s.{f}") for f in chat.STATE_FIELDS])


def upload_state_stream(files: DataFrame, events: DataFrame) -> DataFrame:
    """Stream of upload events to the last values of known files, in update mode, by the aggregates of the batch fold; ``uploads.states_of`` puts them over the initial states."""
    known = files.select("id")
    return events.join(known, "id").groupBy("id").agg(*uploads.folded_states())


def run_until_done(stream: DataFrame, folder: str, mode: str = "update") -> DataFrame:
    """Run a stream over all that its source has now, batch after batch, and read back the rows, with ``batch``. Run again on the same folder it goes on where it stood."""

    def write(rows: DataFrame, n: int) -> None:
        rows.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/rows/n={n}")

    run_batches(stream, folder, write, mode)
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    return stream.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")


def run_batches(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Hand a stream's batches to ``write`` until its source has no more; state lies in RocksDB, progress in the folder."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def ingest(collection: Collection, embed: Callable[[DataFrame], DataFrame], folder: str, name: str = "uploads", router: chunking.Router = chunking.Router(), batch: int = uploads.BATCH) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` on the assembled stream: chunk the files, embed, upsert, and write the ingest events to ``folder``.

    Exactly once: the collection's version holds the number of the stream's last batch, written together with the records, so a
    batch that is run again after a failure finds its number there and leaves the collection alone; its events go to
    a place of their own by its number and replace what the first run may have left.
    """

    def run(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        assembled = stage_table(spark, rows.filter("event <> 'chunk-received'"), "assembled")
        texts = source.extract_text(assembled.filter("event = 'file'").select("file_id", "file_name", "content"))
        chunks = chunking.chunk_documents(texts.filter("error IS NULL").select("file_id", "file_name", "text"), router)
        records = stage_table(spark, embed(chunking.ingest_records(chunks).withColumnRenamed("text", "document")), "ingest")
        collection.upsert(records, source=name, batch=n)
        counted = records.groupBy("file_id").agg(F.max("chunk_count").alias("chunks"))
        known = texts.select("file_id", "error").unionByName(assembled.filter("event = 'ingest-failed'").select("file_id", "error"))
        uploads.ingest_events(known.join(counted, "file_id", "left"), batch).write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return run
