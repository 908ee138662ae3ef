"""Files as rows: reading documents, cutting files into upload parts, reading parts and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

PART_SCHEMA = "file_id string, file_name string, chunk_index int, total_chunks int, data string, seq long"
INGEST_EVENT_SCHEMA = "_tag string, id string, chunk_index int, processed int, total int, message string, seq long"
CHAT_EVENT_SCHEMA = (
    "session_id string, seq long, _tag string, delta string, message string, iteration int, id string, name string, arguments_delta string, arguments string, "
    "result string, success boolean, finish_reason string, prompt_tokens long, completion_tokens long, total_tokens long, recoverable boolean"
)
TEXT_EXTENSIONS = (".txt", ".md", ".csv")


def extract_text(files: DataFrame) -> DataFrame:
    """``files``: file_name, content (bytes). Adds text and error: unsupported types keep their row."""
    ext = T.file_extension(F.col("file_name"))
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\\uFEFF", "")
    readable = ext.isin(*TEXT_EXTENSIONS)
    return files.withColumn("text", F.when(readable, text)).withColumn("error", F.when(~readable, F.concat(F.lit("Unsupported file type: "), "file_name"))).drop("content")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """All files below a path: file_name, text, error."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return extract_text(raw.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content"))


def validate_files(files: DataFrame) -> DataFrame:
    """``files``: id, name, size, type. Adds reject_reason: size first, then neither an accepted type nor extension (with or without a dot)."""
    last = F.lower(F.substring_index("name", ".", -1))
    accepted = F.col("type").isin(*T.MIME_TYPES.values()) | F.concat(F.lit("."), last).isin(*T.MIME_TYPES)
    reason = F.when(F.col("size") > T.MAX_FILE_BYTES, F.concat("name", F.lit(": exceeds 100MB limit"))).when(~F.coalesce(accepted, F.lit(False)), F.concat("name", F.lit(": unsupported file type")))
    return files.withColumn("reject_reason", reason)


def upload_parts(files: DataFrame, part_bytes: int = T.PART_BYTES) -> DataFrame:
    """``files``: file_id, file_name, content. Base64 parts of ``part_bytes``; an empty file has none."""
    n = F.ceil(F.octet_length("content") / part_bytes).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = files.withColumn("total_chunks", n).select("file_id", "file_name", "total_chunks", "content", F.explode(numbers).alias("chunk_index"))
    piece: Column = F.substr(F.col("content"), F.col("chunk_index") * part_bytes + 1, F.lit(part_bytes))
    return rows.select("file_id", "file_name", "chunk_index", "total_chunks", F.base64(piece).alias("data"))


def read_parts(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Upload parts from JSON lines, as a batch or a stream."""
    return (spark.readStream if stream else spark.read).schema(PART_SCHEMA).json(path)


def read_events(spark: SparkSession, path: str, kind: str = "chat", stream: bool = False) -> DataFrame:
    """Chat or ingest events from JSON lines: one wide schema, ``_tag`` says which columns are set."""
    schema = {"chat": CHAT_EVENT_SCHEMA, "ingest": INGEST_EVENT_SCHEMA}[kind]
    return (spark.readStream if stream else spark.read).schema(schema).json(path)


def write_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)
