"""Open metadata of chunks and records: maps from names to text, of which later ones win, carried through collections and hits.

Known fields stay columns of their type; ``extra`` is a map column for whatever else a caller or a chunker of its own attaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunk_lists

MAP = "map<string,string>"
#: The chunker's own keys by column, and those that an ingest puts over all others.
CHUNK_KEYS = {c: c.split("_")[0] + "".join(p.title() for p in c.split("_")[1:]) for c in chunk_lists.METADATA}
BASE_KEYS = {"source_file": "sourceFile", "file_ext": "fileExt", "chunk_strategy": "chunkStrategy", "chunk_char_start": "chunkCharStart", "chunk_char_end": "chunkCharEnd", "chunk_token_count": "chunkTokenCount"}
PAGE_KEYS = {"page_number": "pageNumber", "page_count": "pageCount"}
INGEST_KEYS = {"file_id": "fileId", "file_name": "fileName", "mime_type": "mimeType", "chunk_index": "chunkIndex", "total_chunks": "totalChunks"}


def merged(*maps: Column) -> Column:
    """One map of several, null ones left out; of equal keys the last map's value stays."""
    out = F.coalesce(maps[0], F.create_map().cast(MAP))
    for m in maps[1:]:
        own = F.coalesce(m, F.create_map().cast(MAP))
        # Each side is bound once: an expression inside a lambda would be computed at every key.
        pair = F.array(F.struct(out.alias("old"), own.alias("new")))
        joined = F.transform(pair, lambda p: F.map_concat(F.map_filter(p["old"], lambda k, _: ~F.array_contains(F.map_keys(p["new"]), k)), p["new"]))
        out = F.element_at(joined, 1)
    return out


def told(column: Column, kind: str) -> Column:
    return F.to_json(column) if kind.startswith("array") else column.cast("string")


def keyed(df: DataFrame, keys: dict[str, str]) -> Column:
    """The columns that are there as a map under their keys, null ones left out."""
    kinds = dict(df.dtypes)
    entries = [F.struct(F.lit(key).alias("key"), told(F.col(c), kinds[c]).alias("value")) for c, key in keys.items() if c in kinds]
    if not entries:
        return F.create_map().cast(MAP)
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def with_metadata(chunks: DataFrame, extra: str = "extra", out: str = "metadata") -> DataFrame:
    """Adds the metadata of each chunk as a map: base fields, then the chunker's own, then ``extra`` (if there), then pages, and the ingest's over all."""
    free = [F.col(extra).cast(MAP)] if extra in chunks.columns else []
    return chunks.withColumn(out, merged(keyed(chunks, BASE_KEYS), keyed(chunks, CHUNK_KEYS), *free, keyed(chunks, PAGE_KEYS), keyed(chunks, INGEST_KEYS)))


def where(key: str, value: str | None, column: str = "metadata") -> Column:
    """Metadata predicate: the key's value is the text; without text, the key is there."""
    found = F.try_element_at(column, F.lit(key))
    return F.coalesce(found == value, F.lit(False)) if value is not None else F.coalesce(F.array_contains(F.map_keys(column), key), F.lit(False))


def where_contains(key: str, wanted: str | None, column: str = "metadata") -> Column:
    """The key's value contains a text; no or empty text means no filter."""
    return F.coalesce(F.contains(F.try_element_at(column, F.lit(key)), F.lit(wanted)), F.lit(False)) if wanted else F.lit(True)
