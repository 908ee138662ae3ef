"""Chunks of a batch of texts as Arrow lists, built from flat columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, islice

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cuts

FIELDS = {
    "text": "string",
    "start_idx": "int",
    "end_idx": "int",
    "token_count": "int",
    "is_table": "boolean",
    "table_format": "string",
    "table_mode": "string",
    "table_row_start": "int",
    "table_row_end": "int",
    "table_row_count": "int",
    "table_has_header": "boolean",
    "table_columns": "array<string>",
    "recursive_rule_level": "int",
    "recursive_rule_type": "string",
    "recursive_delimiter": "string",
}
METADATA = tuple(FIELDS)[4:]
#: What the router adds in front.
ROUTE = {"part": "int", "chunk_strategy": "string", "chunk_count": "int"}
CHUNK = f"struct<{','.join(f'{k}:{t}' for k, t in FIELDS.items())}>"
ROUTED = f"struct<{','.join(f'{k}:{t}' for k, t in (ROUTE | FIELDS).items())}>"
KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
ARROW = {k: KINDS[t] for k, t in (ROUTE | FIELDS).items()}


def cut_all(text: str | None, cut: Callable[[str], list[cuts.Chunk]], keep_blank: bool = False) -> list[cuts.Chunk]:
    if text is None or not (keep_blank or cuts.trim(text)):
        return []
    return cuts.in_utf16(text, cut(text))


def lists(rows: list[list[tuple]], names: tuple[str, ...]) -> pa.ListArray:
    """Per text its chunks as tuples of the named columns and, last, a dict of metadata or None; a key that no chunk of the batch has costs nothing."""
    flat = [c for row in rows for c in row]
    *columns, about = zip(*flat) if flat else [()] * (len(names) + 1)
    made = {k: pa.array(c, ARROW[k]) for k, c in zip(names, columns)}
    seen = {k for m in {id(m): m for m in about if m}.values() for k in m}
    for k in METADATA:
        made[k] = pa.array([m and m.get(k) for m in about], ARROW[k]) if k in seen else pa.nulls(len(flat), ARROW[k])
    ends = pa.array([0, *accumulate(map(len, rows))], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(list(made.values()), names=list(made)))


def texts_of(rows: pa.ListArray) -> Iterator[list[tuple[str | None, str | None]]]:
    """Per row its (kind, text), read column by column; none of a null row."""
    flat = rows.flatten()
    pairs = zip(pa.compute.struct_field(flat, "kind").to_pylist(), pa.compute.struct_field(flat, "text").to_pylist())
    return (list(islice(pairs, n or 0)) for n in pa.compute.list_value_length(rows).to_pylist())


CUT = ("text", "start_idx", "end_idx", "token_count")
#: Bytes of texts whose chunks are Python objects at once, unless one row has more.
SLICE_BYTES = 1 << 20


def sliced(rows: pa.Array) -> Iterator[pa.Array]:
    """A batch halved again and again until a part has one row or no more than ``SLICE_BYTES``."""
    if len(rows) < 2 or rows.nbytes <= SLICE_BYTES:
        yield rows
        return
    half = len(rows) // 2
    yield from sliced(rows.slice(0, half))
    yield from sliced(rows.slice(half))


def by_slices(rows: pa.Array, run: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """What ``run`` gives for the rows of a batch: chunks are Python objects for a slice at a time, and compact columns from then on."""
    return pa.concat_arrays([run(part) for part in sliced(rows)])


def chunk_column(text: Column, cut: Callable[[str], list[cuts.Chunk]], keep_blank: bool = False) -> Column:
    """Chunks of a text column by any function from a text to chunks: the pluggable chunker."""

    def run(texts: pa.Array) -> pa.Array:
        return by_slices(texts, lambda part: lists([cut_all(t, cut, keep_blank) for t in part.to_pylist()], CUT))

    return F.arrow_udf(run, f"array<{CHUNK}>")(text)
