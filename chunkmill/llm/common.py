"""What several operators share: staged tables, texts, row keys, and columns of any name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import new_folder, stage_table

__all__ = ["SPACE_RUN", "WORD", "forget_worker", "free_names", "nested", "new_folder", "numbered", "of_worker", "one_space", "quoted", "row_hash", "row_key", "stage_table", "table", "text_of"]

#: White space of the text contracts: space and U+0009 to U+000D. A plain single space needs no replacing.
SPACE_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


_OF_WORKER: dict[tuple, Any] = {}


def of_worker(make: Callable, *args) -> Any:
    """What ``make`` gives for these arguments, kept by a Python worker from task to task until another is asked for.

    One at a time: a worker that goes on to another operator's tasks, as in a pipeline, gives up the cache of the one before, so
    that their bounds don't add up.
    """
    key = make, *args
    if key not in _OF_WORKER:
        _OF_WORKER.clear()
        _OF_WORKER[key] = make(*args)
    return _OF_WORKER[key]


def forget_worker() -> None:
    """Give up what a Python worker keeps, in tasks that have no use for it."""
    _OF_WORKER.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many ``_`` behind it as it needs to differ from the frame's columns in more than case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col(f"`{name.replace('`', '``')}`")


def numbered(df: DataFrame) -> list[Column]:
    """The columns by number, as ``mapInArrow`` takes no name with a dot."""
    return [quoted(c).alias(f"c{i}") for i, c in enumerate(df.columns)]


def nested(df: DataFrame) -> Column:
    """All columns as one, ``row``, so that no name of theirs meets an operator's own; ``row.*`` gives them back."""
    return F.struct(*[quoted(c) for c in df.columns]).alias("row")


def row_key(id_col: str, *columns: str) -> Column:
    """Identifier and digests of the columns, null apart from any value: rows of one key are alike in all of them."""
    parts = [F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), *[F.coalesce(F.md5(F.col(c).cast("string").cast("binary")), F.lit("")) for c in columns]]
    return F.concat(*[x for p in parts for x in (p, F.lit(":"))])


def row_hash(df: DataFrame) -> Column:
    """An order that depends on the rows' values alone."""
    return F.xxhash64(*[quoted(c) for c, t in df.dtypes if "map<" not in t and "variant" not in t])


def one_space(column: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(column, SPACE_RUN, " ")
