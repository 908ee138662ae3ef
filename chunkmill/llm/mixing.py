"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words; a source's target stops
at ``most`` times its size and the excess goes to the others by weight. A document's expected copies are its
source's target over its source's size; they are summed within the source, one random offset is added, and a document
is emitted once per integer boundary that its interval crosses.

The words taken come near the target wherever the offset falls, by the order of the documents. First come the large ones,
that hold more than a share of 1 in ``LARGE`` of their source, in falling order of size: after each the words that are left of
the target and of the source give the expected copies of those behind it, so that what a large document took too
much or too little is made up for by smaller ones. Then one half of the others stands in rising, the other in falling order of size, all
with the same expected copies: neighbours are of like size and both ends are small. Where all documents of a source are large,
it can miss its target by what its last ones can't make up for, as when one document holds more than the target.

The running sum needs no task per source: documents fall into blocks (large or not, half, size class, hash of identifier and text) of
about ``BLOCK_ROWS`` rows, as many as their size class has need of, each block is numbered by itself, and only the blocks'
counts are summed over a source. A source has less than ``LARGE`` large documents, by their definition; their sizes are folded in
one array. Blocks and sources meet their rows in sorted joins, on the keys that the rows are
dealt by anyway; nothing is broadcast by its number of blocks. One row per source, its sums, goes through one task,
which sorts them twice.

Nulls: a null text has size 0; documents of size 0 are sampled like others and take 0 words. A null source is
a source of its own, the last. A source without words has target 0 and is never taken. Repeated rows are rows
of their own, and rows alike in identifier and text share a block, unless their identifier is null. A very long text is
only counted. An empty table gives an empty result. The sums are exact integers; the offset depends on the
seed, the source's rank and its documents, so reruns agree (among rows without identifier: on the same files).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, nested, row_hash, row_key, stage_table, text_of

#: Rows of a block, about.
BLOCK_ROWS = 4096
#: Size classes per doubling.
CLASSES = 6
SEED = 20
#: A document is large if it holds more than this part of its source; so a source has fewer large ones than this.
LARGE = 1024
#: Above twice any size class (6 for each of 63 doublings).
LAST_PLACE = 1000
BIG = "decimal(38,0)"


def words(text_col: str = "text") -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")


def salt(id_col: str, text_col: str) -> Column:
    """What deals documents out to halves and blocks: a hash of identifier and text, and of the row where it has no identifier."""
    return F.xxhash64(F.col(id_col), F.md5(text_of(text_col).cast("binary")), F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()))


def source_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """``sizes``: source, source_size, source_rows, one row per source. Adds rank, weight and target.

    A source is capped if its share of what sources with a smaller cap per weight leave exceeds its cap; in
    the order of cap per weight those come first, so that running sums find them.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("source_rank", F.row_number().over(rank)).withColumn("weight", ((F.col("source_rank") - 1) % 3 + 1).cast("long")).withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    summed = (
        ranked.withColumn("all_words", F.sum("source_size").over(everything).cast(BIG))
        .withColumn("all_weight", F.sum("weight").over(everything).cast(BIG))
        .withColumn("left_words", F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(BIG))
        .withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)).cast(BIG))
    )
    capped = summed.withColumn("capped", F.col("left_words").cast("double") * F.col("weight") > F.col("cap") * F.col("left_weight").cast("double"))
    rest = (
        capped.withColumn("rest_words", F.col("all_words") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything).cast(BIG))
        .withColumn("rest_weight", F.col("all_weight") - F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(everything).cast(BIG))
    )
    shared = F.col("rest_words").cast("double") * F.col("weight") / F.col("rest_weight").cast("double")
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared)
    return rest.withColumn("target", target).select("source", "source_key", "source_rank", "source_size", "source_rows", "target")


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3, seed: int = SEED) -> DataFrame:
    """One row per input row: id, ``size``, ``source_size``, ``target``, ``taken`` and ``copies``."""
    return decided(spark, docs, F.lit(""), id_col, text_col, source_col, most, seed).drop("row_key")


def decided(spark: SparkSession, docs: DataFrame, row: Column, id_col: str, text_col: str, source_col: str, most: int = 3, seed: int = SEED) -> DataFrame:
    """The mix with ``row_key``, the value of ``row``, for each row."""
    sized = docs.select(F.col(id_col).alias("id"), row.alias("key"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"), salt(id_col, text_col).alias("salt"))
    source_key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    size_class = F.floor(F.log2(F.col("size") + 1) * CLASSES).cast("int")
    rising = F.pmod(F.col("salt"), F.lit(2)) == 0
    placed = sized.withColumn("source_key", source_key).withColumn("place", F.when(rising, size_class).otherwise(LAST_PLACE - size_class))
    rows = stage_table(spark, placed, "mix")
    classes = rows.groupBy("source_key", "place").agg(F.first("source").alias("source"), F.sum("size").alias("class_size"), F.count(F.lit(1)).alias("class_rows"))
    classes = stage_table(spark, classes, "mix-classes")
    sizes = classes.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("class_size").alias("source_size"), F.sum("class_rows").alias("source_rows"))
    targets = stage_table(spark, source_targets(sizes, most).select("source_key", "source_rank", "source_size", "target"), "mix-targets")
    parts = F.ceil(F.col("class_rows") / BLOCK_ROWS).alias("parts")
    told = classes.join(targets.hint("merge"), "source_key").select("source_key", "place", parts, "source_rank", "source_size", "target")
    large = F.col("size").cast(BIG) * LARGE > F.col("source_size")
    falling = F.greatest("place", LAST_PLACE - F.col("place"))
    rows = rows.drop("source").join(told.hint("merge"), ["source_key", "place"]).withColumn("large", large).withColumn("sub", F.pmod(F.shiftright("salt", 1), F.col("parts")))
    rows = stage_table(spark, rows.withColumn("place", F.when(F.col("large"), falling).otherwise(F.col("place"))).drop("parts", "salt"), "mix-rows")
    block = ["source_key", "large", "place", "sub"]
    blocks = stage_table(spark, rows.groupBy(*block).agg(F.count(F.lit(1)).alias("block_rows")), "mix-blocks")
    before = Window.partitionBy("source_key", "large").orderBy("place", "sub").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select(*block, F.coalesce(F.sum("block_rows").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy(*block).orderBy(F.when(F.col("place") < LAST_PLACE // 2, F.col("size")).otherwise(-F.col("size")), "id", "key")
    at = rows.withColumn("row", F.row_number().over(inside)).join(placed.hint("merge"), block)
    at = stage_table(spark, at.select("id", "key", "size", "source_rank", "source_size", "target", "large", (F.col("rows_before") + F.col("row")).alias("number")), "mix-numbered")
    sources = stage_table(spark, settled(at, most, seed), "mix-sources")  # its size is known to the join
    rate, start = F.col("rate"), F.col("start")
    crossed = F.floor(start + F.col("number") * rate) - F.floor(start + (F.col("number") - 1) * rate)
    copies = F.when(F.col("large"), F.get("large_copies", F.col("number").cast("int") - 1)).otherwise(F.least(crossed, F.lit(most))).cast("long")
    found = at.join(sources, "source_rank").withColumn("copies", copies)
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", F.col("key").alias("row_key"))


def settled(at: DataFrame, most: int, seed: int) -> DataFrame:
    """Per source the copies of its large documents, and the running sum ``start`` and expected copies ``rate`` of all others."""
    numbered = F.array_sort(F.collect_list(F.when(F.col("large"), F.struct("number", "size"))))
    own = at.groupBy("source_rank").agg(F.first("target").alias("target"), F.first("source_size").alias("source_size"), numbered.alias("documents"))
    offset = F.pmod(F.xxhash64(F.lit(seed), "source_rank"), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def expected(words: Column, size: Column) -> Column:
        """What is left to take over what is left, 0 at least and ``most`` at most."""
        return F.when(size > 0, F.least(F.greatest(words / size, F.lit(0.0)), F.lit(float(most)))).otherwise(0.0)

    def settle(s: Column, d: Column) -> Column:
        upto = s["upto"] + expected(s["words"], s["size"])
        copies = F.least(F.floor(upto) - F.floor(s["upto"]), F.lit(most)).cast("int")
        return F.struct(upto.alias("upto"), (s["words"] - copies * d["size"]).alias("words"), (s["size"] - d["size"]).alias("size"), F.concat(s["copies"], F.array(copies)).alias("copies"))

    none = F.struct(offset.alias("upto"), F.col("target").alias("words"), F.col("source_size").alias("size"), F.array().cast("array<int>").alias("copies"))
    folded = own.select("source_rank", F.aggregate("documents", none, settle).alias("s"))
    return folded.select("source_rank", F.col("s.copies").alias("large_copies"), F.col("s.upto").alias("start"), expected(F.col("s.words"), F.col("s.size")).alias("rate"))


def mixed_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document as often as it was taken, with its columns, whatever names those have.

    One key of the join on both sides, so that the texts are dealt out once; rows of a key are alike in identifier,
    text and source, and the n-th of them takes the n-th decision on them.
    """
    key = row_key(id_col, text_col, source_col)
    nth = Window.partitionBy("key")
    taken = decided(spark, docs, key, id_col, text_col, source_col).select(F.col("row_key").alias("key"), "copies")
    taken = taken.withColumn("nth", F.row_number().over(nth.orderBy("copies"))).filter("copies > 0")
    at = docs.select(key.alias("key"), row_hash(docs).alias("order"), nested(docs)).withColumn("doc_nth", F.row_number().over(nth.orderBy("order")))
    found = at.join(taken.withColumnRenamed("key", "taken_key"), (F.col("key") == F.col("taken_key")) & (F.col("doc_nth") - F.col("nth") == 0))
    return found.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
