"""From raw documents to token ids: five stages over the ``documents`` table, each on all that the one before kept.

Quality classifier (rejected documents go), exact dedup, SimHash near-dedup (one document of each group stays),
mixing of sources to target weights (a document comes as often as it was taken), SentencePiece encoding (adds the ids of the N best).
Every stage writes Parquet to the shared folder and the next one reads it, so a lost executor costs a stage's tasks
at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chunkmill.llm import exact_dedup, mixing, quality, sentencepiece_nbest, simhash
from chunkmill.llm.common import stage_table, table

#: Words that a worker keeps for the last stage: the executors' heaps are grown by then, so fewer than in a job of that stage alone.
WORDS = 1 << 16


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(spark, docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(spark, docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), with_changes=True, cache=WORDS)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SQL expresses neither the classifier nor the fingerprints; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage_table(spark, stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
