"""Texts of some megabytes, and empty tables, through the operators and the pipeline's stages."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from chunkmill.llm import common, exact_dedup, mixing, pii, quality, secrets, sentencepiece_nbest, simhash, token_files

SECRET, MAIL = "AKIA" + "Q7" * 9, "long.text@example.org"


@pytest.fixture(scope="module")
def long_docs(spark):
    """Two equal texts of two megabytes, their like with one word more, and a single word of a megabyte."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(4000)]
    text = " ".join(rng.choices(words, k=300_000)) + f" {SECRET} and {MAIL} end"
    rows = [(1, text, "s1"), (2, text, "s1"), (3, f"{text} more", "s2"), (4, "x" * 1_000_000, "s2"), (5, "short one", "s1")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2).cache()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_long_texts_in_copies_and_fingerprints(spark, long_docs):
    texts = {r.doc_id: r.text for r in long_docs.collect()}
    found = by_id(exact_dedup.exact_dedup(long_docs))
    assert {i: r.keep_id for i, r in found.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert all(r.text_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() for i, r in found.items())
    near = by_id(simhash.simhash_components(spark, long_docs))
    assert near[1].fingerprint == near[2].fingerprint == f"{simhash.fingerprint(texts[1].encode()):016x}" and near[2].component_id == near[3].component_id == 1


def test_long_texts_in_mix_and_scans(spark, long_docs):
    sizes = {r.doc_id: len(r.text.split()) for r in long_docs.collect()}
    assert {i: r.size for i, r in by_id(mixing.mix(spark, long_docs)).items()} == sizes
    found = by_id(secrets.secret_report(spark, long_docs))
    assert {i: r.n_access for i, r in found.items()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0}
    at = re.search(SECRET, long_docs.filter("doc_id = 1").first().text).start()
    assert f"access:{at}:{at + len(SECRET)}" in found[1].spans
    assert {i: r.n_email for i, r in by_id(pii.pii_report(spark, long_docs)).items()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0}


def test_long_texts_in_scores_and_tokens(spark, long_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id long, quality int")
    scores = by_id(quality.quality_scores(spark, long_docs, labels))
    assert len(scores) == 5 and all(0 <= r.score <= 1 for r in scores.values()) and scores[1].score == scores[2].score
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    manifest, folder = token_files.write_token_files(spark, long_docs, public_tokenizers.path("word_bpe_49k.json"))
    found = by_id(token_files.read_token_files(manifest, folder))
    for r in long_docs.collect():
        assert found[r.doc_id].n_tokens == len(library.encode(r.text, add_special_tokens=False).ids) + 1


def test_stages_on_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    none, labels = spark.createDataFrame([], schema), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = (exact_dedup.drop_copies(none), simhash.one_of_each(spark, none), mixing.mixed_documents(spark, none), quality.good_documents(spark, none, labels))
    assert all(m.columns == none.columns and m.collect() == [] for m in made)
    assert sentencepiece_nbest.encode_documents(none, public_tokenizers.path("piece_bpe_32k.model")).collect() == []
    none.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    few = spark.createDataFrame([(None, None, None, None, None), (None, "", "", "", 0), (1, "a b", "en", "s", 3)], schema)
    few.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert all(r.decoded for r in corpus_pipeline.run(spark, str(tmp_path)).collect())


def test_a_worker_keeps_one_operators_cache():
    words = quality.words_of_worker()
    assert quality.words_of_worker() is words and common.of_worker(list, "ab") == ["a", "b"]
    assert common.of_worker(list, "ab") is common.of_worker(list, "ab")
    assert quality.words_of_worker() is not words and len(common._OF_WORKER) == 1
