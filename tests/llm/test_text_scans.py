"""Secrets, token files and quality against brute force."""

import hashlib
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chunkmill.llm import quality, secrets, token_files
from chunkmill.llm.trigrams import trigram_query


def key(row):
    return tuple((x is not None, x) for x in row)


def base_secrets(text):
    found = []
    for m in re.finditer(r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def added_secrets(text):
    found = []
    for k, (p, n) in enumerate(((r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1), (r"gh[opsu]_[A-Za-z0-9]+", 40), (r"xox[abprs]-[A-Za-z0-9-]+", 24), (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 1)), 3):
        found += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m[0]) >= n]
    return found


def secrets_row(doc_id, text):
    text, names = text or "", ["assign", "access", "hex", "private_key", "hub_token", "chat_token", "web_token"]
    base = base_secrets(text)
    written = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
    return (doc_id, *[sum(s[1] == k for s in base) for k in range(3)], hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + added_secrets(text))))


def test_secrets_match_brute_force(spark, odd_docs, sample, no_docs):
    for docs in (odd_docs, sample):
        want = sorted((secrets_row(r.doc_id, r.text) for r in docs.collect()), key=key)
        assert sorted(map(tuple, secrets.secret_report(spark, docs).collect()), key=key) == want
    assert secrets.secret_report(spark, no_docs).collect() == []


def test_many_secrets_in_one_text(spark):
    text = "\U0001f600 token=abcdefg " * 1500
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert tuple(secrets.secret_report(spark, docs).first()) == secrets_row(1, text)


def test_trigram_queries():
    assert trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert trigram_query("[0-9a-f]{24,}") is None
    assert trigram_query("(foo)+bar|ab") is None
    assert trigram_query("(abc|de*)xyz") == [frozenset({"xyz"})]
    for text in ("api_key", "APIKEY", "passwd", "tokens"):
        query = trigram_query(secrets.RULES[0].pattern)
        assert any(all(t in text.lower() for t in need) for need in query)


def test_token_files_hold_the_tokenizers_ids(spark, odd_docs, sample, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for docs in (odd_docs, sample):
        manifest, folder = token_files.write_token_files(spark, docs, path)
        found = token_files.read_token_files(manifest, folder).collect()
        rows = sorted(((r.doc_id is not None, r.doc_id, (r.text or "")) for r in docs.collect()))
        want, at = [], 0
        for has, doc_id, text in rows:
            ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
            want.append((doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
            at += len(ids)
        assert sorted(map(tuple, found), key=lambda r: r[1]) == want
    manifest, folder = token_files.write_token_files(spark, no_docs, path)
    assert token_files.read_token_files(manifest, folder).collect() == []


def test_words_encode_by_themselves():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), token_files.Encoder(path)
    for text in ("Don't <|endoftext|>x <|startoftext|> 12́ Å Å b c İI ΣΣ", "e ́x ᄀ ᅡ", "a\x1cb\x85c d", "'s 't'll 123 +-*/ \U0001f600\U0001f3fd"):
        assert np.frombuffer(encoder.encode(text.encode()), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_by_themselves_only_where_that_is_right():
    words, other = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.words_stand_alone(words) and not token_files.words_stand_alone(other)


def test_another_tokenizer_and_many_repeated_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(None if i % 2 else 4, ("Same text", "an other  one", None)[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    manifest, folder = token_files.write_token_files(spark, docs, path)
    found = sorted(map(tuple, token_files.read_token_files(manifest, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None] * 150 + [4] * 150
    assert [r[1] for r in found] == [sum(r[2] for r in found[:i]) for i in range(300)]
    crc = lambda text: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) if (ids := [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]) else 0
    assert sorted(r[3] for r in found) == sorted(crc(t) for _, t in rows)


def test_long_words_are_not_kept():
    encoder, words = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json")), quality.Words()
    bodies = [(f"a{i} " + chr(97 + i % 26) * 100_000 + " b").encode() for i in range(40)]
    for body in bodies + bodies[:3]:
        assert encoder.encode(body) == encoder.whole(body)
        own = words.numbers(body)
        assert [tuple(words.keys[n]) for n in own] == [quality.features(w) for w in body.split()]
    assert max(map(len, encoder.known)) <= token_files.SHORT and max(map(len, words.number)) <= quality.SHORT
    assert sum(map(len, encoder.known)) < 10_000 and words.used >= len(words.number)


def test_the_least_identifier_in_token_files(spark):
    rows = spark.createDataFrame([(None, "a"), (-(2**63), "b c"), (None, "d"), (0, "e")], "doc_id long, text string")
    manifest, folder = token_files.write_token_files(spark, rows, public_tokenizers.path("word_bpe_49k.json"))
    found = token_files.read_token_files(manifest, folder).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in found] == [(None, 2), (None, 2), (-(2**63), 3), (0, 2)]


def test_quality_on_the_held_out_fold(spark, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality_scores(spark, docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality.quality_scores(spark, no_docs, labels).collect() == []


def test_quality_of_odd_texts(spark, odd_docs):
    labels = spark.createDataFrame([(0, 1), (5, 0), (6, None), (9, 1), (9, 0)], "doc_id long, quality int")
    found = quality.quality_scores(spark, odd_docs, labels).collect()
    assert len(found) == odd_docs.count() and all(0 <= r.score <= 1 for r in found)
    none = quality.quality_scores(spark, odd_docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.good_documents(spark, odd_docs, labels.limit(0)).count() == odd_docs.count()


def test_quality_learns_from_whole_texts(spark):
    same = " ".join(f"word{i % 40}" for i in range(320))
    rows = [(i, same + (" zq" if i % 2 else " kind") * 200, i % 2) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - bad) for i, _, bad in rows], "doc_id long, quality int")
    found = quality.quality_scores(spark, docs, labels).collect()
    assert all(r.predicted == 1 - r.doc_id % 2 for r in found) and any(r.held_out for r in found)


def brute_vectors(texts):
    """Bucket vectors by plain loops."""
    index, sums = quality.index_vectors(), np.zeros((quality.BUCKETS + 1, quality.DIMENSIONS))
    for t in texts:
        known = [[k for k in quality.features(w) if k != quality.NONE] for w in t.split()]
        for i, own in enumerate(known):
            for j in range(max(i - quality.WINDOW, 0), min(i + quality.WINDOW + 1, len(known))):
                for f in own if i != j else ():
                    for k in known[j]:
                        sums[f] += index[k]
    return quality.whole_vectors(sums), sums


def brute_pooled(text, vectors):
    words = text.split()
    if not words:
        return np.zeros(2 * quality.DIMENSIONS + 3)

    def of(w):
        own = [k for k in quality.features(w) if k != quality.NONE]
        return sum(vectors[k].astype(int) for k in own) * (6 // len(own))

    total, distinct = sum(map(of, words)), sum(map(of, set(words)))
    again = sum(a == b for a, b in zip(words, words[1:]))
    return np.concatenate([total / len(words) / quality.SCALE, distinct / len(set(words)) / quality.SCALE, [len(set(words)) / len(words), again / len(words), 1]])


TEXTS = [b"a b C, d a b x9 d C, a a e f g h a b i j k l", b"one", b"", b"... ***", "Größe größe 12,5 (TITLE) e-mail".encode(), b"w " * 40 + b"v"]


@pytest.mark.parametrize("chunk", [3, 7, 1 << 16])
def test_vectors_and_pools_against_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(quality, "CHUNK", chunk)
    contexts = quality.Contexts(quality.Words())
    contexts.add(TEXTS[:2])
    contexts.add(TEXTS[2:])
    vectors, sums = brute_vectors(TEXTS)
    assert (contexts.sums[: quality.NONE] == sums[: quality.NONE]).all() and sums.any()
    pools = quality.Pools(quality.Words(), vectors)
    assert np.allclose(pools.pooled(TEXTS), [brute_pooled(t, vectors) for t in TEXTS], atol=1e-12)
    assert pools.pooled([]).shape == (0, 2 * quality.DIMENSIONS + 3)


def test_scores_against_brute_force(spark, sample):
    """Scores from the model's network by plain loops over plainly pooled texts."""
    docs = sample.limit(120)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model, rows = quality.fit(spark, docs, labels), docs.collect()
    vectors, _ = brute_vectors([(r.text or "").encode() for r in rows])
    assert (model["vectors"][: quality.NONE] == vectors[: quality.NONE]).all()
    found = {r.doc_id: r.score for r in quality.quality_scores(spark, docs, labels).collect()}
    for r in rows:
        z = np.clip((brute_pooled((r.text or "").encode(), vectors) - model["mean"]) / model["scale"], -quality.CLIP, quality.CLIP)
        hidden = [np.tanh(sum(z[i] * model["a"][i, j] for i in range(len(z))) + model["b"][j]) for j in range(quality.HIDDEN)]
        logit = (sum(h * c for h, c in zip(hidden, model["c"])) + model["d"][0]) / model["t"][0]
        assert abs(found[r.doc_id] - 1 / (1 + np.exp(-logit))) < 1e-6


def test_few_labels_and_clashing_names(spark):
    docs = spark.createDataFrame([(i, f"text {i}", i, i) for i in range(12)], "doc_id long, text string, `a.b` int, score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    assert quality.fit(spark, docs, labels)["t"] == [1.0]
    kept = quality.good_documents(spark, docs, labels)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}
