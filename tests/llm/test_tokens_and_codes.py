"""Token counts, alignments and vector codes against the libraries and brute force."""

import hashlib
import random
from collections import Counter as Bag

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chunkmill.llm import alignment, token_counts, vector_codes
from chunkmill.llm.queries import op11_token_counts, op12_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", " 're", "'ll", "'l", "'", "!'", "1", "23", "é", "ß", "՘", "½", "　", "\xa0", "\x1c", "\x85", "<|endoftext|>", "<|endof", "<s>", "\U0001f600", "漢字", "Th", "ab" * 40, "aaaaaaa", "\x00", "\r\n", "▁"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def library_a():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(A)


@pytest.fixture(scope="module")
def library_b():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=B)


def sizes(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_prefix_against_the_library(library_a):
    counter = token_counts.Counter(A)
    for text in odd_texts(400, 1):
        assert counter.prefixes(text).tolist() == sizes(library_a, [text[:i] for i in range(len(text) + 1)]), text


def test_prefixes_don_t_depend_on_what_is_cached(library_a, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 3)
    monkeypatch.setattr(token_counts, "BORDERS", 2)
    counter = token_counts.Counter(A)
    texts = odd_texts(150, 2)
    for text in texts + texts:
        assert counter.prefixes(text).tolist() == sizes(library_a, [text[:i] for i in range(len(text) + 1)])
    counter.learn_texts(texts)
    assert len(counter.known) <= 3 and len(counter.pieces) <= 3


def test_long_texts_and_words(library_a):
    counter = token_counts.Counter(A)
    for text in ("word " * 50_000, "x" * 30_000, "é" * 5000 + " " * 3000 + "\n" * 70):
        found = counter.prefixes(text)
        assert len(found) == len(text) + 1
        at = [0, 1, len(text) // 3, len(text) - 1, len(text)]
        assert found[at].tolist() == sizes(library_a, [text[:i] for i in at])


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError):
        alignment.Aligner(public_tokenizers.path("word_bpe_49k.json"), B)


def test_counts_on_odd_tables(spark, odd_docs, no_docs, library_a):
    rows = token_counts.prefix_counts(odd_docs, A, budgets=[5, 0, -1]).withColumns({"n": token_counts.tokens_of("prefix_tokens"), "first": token_counts.tokens_of("prefix_tokens", 3), "kept": token_counts.chars_within("prefix_tokens", 5)})
    rows = rows.collect()
    assert len(rows) == odd_docs.count() and set(odd_docs.columns) < set(rows[0].asDict())
    for r in rows:
        text = r.text or ""
        assert r.n == sizes(library_a, [text])[0] and len(r.prefix_tokens) == len(text) + 1
        assert r.first == (sizes(library_a, [text[:3]])[0] if len(text) >= 3 else None)
        assert r.kept == r.budget_chars[0] == max(i for i, n in enumerate(r.prefix_tokens) if n <= 5)
        assert r.budget_chars[1] == max(i for i, n in enumerate(r.prefix_tokens) if n <= 0) and r.budget_chars[2] == -1
    assert token_counts.token_counts(no_docs, A).collect() == []
    clash = token_counts.prefix_counts(spark.createDataFrame([("a b", 1, 2)], "text string, prefix_tokens int, `x.y` int"), A).first()
    assert clash.prefix_tokens == 1 and clash.prefix_tokens_ == [0, 1, 2, 2] and clash["x.y"] == 2


def test_op11_on_a_table(spark, library_a):
    found = {r.doc_id: r for r in op11_token_counts(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        r, n = found[d.doc_id], sizes(library_a, [d.text or ""])[0]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((d.text or "").encode()), n, n > 1024)
        assert (r.limit_chars < len(d.text or "")) == r.over_limit
        if r.over_limit:
            assert sizes(library_a, [d.text[: r.limit_chars]])[0] <= 1024 < sizes(library_a, [d.text[: r.limit_chars + 1]])[0]


def ends_of(parts):
    out, n = [], 0
    for p in parts:
        n += len(p)
        out.append(n)
    return out


def brute_alignment(aligner, library_b, text):
    """(A ids, B ids, groups, links) from whole-text encoding; None for a text without tokens."""
    if not text:
        return None
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, library_b.encode(text)
    parts_a, parts_b = [aligner.bytes_a[i] for i in a], [aligner.bytes_b[i] for i in b]
    if not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
        return None
    at_a, at_b = ({x: i for i, x in enumerate(ends_of(p))} for p in (parts_a, parts_b))
    groups, links, i, j = [], [], 0, 0
    for x in sorted(set(at_a) & set(at_b)):
        groups.append(",".join(map(str, a[i : at_a[x] + 1])) + "|" + ",".join(map(str, b[j : at_b[x] + 1])))
        links.append((a[at_a[x]], b[at_b[x]]))
        i, j = at_a[x] + 1, at_b[x] + 1
    return a, b, ";".join(groups), links


def test_cuts_are_all_shared_ends():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = (sorted({*rng.choices(range(1, 40), k=rng.randint(1, 30)), 40}) for _ in range(2))
        assert alignment.shared_cuts(a, b) == [(a.index(c) + 1, b.index(c) + 1) for c in sorted({*a} & {*b})]
    n = 200_000  # cuts at one side only: no deep recursion, no quadratic time
    assert len(alignment.shared_cuts(list(range(1, n + 1)), [*range(1, 1000), n])) == 1000


def test_groups_against_whole_texts(library_b):
    aligner = alignment.Aligner(A, B)
    texts = [*odd_texts(500, 4), "x" * 20_000, "Wo rd\xa0" * 3000]
    for text, found in zip(texts, aligner.texts(texts)):
        want = brute_alignment(aligner, library_b, text)
        assert (found and (found[0], found[1], found[2].decode())) == (want and (len(want[0]), len(want[1]), want[2])), text
        if want:
            pairs = aligner.pairs[np.frombuffer(found[3], "<i4")]
            assert [(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in pairs] == want[3]


def check_report(rows, texts, library_b):
    aligner = alignment.Aligner(A, B)
    want = [(i, brute_alignment(aligner, library_b, t)) for i, t in texts]
    count = Bag(link for _, w in want if w for link in w[3])
    most = Bag()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    told = []
    for i, w in want:
        a, b, groups, links = w or ([], [], "", [])
        told.append((i, len(a), len(b), len(links), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    key = lambda r: (r[0] is None, r)
    assert sorted([tuple(r) for r in rows], key=str) == sorted(told, key=str), key


def test_op12_on_a_table(spark, library_b):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    check_report(op12_alignment(spark, "/root/testdata/sf0.001").collect(), [(d.doc_id, d.text) for d in docs], library_b)


def test_alignment_on_odd_tables(spark, odd_docs, no_docs, library_b):
    check_report(alignment.alignment_report(spark, odd_docs, A, B).collect(), [(d.doc_id, d.text) for d in odd_docs.collect()], library_b)
    assert alignment.alignment_report(spark, no_docs, A, B).collect() == []
    row = alignment.align_documents(spark.createDataFrame([("a▁b", 1), ("one two", 2)], "text string, links int"), A, B).orderBy("links").collect()
    assert row[0].n_a == 0 and row[0].groups == "" and row[1].groups.count(";") == 1 and len(row[1].links_) == 2


def brute_codes(vectors, parts=8, entries=16, rounds=6):
    """(codes, errors, codebooks) with Python's integers; vectors in order of their identifiers."""
    x = [[int(np.floor(4096 * float(v))) for v in row] for row in vectors]
    w = len(x[0]) // parts
    cut = [[row[p * w : (p + 1) * w] for row in x] for p in range(parts)]
    books = [[list(v) for v in cut[p][:entries]] for p in range(parts)]
    distance = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    for r in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (distance(v, books[p][e]), e)) for v in cut[p]] for p in range(parts)]
        if r == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v for v, c in zip(cut[p], codes[p]) if c == e]
                if own:
                    books[p][e] = [sum(v[i] for v in own) // len(own) for i in range(w)]
    errors = [sum(distance(cut[p][n], books[p][codes[p][n]]) for p in range(parts)) for n in range(len(x))]
    return ["".join(f"{codes[p][n]:02x}" for p in range(parts)) for n in range(len(x))], errors, hashlib.sha256(",".join(str(i) for b in books for e in b for i in e).encode()).hexdigest()


def coded(spark, rows, kind="double"):
    return vector_codes.vector_codes(spark, spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, code string"))


@pytest.mark.parametrize("scale", [0.1, 1e4, 3e6, 1e11])
def test_codes_against_integers_of_any_size(spark, scale):
    v = (np.random.default_rng(5).normal(size=(150, 24)) * scale).round(6)
    v[20] = v[3]  # a tie
    found = {r.vec_id: r for r in coded(spark, [(i, row, i % 3 or None, "x") for i, row in enumerate(v.tolist())]).collect()}
    codes, errors, digest = brute_codes(v)
    errors = [min(e, 2**63 - 1) for e in errors]
    assert [found[i].code for i in range(150)] == codes and [found[i].error for i in range(150)] == errors
    assert {r.codebooks_sha256 for r in found.values()} == {digest}
    assert all(found[i].label_error == min(sum(e for j, e in enumerate(errors) if j % 3 == i % 3), 2**63 - 1) for i in range(150))


def test_limbs_and_dots_are_exact():
    rng = np.random.default_rng(6)
    for bits in (3, 20, 26, 29):
        x, c = rng.integers(-(1 << bits), 1 << bits, (40, 16)), rng.integers(-(1 << bits), 1 << bits, (16, 16))
        assert (vector_codes.dots(x, c) == x @ c.T).all()
        assert (sum(part.astype(np.int64) << (7 * i) for i, part in enumerate(vector_codes.limbs(x, 7))) == x).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0] * 8, 1, "a"), (1, [2.0] * 8, 1, "b"), (None, [3.0] * 8, None, "c"), (2, None, 1, "d"), (3, [nan] * 8, 1, "e"), (4, [inf] + [0.0] * 7, 1, "f"), (5, [None] * 8, 1, "g"), (6, [1.0], None, "h"), (7, [], 2, "i"), (1, [1.0] * 8, 1, "a")]
    found = coded(spark, rows, "float").collect()
    assert sorted(str(r.vec_id) for r in found) == ["1", "1", "1", "6", "7", "None"]
    assert all(r.error == 0 and r.label_error == 0 for r in found) and len({r.codebooks_sha256 for r in found}) == 1
    by_id = {r.vec_id: r.code for r in found}
    assert by_id[6] == "00" + by_id[7][2:] and by_id[7] == "04" + "03" * 7  # one component, then zeros, as the empty vector
    assert coded(spark, [(2, None, 1, "d")]).collect() == [] and coded(spark, []).collect() == []
    with pytest.raises(Exception, match="2\\^50"):
        coded(spark, [(1, [1e300] * 8, 1, "a")]).collect()


def test_codes_keep_other_columns(spark):
    rows = spark.createDataFrame([(i, [float(i)] * 8, 1, "x") for i in range(20)], "vec_id long, embedding array<double>, error int, code string")
    books, width = vector_codes.fit(spark, rows, "vec_id", "embedding")
    made = vector_codes.assign_codes(rows, books, width).select("vec_id", "error", "code", F.col("code_").alias("own"), "error_").collect()
    assert len(made) == 20 and all(r.error == 1 and r.code == "x" and len(r.own) == 16 for r in made)
