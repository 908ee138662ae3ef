"""Nearest neighbours, chat windows and SentencePiece against brute force or exact round trips."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from chunkmill.llm import ann, chat_windows, sentencepiece_nbest
from chunkmill.llm.queries import op6_chat_format


def brute(ids, vectors, every=100, k=10):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((vectors - vectors[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def embedded(spark, v, kind="double"):
    return spark.createDataFrame(list(enumerate(v.tolist())), f"vec_id long, embedding array<{kind}>")


def by_query(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


def test_recall_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = rows.toPandas()
    want = brute(data.vec_id.to_numpy(), np.array(data.embedding.tolist(), float))
    found = by_query(ann.nearest(spark, rows).collect())
    assert found.keys() == want.keys() and all(len(v) == 10 for v in found.values())
    recall = np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9
    for q, hits in found.items():
        exact = dict(want[q])
        assert all(abs(s - exact[i]) < 1e-12 for i, s in hits if i in exact) and hits == sorted(hits, key=lambda x: (x[1], x[0]))


@pytest.mark.parametrize("clusters", [0, 100])
def test_recall_of_200_queries_in_20_000_vectors(spark, clusters):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(20_000, 32)) + (rng.normal(size=(clusters, 32)) * 4)[rng.integers(0, clusters, 20_000)] if clusters else rng.normal(size=(20_000, 32))
    v = v.astype(np.float32)
    rows = embedded(spark, v, "float")
    found, want = by_query(ann.nearest(spark, rows).collect()), brute(np.arange(20_000), v.astype(float))
    assert len(want) == 200 and all(len(x) == 10 for x in found.values())
    assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_exact_mode_and_long_near_vectors(spark):
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(size=(1500, 12)), 1e7 + rng.normal(size=(300, 12)) * 1e-2])
    rows = embedded(spark, v)
    found, want = by_query(ann.nearest(spark, rows, probed=1.0, epsilon=None).collect()), brute(np.arange(1800), v)
    assert {q: [i for i, _ in x] for q, x in found.items()} == {q: [i for i, _ in x] for q, x in want.items()}


@pytest.mark.parametrize("n", [12, 60])
def test_small_tables_are_searched_whole(spark, n):
    v = np.random.default_rng(n).normal(size=(n, 6))
    rows = embedded(spark, v)
    assert by_query(ann.nearest(spark, rows, every=3).collect()) == brute(np.arange(n), v, every=3)


def test_few_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 4.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, key string")
    found = by_query(ann.nearest(spark, docs).collect())
    ids, v = np.array([0, 100, 1, 2]), np.array([[1, 0], [1, 0], [0, 1], [3, 4.0]])
    assert found == brute(ids, v)
    assert ann.nearest(spark, docs.filter("vec_id > 2 AND vec_id < 8")).collect() == []


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(900, 8)).astype(np.float32)
    v[::2] = v[0]
    ids = rng.permutation(900)
    docs = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<float>")
    assert by_query(ann.nearest(spark, docs, probed=1.0).collect()).keys() == {i for i in range(0, 900, 100)}
    found, want = by_query(ann.nearest(spark, docs, probed=1.0).collect()), brute(ids, v.astype(float))
    recall = np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert recall > 0.95
    same = [q for q in want if want[q][9][1] == 0]
    assert same and all(found[q] == want[q] for q in same)


def conversation_digests(rows):
    out = {}
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest())), key=lambda r: r[0]):
        group = list(group)
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in group)
        loss = "".join(r[3] or "" for r in group if r[2] == "assistant")
        out[conv] = (len(group), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check_windows(made):
    """Budget, system turn and history of every window."""
    cost = lambda t: len(t.split()) + chat_windows.TURN_COST
    for _, group in itertools.groupby(sorted(made, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.window)), key=lambda r: r.conv_id):
        told, system = [], None
        for r in group:
            turns = chat_windows.read_window(r.formatted)
            repeated, own = turns[: r.repeated], turns[r.repeated :]
            assert own and r.tokens == sum(cost(t) for _, t in turns)
            past = [t for i, t in enumerate(told) if i != system]
            if system is not None:
                role, text = repeated[0]  # whole, or its first words if it is longer than its share
                assert role == "system" and told[system][1].startswith(text) and cost(text) == min(cost(told[system][1]), chat_windows.SYSTEM_SHARE)
                assert text == told[system][1] or cost(text) == chat_windows.SYSTEM_SHARE
                repeated = repeated[1:]
            assert repeated == past[len(past) - len(repeated) :] and len(repeated) <= chat_windows.HISTORY
            kept = min(cost(told[system][1]), chat_windows.SYSTEM_SHARE) if system is not None else 0
            long = max(cost(t) for _, t in own) > (chat_windows.BUDGET - kept) // 2
            assert r.tokens <= chat_windows.BUDGET or long and not repeated
            told += own
            if system is None:
                system = next((i for i, (role, _) in enumerate(told) if role == "system"), None)


def test_windows_hold_the_budget(spark):
    rng = random.Random(7)
    rows = [(c, t, "system" if t == c % 3 and c < 5 else rng.choice(["user", "assistant"]), "w " * rng.choice([1, 30, 200, 250])) for c in range(8) for t in range(60)]
    rows += [(20, 0, "system", "s " * 900), (20, 1, "user", "u " * 300), (20, 2, "assistant", "a " * 40), (21, None, "user", "x"), (21, None, "user", "y " * 600)]
    rows += [(30, 1, "assistant", f"tie {i}") for i in range(500)]
    made = chat_windows.chat_windows(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    check_windows(made)
    for conv in {r[0] for r in rows}:
        told = [t for r in sorted((r for r in made if r.conv_id == conv), key=lambda r: r.window) for t in chat_windows.read_window(r.formatted)[r.repeated :]]
        assert len(told) == sum(r[0] == conv for r in rows)
        assert sum(len(r.formatted) for r in made if r.conv_id == conv) == sum(len("### : </turn>\n ") + len(role) + len(text) for r in made if r.conv_id == conv for role, text in chat_windows.read_window(r.formatted))


def test_a_long_system_turn_does_not_grow_every_window(spark):
    rows = [(1, 0, "system", "s " * 20_000)] + [(1, t, "user" if t % 2 else "assistant", "w " * 200) for t in range(1, 200)]
    made = chat_windows.chat_windows(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    check_windows(made)
    assert sorted(r.tokens for r in made)[-2] <= chat_windows.BUDGET  # but for the window of that turn itself
    assert sum(len(r.formatted) for r in made) < 4 * sum(len(r[3]) for r in rows)


def test_the_least_identifier_is_not_null(spark):
    rows = [(-(2**63), 0, "user", "least"), (None, 0, "user", "none"), (None, None, "assistant", "first"), (None, -(2**63), "user", "second")]
    made = chat_windows.chat_digests(chat_windows.chat_windows(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in made}
    rows = [rows[0], (None, 0, *rows[2][2:]), (None, 1, *rows[3][2:]), (None, 2, *rows[1][2:])]
    assert len(found) == 2 and found == conversation_digests(rows)


def test_chat_windows_read_back(spark, tmp_path):
    rng = random.Random(2)
    pieces = ["### Assistant: ", "</turn>", "\\", "\\\\#", "<", "a b", "\n", ": ", "\U0001f600", "word " * 40]
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choices(pieces, k=rng.randrange(9)))) for c in range(6) for t in range(rng.choice([1, 5, 200]))]
    rows += [(9, 0, "system", "be kind"), (9, 1, "user", None), (9, 2, None, "x"), (9, None, "assistant", "early"), (None, 0, "a:b\\", "no id"), (9, 2, "assistant", "tie"), (9, 2, "assistant", "tie"), (9, 3, "assistant", "long " * 3000)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int").repartition(4)
    windows = chat_windows.chat_windows(spark, turns)
    made = windows.collect()
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_windows.chat_digests(windows).collect()}
    assert found == conversation_digests(rows)
    check_windows(made)
    assert chat_windows.chat_digests(chat_windows.chat_windows(spark, turns.limit(0))).collect() == []


def test_chat_query(spark):
    found = {r.conv_id: r for r in op6_chat_format(spark, "/root/testdata/sf0.001").collect()}
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    want = conversation_digests([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in found.items()} == want
    # "### user: " and "### assistant: ", 26 characters with 5 backslashes in front, " </turn>" and a line end
    assert found[-7].formatted_chars == (10 + 26 + 5 + 9) + (15 + 26 + 5 + 9)


@pytest.fixture(scope="module")
def lattice():
    return sentencepiece_nbest.Lattice(public_tokenizers.path("piece_bpe_32k.model"))


def all_segmentations(lattice, word):
    if not word:
        return [(0.0, ())]
    out = []
    for a in range(len(word)):
        s, ids = lattice.edge(word, a, len(word)) or (None, None)
        if s is None:
            continue
        out += [(score + s, before + ids) for score, before in all_segmentations(lattice, word[:a])]
    return out


def test_nbest_is_exact(lattice):
    for word in ("▁hello", "▁▁the", "▁naïve\U0001f600x", "aaaaa", "▁Größe"):
        want = sorted((s for s, _ in all_segmentations(lattice, word)), reverse=True)[:3]
        found = lattice.search(word)
        assert [want[0] - x for x, _ in found] == pytest.approx(want) and len({ids for _, ids in found}) == len(found)
        score = {ids: s for s, ids in all_segmentations(lattice, word)}
        assert [score[ids] for _, ids in found] == pytest.approx(want)
        ids, best, loss, _ = lattice.word(word)
        assert (tuple(np.frombuffer(ids, "<i4").tolist()), best) == (found[0][1], want[0]) and best - loss == pytest.approx(want[1])


def test_fractional_scores_and_pieces_across_words():
    """As in a unigram model: scores that aren't whole numbers, pieces that hold a space."""
    rng, own = random.Random(11), sentencepiece_nbest.Lattice(public_tokenizers.path("piece_bpe_32k.model"))
    own.weigh([-rng.random() * 12 for _ in own.texts])
    words = ["▁" + "".join(rng.choices("aeinrst", k=rng.randrange(1, 8))) for _ in range(60)]
    for word in words:
        want = sorted((s for s, _ in all_segmentations(own, word)), reverse=True)[:3]
        found = own.search(word)
        assert [want[0] - x for x, _ in found] == pytest.approx(want) and len({ids for _, ids in found}) == len(found)
    assert own.many(words) == [own.word(w) for w in words]
    own.ids["s▁t"] = own.ids["the"]
    own.weigh([-rng.random() * 12 for _ in own.texts])
    assert not own.by_words
    (_, best, losses, _), whole = next(own.segmentations(["as to"])), "▁as▁to"
    assert [best - x for x in losses] == pytest.approx(sorted((s for s, _ in all_segmentations(own, whole)), reverse=True)[:3])


def test_a_long_text_without_spaces(lattice):
    ids, _, losses, changes = next(lattice.segmentations(["abcé😀" * 40_000]))
    assert losses[0] == 0 and losses == sorted(losses) and len(changes) == 2 and len(lattice.known) < 10
    assert sentencepiece_nbest.Decoder(lattice).decode(np.frombuffer(ids, "<i4")).decode() == "abcé😀" * 40_000


def test_nbest_of_a_text_is_that_of_its_whole_lattice(lattice):
    for text in ("the cat", "a b a", "to\nbe", "x"):
        whole = sentencepiece_nbest.MARK + text.replace(" ", sentencepiece_nbest.MARK)
        want = sorted((s for s, _ in all_segmentations(lattice, whole)), reverse=True)[:3]
        _, best, losses, _ = next(lattice.segmentations([text]))
        assert [best - x for x in losses] == pytest.approx(want)


def test_words_at_once_are_words_one_by_one(spark, lattice, sample):
    words = {c for r in sample.limit(40).collect() for c in lattice.chunks(r.text)} | {" x²", " .", "..", "a,b,", "", "\n\n", " " * 70, "😀x", "é" * 65}
    words = sorted(c.replace(" ", sentencepiece_nbest.MARK) for c in words)
    assert lattice.many(words) == [lattice.word(w) for w in words]


def test_every_text_decodes(spark, odd_docs, sample, no_docs, lattice):
    path = public_tokenizers.path("piece_bpe_32k.model")
    for docs in (odd_docs, sample):
        rows = sentencepiece_nbest.encoding_report(docs, path).collect()
        assert len(rows) == docs.count() and all(r.decoded for r in rows)
    clash = odd_docs.limit(3).selectExpr("text", "doc_id AS Piece_IDs", "doc_id AS _body", "doc_id AS `a.b`")
    assert sentencepiece_nbest.encode_documents(clash, path).columns == ["text", "Piece_IDs", "_body", "a.b", "piece_ids_", "best_score", "nbest_losses", "decoded"]
    assert all(r.decoded for r in sentencepiece_nbest.encode_documents(clash, path).collect())
    encoded = sentencepiece_nbest.encode_documents(odd_docs, path)
    assert encoded.columns == [*odd_docs.columns, "piece_ids", "best_score", "nbest_losses", "decoded"]
    decoder = sentencepiece_nbest.Decoder(lattice)
    for r in encoded.collect():
        assert decoder.decode(np.array(r.piece_ids, "<i4")).decode() == (r.text or "")
    assert sentencepiece_nbest.encoding_report(no_docs, path).collect() == []


def test_a_mark_in_a_text_is_told(spark):
    rows = spark.createDataFrame([("a ▁b",), ("a b",)], "text string")
    found = sentencepiece_nbest.encode_documents(rows, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert [r.decoded for r in found] == [False, True]


def test_models_that_fold_or_remove_are_refused(monkeypatch):
    import sentencepiece

    class Folding(sentencepiece.SentencePieceProcessor):
        def encode(self, text, **more):
            return super().encode(text.strip(), **more)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Folding)
    with pytest.raises(ValueError, match="remove no white space"):
        sentencepiece_nbest.Lattice(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_of_the_nbest(spark, lattice, sample):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["the cat", "a b a", "to\nbe", "x", ""]
    docs = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(sample.select("doc_id", "text").limit(30))
    decoder = sentencepiece_nbest.Decoder(lattice)
    for n, r in enumerate(sentencepiece_nbest.encode_documents(docs, path, with_changes=True).collect()):
        lists = [list(r.piece_ids)]
        for changes in r.nbest_changes:
            ids = list(r.piece_ids)
            for c in reversed(changes):
                ids[c.start : c.start + c.length] = c.ids
            lists.append(ids)
        assert len(lists) == len(r.nbest_losses) == len({*map(tuple, lists)}) and r.decoded
        for ids, loss in zip(lists, r.nbest_losses):
            assert decoder.decode(np.array(ids, "<i4")).decode() == r.text
        if n < 4:
            whole = sentencepiece_nbest.MARK + r.text.replace(" ", sentencepiece_nbest.MARK)
            score = {ids: s for s, ids in all_segmentations(lattice, whole)}
            assert [score[tuple(ids)] for ids in lists] == pytest.approx(sorted(score.values(), reverse=True)[:3])
    rows = sentencepiece_nbest.encoding_report(docs, path).collect()
    own = {r.doc_id: list(r.piece_ids) for r in sentencepiece_nbest.encode_documents(docs, path).collect()}
    assert all((r.n_pieces, r.ids_crc32) == (len(own[r.doc_id]), zlib.crc32(np.array(own[r.doc_id], "<i4").tobytes())) for r in rows)
    assert all(len(r.nbest_changes) == len(r.nbest_losses) - 1 for r in rows)
