"""Literal cases of the chunkers, the tokenizers and the router."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chunkmill.functions import text as T
from chunkmill.functions import tokenizers as tok
from chunkmill.functions.config import PLAYGROUND, FastConfig, RecursiveConfig, Rule, SentenceConfig, TableConfig, TokenConfig, clamped
from chunkmill.operators import chunking, cuts, token_chunker
from chunkmill.plans import queries as plans

MD = "| city | pop |\n| --- | --- |\n| Rom | 28 |\n| Ulm | 12 |\n| Bern | 13 |\n| Oslo | 70 |\n"
HTML = "<table><thead><tr><th>city</th><th>pop</th></tr></thead><tbody>" + "".join(f"<tr><td>{n}</td><td>{s}</td></tr>" for n, s in (("Rom", 28), ("Ulm", 12), ("Bern", 13), ("Oslo", 70))) + "</tbody></table>"
HILLS = "Green hills roll.\nFar.\n\nEnd of it."
RULES = (Rule(("\n\n",)), Rule(("\n",)), Rule(whitespace=True), Rule())


def chunked(spark, make, text):
    return spark.createDataFrame([(text,)], "text string").select(F.inline(make(F.col("text")))).collect()


def spans(rows):
    return [(r.text, r.start_idx, r.end_idx) for r in rows]


def token(config):
    return lambda c: token_chunker.token_chunks(c, config)


@pytest.mark.parametrize(
    "config,text,want",
    [
        (TokenConfig(5, 2, tok.WORD), "red fox ran. It saw me. Gone", [("red fox ran. It saw", 0, 19, 5), ("It saw me. Gone", 13, 28, 4)]),
        (TokenConfig(2, 0, tok.CHARACTER), "klmno", [("kl", 0, 2, 2), ("mn", 2, 4, 2), ("o", 4, 5, 1)]),
        (TokenConfig(4, 1, tok.CHARACTER), "qrstuvwxy", [("qrst", 0, 4, 4), ("tuvw", 3, 7, 4), ("wxy", 6, 9, 3)]),
        (TokenConfig(2, 0, tok.WORD), "one two three four", [("one two", 0, 7, 2), ("three four", 7, 17, 2)]),
        (TokenConfig(2, 0, tok.CHARACTER), "a\U0001f642b", [("a\U0001f642", 0, 3, 3), ("b", 3, 4, 1)]),
    ],
)
def test_token(spark, config, text, want):
    assert [tuple(r) for r in chunked(spark, token(config), text)] == want
    assert [c[:4] for c in cuts.in_utf16(text, cuts.windows(text, config))] == want


def test_sentence(spark):
    run = lambda text, *a, **k: chunked(spark, lambda c: chunking.sentence_chunks(c, SentenceConfig(*a, **k | {"tokenizer": tok.CHARACTER})), text)
    rows = run("Snow is cold. Rain is wet! Wind is loud? Fog is grey.", 40, 10, (". ", "! ", "? "))
    assert [(r.start_idx, r.end_idx, r.token_count) for r in rows] == [(0, 27, 27), (14, 53, 39)]
    assert spans(run("Kestrel nest", 20, 0, (".",))) == [("Kestrel nest", 0, 12)]
    assert [r.text for r in run("Otter. Newt.", 7, 0, (". ",))] == ["Otter. ", "Newt."]
    assert [r.text for r in run("Otter. Newt.", 7, 0, (". ",), "next")] == ["Otter", ". Newt."]
    assert [r.text for r in run("Otter. Newt.", 5, 0, (". ",), None)] == ["Otter", "Newt."]


@pytest.mark.parametrize(
    "config,text,want",
    [
        (FastConfig(18, (".", "?", "!")), "It rained a lot. We ran home! And then?", [("It rained a lot.", 0, 16), (" We ran home!", 16, 29), (" And then?", 29, 39)]),
        (FastConfig(10, (".", "?", "!")), "Oh \U0001f30d tea. Снега!", [("Oh \U0001f30d te", 0, 8), ("a.", 8, 10), (" Снег", 10, 15), ("а!", 15, 17)]),
        (FastConfig(5, (".", "?")), "klmnopq", [("klmno", 0, 5), ("pq", 5, 7)]),
        (FastConfig(100, (".",)), "abc. def", [("abc.", 0, 4), (" def", 4, 8)]),
        (FastConfig(1, ("ab", ".")), "é.", [("é", 0, 1), (".", 1, 2)]),
    ],
)
def test_fast(spark, config, text, want):
    rows = chunked(spark, lambda c: chunking.fast_chunks(c, config), text)
    assert spans(rows) == want and [r.token_count for r in rows] == [b - a for _, a, b in want]


def test_recursive(spark):
    run = lambda text, *a: chunked(spark, lambda c: chunking.recursive_chunks(c, RecursiveConfig(*a, tokenizer=tok.CHARACTER)), text)
    rows = run(HILLS, 12, 1, RULES)
    assert [(r.text, r.start_idx, r.recursive_rule_level) for r in rows] == [("Green hills ", 0, 2), ("roll.\n", 12, 2), ("Far.\n\n", 18, 1), ("End of it.", 24, 0)]
    rows = run("abcdefghij" * 3, 12, 1, RULES)
    assert [(len(r.text), r.recursive_rule_type, r.recursive_rule_level) for r in rows] == [(12, "tokenFallback", -1), (12, "tokenFallback", -1), (6, "tokenFallback", -1)]
    rows = run("A|B|", 50, 24, (Rule(("|",)),))
    assert [(r.text, r.recursive_rule_level, r.recursive_rule_type, r.recursive_delimiter) for r in rows] == [("A|B|", 0, "delimiter", "|")]
    assert [(r.recursive_rule_level, r.recursive_rule_type) for r in run("A B C", 50, 24, (Rule(whitespace=True),))] == [(0, "whitespace")]
    assert [r.text for r in run("A.\nB.\nLonger.", 10, 5, (Rule(("\n",)),))] == ["A.\nB.\n", "Longer."]
    assert [r.recursive_rule_type for r in run("abcdef ghi", 3, 1, (Rule((" ",)),))] == ["tokenFallback"] * 3 + ["delimiter"]


def test_short_parts_are_counted_in_utf16_units():
    """13 characters outside the basic plane are 26 units, so they are a part of their own at a least length of 24."""
    wide = "\U0001f600" * 13
    rule = (Rule(("|",)),)
    assert [c[0] for c in cuts.recursive(f"{wide}|{wide}|", RecursiveConfig(30, 24, rule, tok.CHARACTER))] == [f"{wide}|", f"{wide}|"]


def short_parts_one_by_one(text, parts, least):
    """Each part in turn, in UTF-16 units: joined to the last one if it is short; a short first one is joined to the second at the end."""
    units = lambda t: len(t.encode("utf-16-le")) // 2
    kept = [""]
    for n, part in enumerate(text[a:b] for a, b in parts):
        kept = [part] if n == 0 else [*kept[:-1], kept[-1] + part] if units(part) < least else [*kept, part]
    return ["".join(kept[:2]), *kept[2:]] if len(kept) > 1 and units(kept[0]) < least else kept


def test_joined_short_parts_against_one_by_one():
    rng = random.Random(5)
    for _ in range(300):
        lengths = [rng.choice([1, 1, 2, 3, 6]) for _ in range(rng.randrange(1, 12))]
        text = "".join(rng.choices("a\U0001f600b", k=sum(lengths)))
        cut = [0, *itertools.accumulate(lengths)]
        parts = list(zip(cut, cut[1:]))
        for least in (1, 2, 3, 5):
            want = short_parts_one_by_one(text, parts, least)
            assert [text[a:b] for a, b in cuts.long_enough(parts, least, cuts.utf16_sizes(text))] == want


def test_many_short_parts_take_linear_time():
    began = time.process_time()
    assert "".join(c[0] for c in cuts.recursive("x\n" * 200_000, RecursiveConfig(2000, 24, RULES, tok.CHARACTER))) == "x\n" * 200_000
    assert time.process_time() - began < 20


@pytest.mark.parametrize(
    "text,want",
    [
        ("", []),
        ("| a |\n|---|---|", [("table", "| a |\n|---|---|\n")]),
        ("| a |\n|---|", [("text", "| a |\n|---|")]),
        ("x\n | a | b | \n\t|---|:---:|\n| 1 |\nnot | one |\n| p |\n---|---\n| 2 | 3 |\n\n", [("text", "x"), ("table", " | a | b | \n\t|---|:---:|\n| 1 |\n"), ("text", "not | one |"), ("table", "| p |\n---|---\n| 2 | 3 |\n")]),
        ("| a |\n--|--\n| b |", [("text", "| a |\n--|--\n| b |")]),
        ("| a |\n|---|---| x\n| b |\n|---|---|\n| c | d", [("text", "| a |\n|---|---| x"), ("table", "| b |\n|---|---|\n"), ("text", "| c | d")]),
    ],
)
def test_markdown_segments(text, want):
    assert cuts.markdown_segments(text) == want


def test_table(spark):
    run = lambda text, *a: chunked(spark, lambda c: chunking.table_chunks(c, TableConfig(*a, tokenizer=tok.CHARACTER)), text)
    rows = run(MD, 2, "row", "markdown")
    assert [(r.start_idx, r.end_idx, r.token_count, r.table_columns) for r in rows] == [(29, 55, 2, ["city", "pop"]), (55, 83, 2, ["city", "pop"])]
    assert all(r.text.startswith("| city | pop |\n| --- | --- |\n") and r.is_table and r.table_has_header for r in rows)
    assert [r.token_count for r in run(MD, 12, "token", "markdown")] == [42, 42, 43, 43]
    rows = run(HTML, 2, "row", "html")
    at = [*[m.start() for m in re.finditer("<tr><td>", HTML)], HTML.index("</tbody>")]
    assert [(r.start_idx, r.end_idx, r.token_count) for r in rows] == [(at[0], at[2], 2), (at[2], at[4], 2)] and rows[0].text.endswith("</tbody></table>")
    assert run(MD) and run(HTML) and run("| head |\n| data |") == []


def test_blank_is_no_chunk_and_bad_settings_fail(spark):
    for make in (token(TokenConfig()), chunking.fast_chunks, chunking.sentence_chunks, chunking.recursive_chunks, chunking.table_chunks):
        assert chunked(spark, make, "   \n\t  ") == [] and chunked(spark, make, None) == []
    for kind in (FastConfig, TokenConfig, SentenceConfig, RecursiveConfig, TableConfig):
        with pytest.raises(ValueError, match="Expected a value greater than 0, got 0"):
            kind(0)
    with pytest.raises(ValueError, match="chunkOverlap must be less than chunkSize"):
        TokenConfig(4, 4)
    assert clamped(0.5, 9) == (1, 0) and clamped(10.7, 20) == (10, 9)


def test_tokenizers(spark):
    def ids(texts, tokenizer, known=None):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        vocab = tok.vocabulary(docs, tokenizer, known=known)
        return {r.doc_id: r.ids for r in tok.encode(docs, tokenizer, vocab).collect()}, vocab

    found, vocab = ids(["ab", "ba!"], tok.CHARACTER)
    assert found == {0: [0, 1], 1: [1, 0, 2]}
    assert ids(["cddc"], tok.CHARACTER)[0] == {0: [0, 1, 1, 0]}
    assert ids(["c!b"], tok.CHARACTER, vocab)[0] == {0: [3, 2, 1]}
    assert ids(["go slowly slowly now"], tok.WORD)[0] == {0: [0, 1, 1, 2]}
    wide = tok.Tokenizer(("!\n", ". ", "? ", " ", "\n", ".", "?", "!"), " ")
    for text, tokenizer, n, back in (("Red hat. Blue hat!\nOld hat? New hat", wide, 8, "Red hat Blue hat Old hat New hat"), ("Come in!\nSit down? Good.", tok.SENTENCE, 3, "Come in. Sit down. Good"), ("a  b ", tok.WORD, 4, "a  b "), ("a\U0001f642b", tok.CHARACTER, 4, "a\U0001f642b")):
        docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
        assert docs.select(tokenizer.count(F.col("text"))).first()[0] == n == tokenizer.count_text(text)
        vocab = tok.vocabulary(docs, tokenizer)
        assert tok.decode(tok.encode(docs, tokenizer, vocab), tokenizer, vocab).first().text == back
    bad = spark.createDataFrame([(0, [999])], "doc_id long, ids array<long>")
    assert tok.decode(bad, tok.WORD, vocab).first().error == "Unknown token id: 999"


def routed(spark, name, text, pages=None):
    docs = spark.createDataFrame([(name, text, pages)], "file_name string, text string, pages array<string>")
    return chunking.chunk_documents(docs).orderBy("chunk_index").collect()


def test_router(spark):
    rows = routed(spark, "cities.md", MD)
    assert len(rows) == 2 and all("| --- |" in r.text and r.chunk_strategy == "table" for r in rows)
    rows = routed(spark, "notes.md", "# Title\nPlain words only.\n* a point\n* a second\n")
    assert rows and not any("| --- |" in r.text for r in rows)
    table = "\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n\n"
    rows = routed(spark, "towns.md", "Before" + table + "Between" + table + "After")
    assert [r.chunk_strategy for r in rows] == ["recursive", "table", "recursive", "table", "recursive"]
    assert [r.chunk_index for r in rows] == list(range(5)) and {r.chunk_count for r in rows} == {5}
    assert [r.text for r in routed(spark, "t.md", "a\n\n| x | y |\n| --- | --- |\n\nb")] == ["a", "b"]
    assert routed(spark, "x.docx", "text") == []
    rows = routed(spark, "x.pdf", "all", ["one.  two", "", "three"])
    assert [(r.text, r.page_number, r.page_count) for r in rows] == [("one. two", 1, 3), ("three", 3, 3)]
    assert [(r.text, r.page_number) for r in routed(spark, "x.pdf", " all ", [])] == [("all", None)]
    assert [r.chunk_strategy for r in routed(spark, "x.csv", "a,b")] == ["token"]


def test_fast_from_the_threshold_on(spark):
    long, short = "word. " * 20000, "word. " * 10
    assert {r.chunk_strategy for r in routed(spark, "x.txt", long)} == {"fast"} and {r.chunk_strategy for r in routed(spark, "x.txt", short)} == {"sentence"}


def test_long_pages_and_all_types_are_in_the_results(spark, tmp_path):
    from chunkmill.plans import queries as plans

    pages = ["short page", "".join(f"Word {i} ends. " for i in range(900)).strip(), "", "x" * 5000]
    spark.createDataFrame([(i, "\n".join(pages[i:])) for i in range(4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = plans.io2_pdf_page_chunks(spark, str(tmp_path)).collect()
    parts = Counter((r.doc_id, r.page_number) for r in rows)
    assert {*parts} == {(i, p - i + 1) for i in range(4) for p in range(i, 4) if pages[p]}
    assert parts[0, 1] == 1 and parts[0, 2] > 1
    found = {(r.doc_id, r.page_number): r.digest for r in plans.io2_pdf_pages_rebuilt(spark, str(tmp_path)).collect()}
    assert found == {(i, n): hashlib.md5(pages[i + n - 1].replace(" ", "").encode()).hexdigest() for i, n in parts}
    counts = {r.doc_id: r.chunk_count for r in plans.c7_a1_chunk_counts_as_csv(spark, str(tmp_path)).collect()}
    assert counts == {i: -(-len("\n".join(pages[i:]).strip()) // 2048) for i in range(4)}


ODD = ["", None, " \n\t\xa0", ".", "One is here. Two, three\nfour " * 30, " \u00e4 b" * 60]


def odd_documents(spark, path):
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["c1_fast_rebuilt", "c3_sentence_rebuilt", "c4_recursive_rebuilt"])
def test_texts_without_chunks_are_rebuilt_too(spark, tmp_path, name):
    rows = plans.QUERIES[name](spark, odd_documents(spark, tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [(i, t if t is None else hashlib.md5(t.encode()).hexdigest(), t if t is None else len(t)) for i, t in enumerate(ODD)]


def test_report_has_a_row_where_there_are_chunks(spark, tmp_path):
    rows = plans.c8_chunk_report(spark, odd_documents(spark, tmp_path)).collect()
    want = []
    for i, t in enumerate(ODD):
        for name, size, stride in ("token", 240, 216), ("wide", 1000, 1000):
            n = [len(t[k : k + size]) for k in range(0, max(len(t) - size + stride, 1), stride)] if t else []
            want += [(name, i, len(n), sum(n), sum(n), max(n))] if n else []
    assert sorted(map(tuple, rows)) == sorted(want)


def test_empty_and_blank_texts_have_word_frames(spark, tmp_path):
    rows = plans.w4_word_windows(spark, odd_documents(spark, tmp_path)).collect()
    want = []
    for i, t in enumerate(ODD):
        words = [] if t is None else t.split(" ")
        frames = [words[k : k + 50] for k in range(0, max(len(words) - 10, min(len(words), 1)), 40)]
        want += [(i, k, len(f), hashlib.md5(" ".join(f).encode()).hexdigest()) for k, f in enumerate(frames)]
    assert want[0][:3] == (0, 0, 1) and sorted(map(tuple, rows)) == want


def test_windows_of_blank_texts_where_they_are_asked_for(spark):
    class Letters(tok.TextTokenizer):
        """Characters, by a tokenizer that has no column form."""

        def split_text(self, text):
            return list(text)

        def join_tokens(self, tokens):
            return "".join(tokens)

    rows = spark.createDataFrame([(t,) for t in ODD], "text string")
    windows = lambda t: token_chunker.token_chunks(F.col("text"), TokenConfig(3, 1, t), keep_blank=True)
    on_columns, helped = (rows.select(windows(t).alias("c")).collect() for t in (tok.CHARACTER, Letters()))
    assert on_columns == helped and [[c.text for c in r.c] for r in on_columns[:4]] == [[], [], [" \n\t", "\t\xa0"], ["."]]


def test_long_white_space_takes_linear_time(spark):
    """A megabyte of no-break spaces inside a text, behind a separator line and as a line; quadratic forms took minutes for a tenth."""
    n = 1_000_000
    space, table = "a" + "\xa0" * n + "b", "| a | b |\n|---|---|" + "\xa0" * n + "x\n" + "\xa0" * n
    rows = spark.createDataFrame([(space,), (table,), ("|---" * 200_000,), ("a" + "\n" * n + "| b",)], "text string").cache()
    assert rows.count() == 4
    began = time.perf_counter()
    text = F.col("text")
    found = rows.select(F.length(T.js_trim(text)).alias("n"), T.looks_like_markdown_table(text).alias("looks"), T.is_separator_line(text).alias("line"), F.length(T.normalize_whitespace(text)).alias("m")).collect()
    assert [(r.n, r.looks, r.line, r.m) for r in found] == [(n + 2, False, False, n + 2), (n + 20, False, False, n + 20), (800_000, False, True, 800_000), (n + 4, False, False, 6)]
    for value in (space, table):
        assert cuts.trim(value).endswith(value.strip("\xa0\n")[-1])
        assert [k for k, _ in cuts.markdown_segments(value)] == ["text"] and cuts.parse_markdown(value) is None
    assert time.perf_counter() - began < 30


@pytest.mark.parametrize("letters", ["ab cd ", "äb cd ", "a\U0001f600 cd "])
def test_many_character_windows_take_linear_time(spark, letters):
    text = letters * 170_000
    rows = spark.createDataFrame([(text,)], "text string").cache()
    assert rows.count() == 1
    began = time.perf_counter()
    found = chunked_rows(rows, TokenConfig(240, 24, tok.CHARACTER))
    assert time.perf_counter() - began < 15
    units = lambda t: len(t.encode("utf-16-le")) // 2
    assert len(found) == -(-(len(text) - 240) // 216) + 1
    for k in (0, 1, 1000, len(found) - 1):
        piece = text[k * 216 : k * 216 + 240]
        assert tuple(found[k]) == (piece, units(text[: k * 216]), units(text[: k * 216]) + units(piece), units(piece))


def chunked_rows(rows, config):
    return rows.select(F.inline(token_chunker.token_chunks(F.col("text"), config))).collect()


def test_character_windows_of_any_overlap(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices(["a", "b ", "é", "\U0001f600", "漢"], k=rng.randrange(40))) + "x" for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for size, over in ((1, 0), (5, 4), (7, 2), (30, 29)):
        config = TokenConfig(size, over, tok.CHARACTER)
        found = rows.select("text", token_chunker.token_chunks(F.col("text"), config).alias("c")).collect()
        for r in found:
            assert [tuple(c) for c in r.c] == [c[:4] for c in cuts.in_utf16(r.text, cuts.windows(r.text, config))]


def test_any_tokenizer_runs_through_the_chunkers(spark):
    class Syllables(tok.TextTokenizer):
        """Two letters to a token."""

        def split_text(self, text):
            return [text[i : i + 2] for i in range(0, len(text), 2)]

        def join_tokens(self, tokens):
            return "".join(tokens)

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), tok.LibraryTokenizer(path)
    text = "Green hills roll over the land. Far off a bell rings twice, and then it stops.\n\nThe end of it all, unbelievably."
    ids = library.encode(text).ids
    rows = chunked(spark, token(TokenConfig(6, 2, own)), text)
    assert [r.text for r in rows] == [library.decode(ids[i : i + 6]) for i in range(0, len(ids) - 2, 4)]
    assert all(text[r.start_idx : r.end_idx] == r.text for r in rows) and rows[0].token_count == 6
    rows = chunked(spark, lambda c: chunking.recursive_chunks(c, RecursiveConfig(8, 4, tokenizer=own)), text)
    assert "".join(r.text for r in rows) == text and len(rows) > 3 and all(r.token_count <= 8 for r in rows)
    rows = chunked(spark, lambda c: chunking.sentence_chunks(c, SentenceConfig(12, 0, tokenizer=own)), text)
    assert "".join(r.text for r in rows) == text and all(r.token_count >= len(library.encode(r.text).ids) for r in rows)
    rows = chunked(spark, lambda c: chunking.table_chunks(c, TableConfig(20, "token", tokenizer=own)), MD)
    assert len(rows) > 1 and rows[0].token_count == sum(len(library.encode(x).ids) for x in ("| city | pop |\n| --- | --- |\n", "| Rom | 28 |\n"))
    assert [r.text for r in chunked(spark, token(TokenConfig(2, 0, Syllables())), "abcdefg")] == ["abcd", "efg"]
    router = chunking.Router(token=TokenConfig(3, 0, Syllables()))
    docs = spark.createDataFrame([("a.csv", "abcdefgh"), ("b.txt", "abc")], "file_name string, text string")
    assert sorted((r.text, r.chunk_strategy) for r in chunking.chunk_documents(docs, router).collect()) == [("abc", "sentence"), ("abcdef", "token"), ("gh", "token")]


def test_defaults_count_words_but_the_router_characters():
    for kind in (TokenConfig, SentenceConfig, RecursiveConfig, TableConfig):
        assert kind().tokenizer == tok.WORD
    assert {c.tokenizer for k, c in PLAYGROUND.items() if k != "fast"} == {tok.WORD}
    router = chunking.Router()
    assert {c.tokenizer for c in (router.token, router.sentence, router.recursive, router.table)} == {tok.CHARACTER}


@pytest.mark.parametrize("block_bytes", [1 << 22, 1])
def test_encode_and_decode_of_odd_rows(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(tok, "BLOCK_BYTES", block_bytes)
    texts = ["b a b", None, "", "a  c", "d", "a b c d e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    vocab = tok.vocabulary(docs, tok.WORD)
    assert {r.token: r.id for r in vocab.collect()} == {"b": 0, "a": 1, "": 2, "c": 3, "d": 4, "e": 5}
    found = tok.encode(docs, tok.WORD, vocab.filter("token <> 'c'"))
    assert {r.doc_id: r.ids for r in found.collect()} == {0: [0, 1, 0], 1: [], 2: [2], 3: [1, 2], 4: [4], 5: [1, 0, 4, 5]}
    ids = spark.createDataFrame([(1, [0, 1, None]), (2, None), (3, []), (4, [0, 99, 98]), (None, [5])], "doc_id int, ids array<long>").repartition(2)
    back = {r.doc_id: (r.text, r.error) for r in tok.decode(ids, tok.WORD, vocab).collect()}
    assert back == {1: ("b a", None), 2: ("", None), 3: ("", None), 4: (None, "Unknown token id: 99"), None: ("e", None)}
    none = docs.limit(0)
    assert tok.vocabulary(none, tok.WORD).collect() == [] and tok.encode(none, tok.WORD, vocab).collect() == []
