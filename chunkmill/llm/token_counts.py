"""Exact token counts of every prefix of a text, for byte-level BPE files of the ``tokenizers`` library.

Prefix dynamic programming: the encoding of a prefix ends in one token, and what stands before that token is the encoding
of a shorter prefix. Of the tokens that end at a position only one can follow the last token of the prefix before it: two
tokens may stand side by side if no merge crosses the border between them while both are built (``stands``). So
going from the left, each position gets its last token and its count, the count where that token starts plus one. Nothing is
encoded again to know how many tokens a cut text has, how much of it a budget takes, or whether it is over a limit.

The counts are those of the text as the library cuts it before merging: the pieces of a text are independent. A unit is
a run of white space and the run of other characters behind it; a cut can't change what lies in earlier units. Inside a
unit three things need care: a cut in or behind white space leaves that as one piece, a cut inside a contraction takes it
apart, and a special token cut short is plain text. A unit of at most ``SHORT`` characters is worked out once while it stays in a
Python worker's cache, which lasts from task to task and is bounded; its pieces come from the library's own splitter.

Nulls: a null text counts as empty, its prefixes are the empty one with 0 tokens. Repeated rows each get a row. A very long text is held
with four bytes per character; one long word likewise. An empty table gives an empty result. Other columns are kept by
``prefix_counts``; where one has the name of an added column, the added one gets ``_`` behind its name.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import free_names, numbered, text_of

LIMIT = 1024
#: Units that a worker keeps in use; as many from before stay at hand. Likewise pieces, and borders between tokens.
CACHE = 1 << 18
BORDERS = 1 << 20
#: Characters of a kept unit: its counts fit a byte.
SHORT = 63
#: Texts whose new units are worked out together, and characters from which fewer are.
TEXTS = 256
BATCH_CHARS = 1 << 20
#: White space as the tokenizer's expression takes it, and its contractions.
SPACE = r"\t-\r \x85\xa0  -     　"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
UNITS = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: The same for texts without U+001C to U+001F, which Python's class holds besides.
PLAIN_UNITS = re.compile(r"\s*\S+|\s+")
NOT_PLAIN = re.compile("[\x1c-\x1f]")
LEADING = re.compile(rf"[{SPACE}]*")
#: Up to here units are split by an expression of ours, checked against the library's splitter; from here on by that.
LATIN = 0x180


def units(text: str) -> list[str]:
    return (UNITS if NOT_PLAIN.search(text) else PLAIN_UNITS).findall(text)


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level files write bytes: printable Latin-1 characters as themselves, all others in order from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def require(good: bool, what: str) -> None:
    if not good:
        raise ValueError(f"token counts need a byte-level BPE file {what}")


class Counter:
    """Counts of all prefixes; vocabulary and merges come from the file."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        spec = json.loads(tokenizer.to_str())
        model, pre = spec["model"], spec["pre_tokenizer"]
        require(model["type"] == "BPE" and pre is not None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"], "that splits by its own expression, without a space in front")
        require(spec["normalizer"] is None and not model["dropout"] and not model["continuing_subword_prefix"] and not model["end_of_word_suffix"], "without normalizer, dropout or marked word parts")
        require(not model.get("ignore_merges") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]), "with plain special tokens")
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        ids, letters = model["vocab"], byte_letters()
        #: Per token the number of its merge (-1: a byte) and the two it was made of; per pair of tokens its merge.
        self.age, self.parts, self.merge = [-1] * (max(ids.values()) + 1), [(0, 0)] * (max(ids.values()) + 1), {}
        for n, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            made = ids[a + b]
            require(self.age[made] < 0 and max(self.age[ids[a]], self.age[ids[b]]) < n, "that makes each token once, after its parts")
            self.age[made], self.parts[made], self.merge[ids[a], ids[b]] = n, (ids[a], ids[b]), n
        skipped = set(self.special)
        tokens = {bytes([letters[c] for c in t]): i for t, i in ids.items() if t not in skipped and (len(t) == 1 if self.age[i] < 0 else self.stands(*self.parts[i], self.age[i]))}
        require(sum(len(t) == 1 for t in tokens) == 256, "with a token for every byte")
        self.automaton(tokens)
        self.latin = self.latin_pieces()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, list[int]] = {}
        self.borders: dict[int, bool] = {}

    def automaton(self, tokens: dict[bytes, int]) -> None:
        """States by the bytes read last: ``steps`` by state << 8 | byte, ``falls`` to the next shorter suffix, and in ``ends`` the
        tokens (id, length) that end there, longest first."""
        self.steps, self.falls, self.ends = {}, [0], [()]
        own: list[tuple] = [()]
        for token, i in tokens.items():
            state = 0
            for c in token:
                after = self.steps.get(state << 8 | c)
                if after is None:
                    after = self.steps[state << 8 | c] = len(own)
                    own.append(())
                state = after
            own[state] = ((i, len(token)),)
        self.falls, self.ends = [0] * len(own), own
        below: list[list[tuple[int, int]]] = [[] for _ in own]
        for key, after in self.steps.items():
            below[key >> 8].append((key & 255, after))
        level = [0]
        while level:
            deeper = []
            for state in level:
                for c, after in below[state]:
                    fall = self.falls[state]
                    while state and fall and fall << 8 | c not in self.steps:
                        fall = self.falls[fall]
                    self.falls[after] = self.steps.get(fall << 8 | c, 0) if state else 0
                    own[after] += own[self.falls[after]]
                    deeper.append(after)
            level = deeper

    def latin_pieces(self):
        """The splitter for units below ``LATIN``, if the library sorts all those characters as Python does."""
        kinds = {c: "S" if re.match(f"[{SPACE}]", c) else "L" if c.isalpha() else "N" if c.isnumeric() else "P" for c in map(chr, range(LATIN))}
        joined = lambda a, b: len(self.split(a + b)) == 1
        for c, kind in kinds.items():
            if (joined("a", c), joined("1", c), joined("!", c)) != (kind == "L", kind == "N", kind == "P"):
                return None
        of = lambda kind: "".join(re.escape(c) for c, k in kinds.items() if k == kind)
        pattern = rf"'(?:{'|'.join(CONTRACTIONS)})| ?[{of('L')}]+| ?[{of('N')}]+| ?[{of('P')}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        return re.compile(pattern).findall

    def stands(self, left: int, right: int, before: int = 1 << 62) -> bool:
        """Whether two tokens stay side by side: undoing the youngest merge next to the border again and again, no pair across
        it may have a merge that comes first. Of equal merges the one further left comes first."""
        age, parts, merge = self.age, self.parts, self.merge
        while True:
            n = merge.get((left, right))
            if n is not None and n < before:
                return False
            a, b = age[left], age[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = a, parts[left][1]
            else:
                before, right = b + 1, parts[right][0]

    def by_bytes(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Per piece the counts of its prefixes of 0, 1, 2 .. bytes. Pieces come sorted: what one shares with the one before stays."""
        falls, ends, borders, stands = self.falls, self.ends, self.borders, self.stands
        step, known = self.steps.get, self.borders.get
        states, last, count, before = [0], [-1], [0], b""
        for data in pieces:
            if len(borders) > BORDERS:
                borders.clear()
            i, n = 0, min(len(data), len(before))
            while i < n and data[i] == before[i]:
                i += 1
            del states[i + 1 :], last[i + 1 :], count[i + 1 :]
            state = states[i]
            for i in range(i, len(data)):
                c = data[i]
                after = step(state << 8 | c)
                while after is None:
                    state = falls[state]
                    after = step(state << 8 | c)
                state = after
                for token, size in ends[state]:
                    a = i + 1 - size
                    if not a:
                        break
                    pair = last[a] << 32 | token
                    good = known(pair)
                    if good is None:
                        good = borders[pair] = stands(last[a], token)
                    if good:
                        break
                states.append(state)
                last.append(token)
                count.append(count[a] + 1)
            before = data
            yield count[:]

    def count_pieces(self, pieces: set[str]) -> dict[str, list[int]]:
        """The counts of pieces' prefixes of 0, 1, 2 .. characters; short ones stay."""
        if len(self.pieces) + len(pieces) > CACHE:
            self.pieces = {}
        new = sorted((p.encode("utf-8", "replace"), p) for p in pieces)
        out = {}
        for (data, piece), counts in zip(new, self.by_bytes([d for d, _ in new])):
            if len(data) > len(piece):
                counts = [c for c, b in zip(counts, data) if b & 0xC0 != 0x80] + counts[-1:]
            if piece[0] == "'" and len(piece) == 3 and piece[1:] in CONTRACTIONS:
                counts[2] = 2  # its first two characters are a piece each
            out[piece] = counts
        if len(out) <= CACHE:
            self.pieces.update((p, c) for p, c in out.items() if len(p) <= SHORT)
        return out

    def cut(self, unit: str) -> list[str]:
        """The pieces of a unit; in front, those of its leading white space as it stands when nothing follows."""
        latin = self.latin is not None and (unit.isascii() or max(unit) < chr(LATIN))
        if latin and unit[unit[0] == " " :].isalpha():
            return ["", unit]
        parts = self.latin(unit) if latin else [unit[a:b] for _, (a, b) in self.split(unit)]
        if len(parts) == 1:  # white space in front is one character at most, and a byte's token as a piece too
            return ["", unit]
        return [unit[: LEADING.match(unit).end()], *parts]

    def learn(self, new: set[str]) -> dict[str, bytes | list[int]]:
        """Units that aren't in use yet, with the counts of their prefixes of 1, 2 .. characters; the short ones stay."""
        if len(self.known) + len(new) > CACHE:
            self.known, self.older = {}, self.known
        found: dict = {u: own for u in new if (own := self.older.get(u)) is not None}
        pieces = {u: self.cut(u) for u in new if u not in found}
        before = self.pieces
        fresh = self.count_pieces({p for parts in pieces.values() for p in parts if p}.difference(before))
        for u, (spaces, *parts) in pieces.items():
            if len(parts) == 1:
                own = fresh.get(u) or before[u]
                found[u] = bytes(own[1:]) if len(u) <= SHORT else own[1:]
                continue
            out, at, base = [], 0, 0
            if spaces:
                own = fresh.get(spaces) or before[spaces]
                out += own[1:]
            for p in parts:
                own = fresh.get(p) or before[p]
                at += len(p)
                if at > len(out):
                    part = own[len(out) - at :]
                    out += [base + x for x in part] if base else part
                base += own[-1]
            found[u] = bytes(out) if len(u) <= SHORT else out
        if len(found) <= CACHE:  # those of one enormous text aren't kept
            self.known.update((u, own) for u, own in found.items() if len(u) <= SHORT)
        return found

    def learn_texts(self, texts: list[str]) -> list[list[str]]:
        """The units of several texts, of which the new short ones are learnt at once."""
        cut = [units(t) for t in texts]
        new = {u for own in cut for u in own}.difference(self.known)
        self.learn({u for u in new if len(u) <= SHORT})
        return cut

    def plain(self, text: str, own: list[str] | None = None) -> np.ndarray:
        """The counts of all prefixes of a text without special tokens, from the empty one on; ``own`` are its units, if known."""
        own = units(text) if own is None else own
        before = self.known
        found = list(map(before.get, own))
        if None in found:
            new = self.learn({u for u, c in zip(own, found) if c is None})
            found = [new[u] if c is None else c for u, c in zip(own, found)]
        if not own:
            return np.zeros(1, np.int32)
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        if sizes.max() <= SHORT:
            counts = np.frombuffer(b"".join(found), np.uint8).astype(np.int32)
        else:
            counts = np.concatenate([np.frombuffer(c, np.uint8) if isinstance(c, bytes) else np.array(c) for c in found]).astype(np.int32)
        last = counts[np.cumsum(sizes) - 1]
        return np.r_[np.int32(0), counts + np.repeat(np.cumsum(last, dtype=np.int32) - last, sizes)]

    def prefixes(self, text: str, own: list[str] | None = None) -> np.ndarray:
        """The counts of the prefixes of 0, 1, 2 .. characters; ``own`` are the text's units, if known."""
        if self.specials is None or self.specials.search(text) is None:
            return self.plain(text, own)
        out, at, base = [np.zeros(1, np.int32)], 0, 0
        for m in self.specials.finditer(text):
            counts = self.plain(text[at : m.end() - 1])  # a special token without its last character is plain text
            out.append(base + counts[1:])
            base += int(counts[m.start() - at]) + 1
            out.append(np.array([base], np.int32))
            at = m.end()
        out.append(base + self.plain(text[at:])[1:])
        return np.concatenate(out)


@functools.lru_cache(maxsize=2)
def counter_of(tokenizer_path: str) -> Counter:
    """One per Python worker, so that a worker's next task starts with filled caches."""
    return Counter(tokenizer_path)


def within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix that a budget takes; -1 where it is negative. A longer prefix can have fewer tokens than a shorter one."""
    if counts[-1] <= budget:
        return len(counts) - 1
    found = np.flatnonzero(counts <= budget)
    return int(found[-1]) if len(found) else -1


def by_size(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many rows, and bytes of the last column unless one row has more."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right"))
        end = min(max(end, at + 1), at + rows)
        yield batch.slice(at, end - at)
        at = end


def prefix_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text", budgets: Sequence[int] = ()) -> DataFrame:
    """Each row with its columns and ``prefix_tokens``: at place i the tokens of the text's first i characters, from i = 0 on.

    With ``budgets`` also ``budget_chars``: per budget the characters of the longest prefix that it takes.
    """
    limits = list(budgets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer_path)
        for whole in batches:
            for batch in by_size(whole, TEXTS, BATCH_CHARS):
                texts = batch.column(batch.num_columns - 1).to_pylist()
                cut = counter.learn_texts(texts) if len(texts) > 1 else [None]
                held = [counter.prefixes(t, own) for t, own in zip(texts, cut)]
                ends = pa.array(np.cumsum([0, *map(len, held)]).astype(np.int32))
                columns = [*batch.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(np.concatenate(held)))]
                if limits:
                    columns.append(pa.array([[within(c, b) for b in limits] for c in held], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    made = ["prefix_tokens", *(["budget_chars"] if limits else [])]
    schema = StructType([*docs.schema.fields, *[StructField(n, ArrayType(IntegerType())) for n in free_names(docs, *made)]])
    names = schema.names
    return docs.select(*numbered(docs), text_of(text_col).alias("body")).mapInArrow(run, schema)


def tokens_of(prefix_tokens: Column | str, chars: Column | int | None = None) -> Column:
    """Tokens of the first ``chars`` characters, of the whole text without; null beyond its end."""
    at = F.lit(-1) if chars is None else (chars if isinstance(chars, Column) else F.lit(chars)) + 1
    return F.try_element_at(F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens, at.cast("int"))


def chars_within(prefix_tokens: Column | str, budget: int) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens, from the stored counts alone."""
    return F.coalesce(F.array_max(F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i))), F.lit(-1))


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row: id, ``n_bytes``, ``n_tokens``, ``over_limit``, ``limit_chars`` (characters of the longest prefix within the limit)."""
    made = prefix_counts(docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), text_of(text_col).alias("body")), tokenizer_path, "body", [limit])
    made = made.select("id", "n_bytes", "prefix_tokens", "budget_chars")
    n = tokens_of("prefix_tokens").cast("long")
    return made.select(F.col("id").alias(id_col), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"), F.element_at("budget_chars", 1).cast("long").alias("limit_chars"))
