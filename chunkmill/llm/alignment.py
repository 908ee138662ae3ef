"""Alignment of two tokenizers' tokens of one text: a byte-level BPE file (A) and a SentencePiece model (B).

Both encode a space and the text; each token covers a range of its bytes. Where a token of A and one of B end at the same
byte, both sequences can be cut. Divide and conquer: in an interval of both, the shared end nearest to the middle is found by bisecting one sequence's ends
for those of the other, and both halves go on in the same way; an interval without a shared end
inside is a leaf, one group. Each group ends in one token of A and one of B, which are linked.

A text is cut beforehand where a space or line end follows a character that isn't white space: no token of either crosses
such a place (checked against both files), so these cuts are shared and lie above the recursion. What lies between is a
unit; equal short units are encoded and aligned once while they stay in a Python worker's cache, which lasts from task
to task and is bounded.

An id pair is linked where one token's bytes are the end of the other's: only so many pairs as the tokens have ends can occur.
That bounds the table of pairs by the two vocabularies (about half a million here) whatever the corpus, so it is numbered once, counted by
tasks and sent to all of them. A document's links are staged as pair numbers between counting and scoring.

Nulls: a null text, an empty one, and one whose tokens don't give a space and the text back byte for byte, has no tokens: zeros and an empty
``groups_sha256``. Repeated rows each get a row, and each counts. A very long text is held as its units; one long unit is encoded by itself. An
empty table gives an empty result. ``align_documents`` keeps the other columns; where one has the name of an added column,
the added one gets ``_`` behind its name.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import forget_worker, free_names, numbered, of_worker, stage_table, text_of
from .token_counts import SPACE, by_size, byte_letters

MARK = "▁"
#: Units that a worker keeps in use; as many from before stay at hand. Characters of a kept one.
CACHE = 4 << 16
SHORT = 64
#: Texts whose new units are encoded together, and bytes from which fewer are.
TEXTS, BATCH_BYTES = 256, 1 << 20
#: Rows whose links are counted or scored at once.
ROWS = 512
#: From a place behind white space to the next where a space or line end follows another character.
UNITS = re.compile(rf"[{SPACE}]*+(?:[^{SPACE}]++(?:(?![ \n])[{SPACE}]++)?+)++|[{SPACE}]++")


def shared_cuts(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (i, j) behind which both sequences of ends are cut, in order: a[i - 1] == b[j - 1]. The last ends are the same."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        if i_end - i > 1 and j_end - j > 1:
            cut = middle_cut(a, b, i, i_end - 1, j, j_end - 1)
            if cut is not None:
                at, to = cut
                todo.append((at + 1, i_end, to + 1, j_end))
                todo.append((i, at + 1, j, to + 1))
                continue
        out.append((i_end, j_end))
    return out


def middle_cut(a: list[int], b: list[int], i: int, i_end: int, j: int, j_end: int) -> tuple[int, int] | None:
    """Of a[i:i_end] the end nearest to the middle that b[j:j_end] has too, with its place there."""
    low = (i + i_end) // 2
    high = low + 1
    low_to = high_to = bisect_left(b, a[low], j, j_end)
    while low >= i or high < i_end:
        if low >= i:
            low_to = bisect_left(b, a[low], j, low_to + 1 if low_to < j_end else j_end)
            if low_to < j_end and b[low_to] == a[low]:
                return low, low_to
            low -= 1
        if high < i_end:
            high_to = bisect_left(b, a[high], high_to, j_end)
            if high_to < j_end and b[high_to] == a[high]:
                return high, high_to
            high += 1
    return None


class Aligner:
    """Encodes units with both tokenizers and aligns them. A unit's value: tokens of A, of B, its groups as text, the numbers of its links."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        spec, letters = json.loads(self.a.to_str()), byte_letters()
        if spec["normalizer"] is not None or spec["pre_tokenizer"] is None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or not spec["pre_tokenizer"]["use_regex"]:
            raise ValueError("A must be a byte-level file that splits by its own expression, without a space in front")
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes([letters[c] for c in token]) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        normal = [i for i in range(len(pieces)) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i) or self.b.is_byte(i))]
        if any(MARK in pieces[i].lstrip(MARK) or "\n" in pieces[i] for i in normal) or self.b.encode("x  \n y ", out_type=str)[:1] != [MARK + "x"] or self.b.decode(self.b.encode("x  \n y ")) != "x  \n y ":
            raise ValueError("B must put a mark in front, remove nothing, and have no piece that reaches over a space or line end")
        self.numbered_pairs([i for i in range(len(self.bytes_a)) if self.bytes_a[i]], [*normal, *(i for i in range(len(pieces)) if self.b.is_byte(i))])
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def numbered_pairs(self, ids_a: list[int], ids_b: list[int]) -> None:
        """All pairs of which one token's bytes end the other's, as a << 32 | b in order; a pair's place there is its number."""
        ends_a: dict[bytes, list[int]] = {}
        ends_b: dict[bytes, list[int]] = {}
        for ids, own, ends in ((ids_a, self.bytes_a, ends_a), (ids_b, self.bytes_b, ends_b)):
            for i in ids:
                ends.setdefault(own[i], []).append(i)
        pairs = {a << 32 | b for a in ids_a for k in range(len(self.bytes_a[a])) for b in ends_b.get(self.bytes_a[a][k:], ())}
        pairs |= {a << 32 | b for b in ids_b for k in range(len(self.bytes_b[b])) for a in ends_a.get(self.bytes_b[b][k:], ())}
        self.pairs = np.array(sorted(pairs), np.int64)

    def learn(self, new: set[str]) -> dict[str, tuple | None]:
        """Units that aren't in use yet; the short ones stay."""
        if len(self.known) + len(new) > CACHE:
            self.known, self.older = {}, self.known
        found = {u: self.older[u] for u in new if u in self.older}
        rest = [u for u in new if u not in found]
        links, at = [], []
        encoded = self.a.encode_batch_fast(rest, add_special_tokens=False)
        marked = self.b.encode([u[1:] if u[0] == " " else u for u in rest], num_threads=1)
        for u, ea, ids_b in zip(rest, encoded, marked):
            ids_a = ea.ids
            if u[0] != " ":
                ids_b = ids_b[1:]  # the mark that B puts in front, a piece by itself before a line end
            elif not ids_b:
                ids_b = self.lone_space()
            own = self.aligned(u, ids_a, ids_b)
            if own is None:
                found[u] = None
                continue
            groups, last = own
            at.append((u, len(ids_a), len(ids_b), groups, len(links), len(last)))
            links += last
        numbers = np.searchsorted(self.pairs, np.array(links, np.int64)).astype("<i4").tobytes()
        found.update((u, (n_a, n_b, groups, numbers[4 * k : 4 * (k + n)])) for u, n_a, n_b, groups, k, n in at)
        if len(found) <= CACHE:
            self.known.update((u, own) for u, own in found.items() if len(u) <= SHORT)
        return found

    def lone_space(self) -> list[int]:
        """B gives an empty text no mark; a unit of one space is that mark."""
        return self.b.encode("\n")[:1]

    def aligned(self, unit: str, ids_a: list[int], ids_b: list[int]) -> tuple[bytes, list[int]] | None:
        """The unit's groups as text and its links as a << 32 | b; None if its tokens don't give it back."""
        data, own_a, own_b = unit.encode("utf-8", "replace"), self.bytes_a, self.bytes_b
        parts_a, parts_b = [own_a[i] for i in ids_a], [own_b[i] for i in ids_b]
        if b"".join(parts_a) != data or b"".join(parts_b) != data:
            return None
        if len(ids_a) == 1 or len(ids_b) == 1:  # one group
            return f"{','.join(map(str, ids_a))}|{','.join(map(str, ids_b))}".encode(), [ids_a[-1] << 32 | ids_b[-1]]
        ends_a, ends_b = list(accumulate(map(len, parts_a))), list(accumulate(map(len, parts_b)))
        groups, links, i, j = [], [], 0, 0
        for i_end, j_end in shared_cuts(ends_a, ends_b):
            groups.append(",".join(map(str, ids_a[i:i_end])) + "|" + ",".join(map(str, ids_b[j:j_end])))
            links.append(ids_a[i_end - 1] << 32 | ids_b[j_end - 1])
            i, j = i_end, j_end
        return ";".join(groups).encode(), links

    def texts(self, texts: list[str]) -> Iterator[tuple[int, int, bytes, bytes] | None]:
        """Per text the tokens of A and of B, its groups as text and its links' numbers as 32-bit integers; None for one without tokens."""
        cut = [UNITS.findall(f" {t}") if t else [] for t in texts]
        before = self.known
        fresh = self.learn({u for own in cut for u in own}.difference(before))
        for own in cut:
            found = [before[u] if u in before else fresh[u] for u in own]
            if not found or None in found:
                yield None
            else:
                n_a, n_b, groups, links = zip(*found)
                yield sum(n_a), sum(n_b), b";".join(groups), b"".join(links)


def aligner_of(path_a: str, path_b: str) -> Aligner:
    """One per Python worker, so that a worker's next task starts with filled caches."""
    return of_worker(Aligner, path_a, path_b)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS))


def align_documents(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", with_groups: bool = True) -> DataFrame:
    """Each row with its columns and ``n_a``, ``n_b``, ``groups`` (``a1,a2|b1;a3|b2,b3``; left out on demand), ``groups_sha256``, and ``links``: the pair number of each group's last tokens, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        for whole in batches:
            for batch in by_size(whole, TEXTS, BATCH_BYTES):
                rows = [x or (0, 0, b"", b"") for x in aligner.texts(batch.column(batch.num_columns - 1).to_pylist())]
                n_a, n_b, groups, links = map(list, zip(*rows))
                ends = np.cumsum([0, *map(len, links)]) // 4
                numbers = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(links), "<i4")))
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                told = [pa.array([g.decode() for g in groups], pa.string())] if with_groups else []
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), *told, pa.array(digests, pa.string()), numbers], names=names)

    kinds = {"n_a": LongType(), "n_b": LongType()} | ({"groups": StringType()} if with_groups else {}) | {"groups_sha256": StringType(), "links": ArrayType(IntegerType())}
    schema = StructType([*docs.schema.fields, *[StructField(n, t) for n, t in zip(free_names(docs, *kinds), kinds.values())]])
    names = schema.names
    return docs.select(*numbered(docs), text_of(text_col).alias("body")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(pair, n): links per pair number over all rows; each task counts its own before the shuffle."""
    pairs = len(aligner_of(path_a, path_b).pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_worker()  # the units' caches
        counts = np.zeros(pairs, np.int64)
        for batch in slices(batches):
            numbers = batch.column(0).flatten().to_numpy()
            counts += np.bincount(numbers, minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], names=["pair", "n"])

    return aligned.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def pair_table(spark: SparkSession, counts: DataFrame, path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray]:
    """By pair number its links and whether no pair of its B id has more. Bounded by the vocabularies."""
    pairs = aligner_of(path_a, path_b).pairs
    found = counts.toArrow()
    n = np.zeros(len(pairs), np.int64)
    n[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    b = pairs & 0xFFFFFFFF
    most = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, b, n)
    return n, (n == most[b]) & (n > 0)


def scored(aligned: DataFrame, sent: Broadcast) -> DataFrame:
    """``links`` of each row as ``n_links``, ``n_best`` and ``count_sum``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_worker()
        counts, best = sent.value
        for batch in slices(batches):
            links = batch.column(batch.num_columns - 1)
            numbers, ends = links.flatten().to_numpy(), np.r_[0, np.cumsum(pc.list_value_length(links).to_numpy())]
            sums = lambda x: np.diff(np.r_[0, np.cumsum(x, dtype=np.int64)][ends])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(ends)), pa.array(sums(best[numbers])), pa.array(sums(counts[numbers]))], names=names)

    kept = [f for f in aligned.schema.fields if f.name != "links"]
    schema = StructType([*kept, *[StructField(n, LongType()) for n in ("n_links", "n_best", "count_sum")]])
    names = schema.names
    return aligned.select(*[f.name for f in kept], "links").mapInArrow(run, schema)


def alignment_report(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair is the most frequent of its B id), ``count_sum``, ``groups_sha256``."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body_text"))
    aligned = stage_table(spark, align_documents(own, path_a, path_b, "body_text", with_groups=False).drop("body_text"), "alignment")
    sent = spark.sparkContext.broadcast(pair_table(spark, pair_counts(aligned, path_a, path_b), path_a, path_b))
    out = scored(aligned, sent)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")
