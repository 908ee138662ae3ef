"""SentencePiece encoding and decoding with the N best segmentations.

The piece lattice of a text has a node per character position and an edge per piece of the vocabulary that
stands there, weighted with the piece's score in the model file; characters that no piece covers get their
UTF-8 bytes as byte pieces. A forward Viterbi pass gives every position's best score from the left, and the edge it
came by. Those scores are exact heuristics for a backward A-star search from the end: a partial path from the right is
ranked by its own score plus the best score of the rest. As the ranks are exact, a path goes straight back along the
forward pass's edges at no loss, so the queue only needs the edges that leave it, and of those only as many as
segmentations are still wanted. Edges are looked up when the search comes by; memory is two numbers a character.

If no piece has a line end, or a space mark after another character, every word (with the marks before it) is a
lattice of its own and the text's lattice is their chain. Likewise a word is cut between a letter and a punctuation mark that no
piece has behind a letter. A short word is searched once while it stays in a
Python worker's cache, which lasts from task to task and is bounded. The best segmentation of a text joins its words'
best; the N best of the text follow from the words whose second best costs least, by the same best-first search over
how many steps each word goes down. With any other vocabulary the whole text is one word.
Segmentations 2 to N are given as changes to the best: the pieces from ``start`` on, ``length`` of them, become ``ids``.

Text is prepared with a space mark in front, spaces as marks, nothing removed or folded; a model whose flags ask for something else is
refused. Decoding joins the pieces, reads byte pieces as UTF-8 and takes the first mark off: it gives back every text, but for a mark in
the text itself, which reads as a space; ``decoded`` is false for such a text.

Nulls: a null text counts as empty; an empty text has no pieces and one segmentation of score 0. Repeated rows
each get a row. A very long text, or one long word, is one lattice, held once. An empty table gives an empty result.
Other columns are kept by ``encode_documents``; where one has the name of an added column, the added one gets ``_``
behind its name.
"""

from __future__ import annotations

import heapq
import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from .common import free_names, numbered, of_worker, text_of

NBEST = 3
MARK = "▁"
#: Words whose segmentations a worker keeps in use; as many from before stay at hand.
CACHE = 5 << 16
#: Texts whose new words are segmented together.
TEXTS = 512
#: A word of more characters isn't kept.
SHORT = 64
ENCODED = StructType().add("piece_ids", ArrayType(IntegerType())).add("best_score", DoubleType()).add("nbest_losses", ArrayType(DoubleType())).add("decoded", BooleanType())
#: Per segmentation from the second best on, the words in which it differs from the best.
CHANGES = ArrayType(ArrayType(StructType().add("start", IntegerType()).add("length", IntegerType()).add("ids", ArrayType(IntegerType()))))
CHANGES_ARROW = pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])))
#: Texts that only come back if the model's flags are the supported ones: spaces at the ends and in runs, characters that normalisation folds.
PROBES = ("x", "  a  b ", "\n c\t", "\uff21\ufb01\u00e9e\u0301\u00bd\u3000")
CHUNKS = " +[^ \n]*|\n+|[^ \n]+"


class Lattice:
    """Segments words into piece ids; ``scores`` and ``ids`` come from the model file."""

    def __init__(self, model_path: str, nbest: int = NBEST, cache: int = CACHE):
        import sentencepiece

        self.cache = cache

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if any(model.decode(model.encode(t)) != t or model.encode(t, out_type=str)[0][:1] != MARK for t in PROBES):
            raise ValueError("the model must put a mark in front, remove no white space and fold no character")
        n = model.get_piece_size()
        self.nbest, self.texts, self.bytes = nbest, [model.id_to_piece(i) for i in range(n)], {}
        scores = [model.get_score(i) for i in range(n)]
        self.ids = {}
        for i, piece in enumerate(self.texts):
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
        self.weigh(scores)

    def weigh(self, scores: list[float]) -> None:
        """Take ``scores`` by piece id, as they are in the model file or others."""
        #: Piece to (score, ids).
        self.pieces = {p: (scores[i], (i,)) for p, i in self.ids.items()}
        self.longest = max(map(len, self.pieces), default=1)
        #: Nested by character; "" holds the score of the piece that ends there.
        self.trie: dict = {}
        #: The same flat: edges as node << 21 | character, sorted, with the nodes they lead to; pieces and scores by node.
        edges, nodes, ends = {}, [self.trie], {}
        for p, i in self.ids.items():
            node, at = self.trie, 0
            for c in p:
                if c not in node:
                    node[c] = {}
                    edges[at << 21 | ord(c)] = len(nodes)
                    nodes.append(node[c])
                node, at = node[c], edges[at << 21 | ord(c)]
            node[""] = scores[i]
            ends[at] = i
        self.edges = np.array(sorted(edges), np.int64)
        self.targets = np.array([edges[k] for k in sorted(edges)], np.int64)
        self.node_piece, self.node_score = np.full(len(nodes), -1, np.int32), np.full(len(nodes), -np.inf)
        for at, i in ends.items():
            self.node_piece[at], self.node_score[at] = i, scores[i]
        #: Below any piece's score, so that bytes are used only where no piece covers a character.
        self.byte_score = min(scores) - 10.0
        self.by_words = not any("\n" in p or MARK in p.lstrip(MARK) for p in self.ids)
        behind = {b for p in self.ids for a, b in zip(p, p[1:]) if a.isalpha()}
        apart = "".join(re.escape(c) for c in string.punctuation if c not in behind and c != MARK)
        self.cut = re.compile(rf" *[^ \n{apart}]++(?<=[^\W\d_])(?=[{apart}])|{CHUNKS}" if apart else CHUNKS).findall
        #: Words in use, and those from before they last filled up.
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.ladders: dict[str, list[tuple[float, tuple[int, ...]]]] = {}

    def forward(self, word: str) -> tuple:
        """Best score of each position from the left, and where the edge it came by starts."""
        n = len(word)
        best, back = [-np.inf] * (n + 1), [0] * (n + 1)
        if n > SHORT:
            best, back = array("d", best), array("q", back)
        best[0] = 0.0
        root, pieces = self.trie, self.pieces
        for a in range(n):
            node, base, b = root, best[a], a
            while b < n:
                node = node.get(word[b])
                if node is None:
                    break
                b += 1
                if "" in node:
                    score = base + node[""]
                    if score > best[b]:
                        best[b], back[b] = score, a
            if word[a] not in pieces:
                score = base + self.byte_score * len(word[a].encode("utf-8", "replace"))
                if score > best[a + 1]:
                    best[a + 1], back[a + 1] = score, a
        return best, back

    def edge(self, word: str, a: int, b: int) -> tuple[float, tuple[int, ...]] | None:
        """(score, ids) of the piece from ``a`` to ``b``, or of the bytes of a character that isn't one."""
        found = self.pieces.get(word[a:b])
        if found is None and b == a + 1:
            data = word[a].encode("utf-8", "replace")
            return self.byte_score * len(data), tuple([self.bytes[x] for x in data])
        return found

    def leaving(self, word: str, best, back, at: int) -> Iterator[tuple[float, int, int]]:
        """(loss, node, start) of the edges that leave the way straight back from ``at``."""
        pieces, longest = self.pieces, self.longest
        while at:
            low, on, top = at - longest, back[at], best[at]
            for a in range(at - 1, low - 1 if low > 0 else -1, -1):
                if a != on:
                    own = pieces.get(word[a:at])
                    if own is not None:
                        yield top - best[a] - own[0], at, a
            at = on

    def search(self, word: str) -> list[tuple[float, tuple[int, ...]]]:
        """(loss, ids) of the N best segmentations, best first.

        A path is the edges by which it leaves the way straight back, in order from the end. Its successors leave it
        nearer to the start than it last left; ties go to the path that was queued first.
        """
        best, back = self.forward(word)
        out: list[tuple[float, tuple[int, ...]]] = []
        heap, count = [(0.0, 0, ())], 0
        while heap and len(out) < self.nbest:
            loss, _, left = heapq.heappop(heap)
            out.append((loss, self.along(word, back, left)))
            start = left[-1][1] if left else len(word)
            for more, at, a in heapq.nsmallest(self.nbest - len(out), self.leaving(word, best, back, start)):
                count += 1
                heapq.heappush(heap, (loss + more, count, (*left, (at, a))))
        return out

    def along(self, word: str, back, left: tuple[tuple[int, int], ...]) -> tuple[int, ...]:
        at, parts, leaves = len(word), [], dict(left)
        while at:
            a = leaves.get(at, back[at])
            parts.append(self.edge(word, a, at)[1])
            at = a
        return tuple([i for p in reversed(parts) for i in p])

    def word(self, word: str) -> tuple:
        """(ids as bytes, best score, loss of the second best or infinity, the word): the search's first path, and the least loss that leaves it."""
        best, back = self.forward(word)
        loss = min((x for x, _, _ in self.leaving(word, best, back, len(word))), default=np.inf)
        return array("i", self.along(word, back, ())).tobytes(), best[-1], loss, word

    def many(self, words: list[str]) -> list[tuple]:
        """``word`` of many short words at once, in arrays; those with a character that is no piece go one by one."""
        out: list = [None] * len(words)
        other = set("".join(words)).difference(self.pieces)
        odd = re.compile("[" + "".join(map(re.escape, sorted(other))) + "]").search if other else lambda w: None
        whole = [i for i, w in enumerate(words) if len(w) <= SHORT and odd(w) is None]
        own = set(whole)
        for i, w in enumerate(words):
            if i not in own:
                out[i] = self.word(w)
        if not whole:
            return out
        # Nodes of all lattices in one row: word after word, a node per position and one for the end.
        texts = [words[i] for i in whole]
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        zero = np.r_[0, np.cumsum(n + 1)]
        first, end = zero[:-1], zero[1:] - 1
        chars = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), "<u4").astype(np.int64)
        chars[end] = 0
        at, node = np.flatnonzero(chars), np.zeros(int((chars > 0).sum()), np.int64)
        starts, stops, pieces = [], [], []
        for k in range(self.longest):
            key = node << 21 | chars[at + k]
            place = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            there = self.edges[place] == key
            at, node = at[there], self.targets[place[there]]
            found = self.node_piece[node] >= 0
            starts.append(at[found])
            stops.append(at[found] + k + 1)
            pieces.append(node[found])
            more = chars[at + k + 1] > 0
            at, node = at[more], node[more]
            if not len(at):
                break
        start, stop, node = map(np.concatenate, (starts, stops, pieces))
        score, piece = self.node_score[node], self.node_piece[node]
        # Forward: by place in the word and length, so that the edges of one step end in different nodes.
        place = start - np.repeat(first, n + 1)[start]
        group = place * (self.longest + 1) + stop - start
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        best, back, by = np.full(len(chars), -np.inf), np.zeros(len(chars), np.int64), np.zeros(len(chars), np.int32)
        best[first] = 0.0
        for part in np.split(order, cuts):
            a, b = start[part], stop[part]
            value = best[a] + score[part]
            better = value > best[b]
            b, part = b[better], part[better]
            best[b], back[b], by[b] = value[better], a[better], piece[part]
        # Backward: the nodes on each best way, and the least loss of an edge that leaves it there.
        on, now = np.zeros(len(chars), bool), end[n > 0]
        begins = np.zeros(len(chars), bool)
        begins[first] = True
        while len(now):
            on[now] = True
            now = back[now]
            now = now[~begins[now]]
        leaves = np.flatnonzero(on[stop] & (back[stop] != start))
        loss = np.full(len(texts), np.inf)
        np.minimum.at(loss, (np.searchsorted(zero, stop[leaves], side="right") - 1), best[stop[leaves]] - best[start[leaves]] - score[leaves])
        ids = by[on].astype("<i4").tobytes()
        upto = np.cumsum(np.r_[0, on])[np.r_[first, len(chars)]] * 4
        upto = upto.tolist()
        for k, (i, w, x, y) in enumerate(zip(whole, texts, best[end].tolist(), loss.tolist())):
            out[i] = ids[upto[k] : upto[k + 1]], x, y, w
        return out

    def ladder(self, word: str) -> list[tuple[float, tuple[int, ...]]]:
        """The word's N best; asked for few words of a text."""
        found = self.ladders.get(word)
        if found is None:
            found = self.search(word)
            if len(word) <= SHORT:
                if len(self.ladders) > self.cache:
                    self.ladders = {}
                self.ladders[word] = found
        return found

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        text = " " + (text.replace(MARK, " ") if MARK in text else text)
        return self.cut(text) if self.by_words else [text]

    def learn(self, chunked: list[list[str]]) -> dict[str, tuple]:
        """The words of texts that aren't in use yet; the short ones stay."""
        new = {c for chunks in chunked for c in chunks}.difference(self.known)
        if len(self.known) + len(new) > self.cache:
            self.known, self.older = {}, self.known
        found = {c: own for c in new if (own := self.older.get(c)) is not None}
        rest = list(new.difference(found)) if found else list(new)
        found.update(zip(rest, self.many([c.replace(" ", MARK) for c in rest])))
        self.known.update((c, own) for c, own in found.items() if len(c) <= SHORT)
        return found

    def segmentations(self, texts: list[str]) -> Iterator[tuple[bytes, float, list[float], list[list[tuple[int, int, tuple[int, ...]]]]]]:
        """Per text the ids of the best segmentation as 32-bit integers, its score, the losses of the N best (the first is 0),
        and for the second best and on the changes (start, length, ids) to the best one's pieces, in order."""
        chunked = [self.chunks(t) for t in texts]
        before = self.known
        new = self.learn(chunked)
        for chunks in chunked:
            words = list(map(before.get, chunks))
            if None in words:
                words = [new[c] if own is None else own for c, own in zip(chunks, words)]
            yield self.joined(words)

    def joined(self, words: list[tuple]) -> tuple[bytes, float, list[float], list[list[tuple[int, int, tuple[int, ...]]]]]:
        if not words:
            return b"", 0.0, [0.0], []
        ids, scores, losses, names = zip(*words)
        found, steps, places = self.losses(losses, names)
        spans = [(sum(map(len, ids[:at])) // 4, len(ids[at]) // 4) for at in places]
        changes = [sorted((*spans[k], self.ladder(names[places[k]])[n][1]) for k, n in enumerate(down) if n) for down in steps[1:]]
        return b"".join(ids), sum(scores), found, changes

    def losses(self, first: tuple[float, ...], names: tuple[str, ...]) -> tuple[list[float], list[tuple[int, ...]], list[int]]:
        """Losses of the N best, the steps down of each, and the places of the words that step.

        Only the words with the least first losses can differ in the N best.
        """
        ladders, places, at = [], [], -1
        for i, loss in enumerate(least := sorted(first)[: self.nbest - 1]):
            at = first.index(loss, at + 1 if i and least[i - 1] == loss else 0)
            if loss < np.inf:
                ladders.append([x for x, _ in self.ladder(names[at])])
                places.append(at)
        out, taken, heap, seen = [], [], [(0.0, (0,) * len(ladders))], set()
        while heap and len(out) < self.nbest:
            loss, steps = heapq.heappop(heap)
            out.append(loss)
            taken.append(steps)
            for k, ladder in enumerate(ladders):
                nxt = (*steps[:k], steps[k] + 1, *steps[k + 1 :])
                if nxt[k] < len(ladder) and nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (sum([ladders[j][n] for j, n in enumerate(nxt)]), nxt))
        return out, taken, places


def lattice_of(model_path: str, nbest: int = NBEST, cache: int = CACHE) -> tuple[Lattice, Decoder]:
    """One per Python worker, so that a worker's next task starts with a filled cache."""
    return of_worker(lattice_and_decoder, model_path, nbest, cache)


def lattice_and_decoder(model_path: str, nbest: int, cache: int) -> tuple[Lattice, Decoder]:
    lattice = Lattice(model_path, nbest, cache)
    return lattice, Decoder(lattice)


class Decoder:
    """Ids to the text's bytes, by joining the pieces' bytes."""

    def __init__(self, lattice: Lattice):
        own = [t.encode().replace(MARK.encode(), b" ") for t in lattice.texts]
        for b, i in lattice.bytes.items():
            own[i] = bytes([b])
        self.pieces = own

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))[1:]

    def alike(self, ids: np.ndarray, changes: list[list[tuple]]) -> bool:
        """Whether every change reads as the pieces that it replaces, so that its segmentation decodes as the best does."""
        read = self.pieces.__getitem__
        return all(b"".join(map(read, new)) == b"".join(map(read, ids[at : at + n].tolist())) for one in changes for at, n, new in one)


def list_array(parts: list[bytes]) -> pa.Array:
    lengths = np.fromiter((len(p) // 4 for p in parts), np.int64, len(parts))
    values = pa.array(np.frombuffer(b"".join(parts), "<i4"))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), values)


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text", nbest: int = NBEST, with_changes: bool = False, cache: int = CACHE) -> DataFrame:
    """Each row with its columns and ``piece_ids``, ``best_score``, ``nbest_losses``, ``decoded`` (whether decoding any of the N best gives the text back).

    If asked for, with ``nbest_changes``: what segmentations 2 to N have in place of the best one's pieces. ``cache`` bounds the words that
    a Python worker keeps in use; fewer take more time and less memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, decoder = lattice_of(model_path, nbest, cache)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                ids, scores, losses, same, changes = [], [], [], [], []
                texts = batch.column(batch.num_columns - 1).to_pylist()
                for text, (found, score, loss, change) in zip(texts, lattice.segmentations(texts)):
                    own = np.frombuffer(found, "<i4")
                    ids.append(found)
                    scores.append(score)
                    losses.append(loss)
                    changes.append([[{"start": a, "length": n, "ids": new} for a, n, new in one] for one in change])
                    same.append(decoder.decode(own) == text.encode("utf-8", "replace") and decoder.alike(own, change))
                columns = [*batch.columns[:-1], list_array(ids), pa.array(scores, pa.float64()), pa.array(losses, pa.list_(pa.float64())), pa.array(same, pa.bool_())]
                if with_changes:
                    columns.append(pa.array(changes, CHANGES_ARROW))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    made = [*ENCODED.fields, *([StructField("nbest_changes", CHANGES)] if with_changes else [])]
    added = [StructField(name, f.dataType) for f, name in zip(made, free_names(docs, *(f.name for f in made)))]
    rows = docs.select(*numbered(docs), text_of(text_col).alias("body"))
    schema = StructType([*docs.schema.fields, *added])
    names = schema.names
    return rows.mapInArrow(run, schema)


def encoding_report(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", nbest: int = NBEST) -> DataFrame:
    """Per row: id, ``n_pieces``, ``ids_crc32`` (of the ids as 32-bit integers), ``best_score``, ``nbest_losses``, ``decoded``, ``nbest_changes``."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b].astype("<i4").tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64()), *batch.columns[2:]], names=["id", "n_pieces", "ids_crc32", "best_score", "nbest_losses", "decoded", "nbest_changes"])

    made = encode_documents(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text")), model_path, "_text", nbest, True)
    found = made.select("id", "piece_ids", "best_score", "nbest_losses", "decoded", "nbest_changes").mapInArrow(digests, f"id long, n_pieces long, ids_crc32 long, best_score double, nbest_losses array<double>, decoded boolean, nbest_changes {CHANGES.simpleString()}")
    return found.withColumnRenamed("id", id_col)
