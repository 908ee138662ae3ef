"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, a temperature.

A word is read as up to three features: its letters in lower case, its shape (case, digits, length) and the
symbols at its edges. Features fall into ``BUCKETS`` by hash, so every feature of every corpus has one and the model's
size is fixed. A bucket has a sparse ternary index vector; its context vector is the sum of the index vectors of the
features in the words around it, gathered in tasks over **all** documents; its vector is the index vector plus the
normed context vector. A word is the mean of its features' vectors, which are rounded to whole ``PARTS_OF_ONE``, so that sums agree in
any order. A document is the mean of its words' vectors, once over all occurrences and once over the distinct
words, with the shares of distinct words and of words that repeat the one before.

Only the network is fitted on a bounded sample: at most ``FIT_ROWS`` labelled rows outside the held-out fold, the ones
with the smallest hash. Their texts are read whole, as in scoring, by tasks that hand on pooled vectors; the network's
fit on those runs in the driver and yields a model of fixed size. Scoring reads every whole text. Labels, lang,
source and the identifier are never inputs of a score; the identifier only chooses the fold.

Nulls: a null text counts as empty; an empty text has the zero vector and is scored like any other. Labels that
are null, or that name a document twice with different values, are left out; of several texts of a labelled identifier
the least one is learnt. A null identifier is held out. Without labels of both kinds every score is the share of label
1 (0.5 without labels). With under ``FEWEST`` labelled rows the temperature is 1. Repeated rows each get a row. A very
long text is held once, with a number per word. An empty table gives an empty result. Other columns play no part, and
``good_documents`` keeps them, whatever their names.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, of_worker, stage_table, text_of

FIT_ROWS, FIT_TASKS, FEWEST = 6144, 24, 50
DIMENSIONS, NONZERO, WINDOW, HIDDEN = 32, 4, 2, 32
#: Buckets of a word's letters, of symbols, of shapes.
WIDTHS = {"letters": 12_288, "symbols": 3072, "shape": 1024}
BUCKETS = sum(WIDTHS.values())
#: The bucket of no feature: its vector is zero.
NONE = BUCKETS
#: Parts of a vector's 1; a word's vector is in sixths of them, so that the mean of one to three features is whole.
PARTS_OF_ONE = 1 << 10
SCALE = 6 * PARTS_OF_ONE
THRESHOLD, FOLDS, SEED = 0.3, 5, 8
#: Different words whose buckets a worker keeps; beyond, it starts over. Bytes of a kept one.
CACHE = 3 << 18
SHORT = 64
#: Words whose vectors are gathered at once.
CHUNK = 1 << 14
#: Standard deviations beyond which an input counts as this many.
CLIP = 5

PARTS = re.compile(rb"([^A-Za-z0-9\x80-\xff]*)([A-Za-z0-9\x80-\xff]*)(.*)", re.S)


def letters(x: bytes) -> int:
    return zlib.crc32(x) % WIDTHS["letters"]


def symbols(x: bytes) -> int:
    return WIDTHS["letters"] + zlib.crc32(x) % WIDTHS["symbols"]


def shape(x: bytes) -> int:
    return WIDTHS["letters"] + WIDTHS["symbols"] + zlib.crc32(x) % WIDTHS["shape"]


def features(word: bytes) -> tuple[int, int, int]:
    """Buckets of the letters in lower case, the shape, and the symbols at the edges (first three on either side)."""
    before, core, after = PARTS.match(word).groups()
    if not core:
        return symbols(before[:4]), NONE, NONE
    n = len(core)
    case = b"l" if core.islower() else b"d" if core.isdigit() else b"U" if core.isupper() and n > 1 else b"T" if core.istitle() else b"x"
    own = shape(case + (b"0" if n <= 3 else b"1" if n <= 12 else b"2" if n <= 25 else b"3"))
    return letters(core.lower()), own, symbols(before[:3] + b"\x00" + after[:3]) if before or after else NONE


@functools.lru_cache(maxsize=1)
def index_vectors() -> np.ndarray:
    """Sparse vectors of whole numbers, fixed by the bucket's number: ``NONZERO`` places of +1 or -1. The last one, of no feature, is zero."""
    x = np.arange(BUCKETS, dtype=np.uint64) + np.uint64(SEED << 32)
    out, rows = np.zeros((BUCKETS + 1, DIMENSIONS), np.float32), np.arange(BUCKETS)
    for _ in range(NONZERO):  # the steps of the SplitMix64 generator
        x = x + np.uint64(0x9E3779B97F4A7C15)
        z = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
        out[rows, (z >> np.uint64(1)) % np.uint64(DIMENSIONS)] += np.where(z & np.uint64(1), np.float32(1), np.float32(-1))
    return out


class Words:
    """Numbers of words and the buckets of their features; number 0 is no word. It holds for any model."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.number: dict[bytes, int] = {}
        self.used = 0
        self.keys = np.full((1 << 12, 3), NONE, np.int32)

    def numbers(self, body: bytes) -> np.ndarray:
        words = body.split()
        try:
            return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = set(words).difference(self.number)
            at = self.used + 1
            while at + len(new) > len(self.keys):
                self.keys = np.concatenate([self.keys, np.full_like(self.keys, NONE)])
            self.keys[at : at + len(new)] = list(map(features, new))
            self.number.update(zip(new, range(at, at + len(new))))
            self.used += len(new)
            found = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
            for w in new:
                if len(w) > SHORT:  # its buckets stay until all start over, the word doesn't
                    del self.number[w]
            return found

    def batches(self, bodies: list[bytes]) -> Iterator[list[np.ndarray]]:
        """Numbers of the texts' words, in groups of about ``CHUNK`` words."""
        group, held = [], 0
        for body in bodies:
            if not group and self.used > CACHE:
                self.reset()
            group.append(self.numbers(body))
            held += len(group[-1])
            if held >= CHUNK:
                yield group
                group, held = [], 0
        if group:
            yield group


def words_of_worker() -> Words:
    """One per Python worker, so that its next task starts with known words."""
    return of_worker(Words)


def add_by_key(out: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
    """Add rows of whole numbers, whose sums stay below 2^24 and so are exact as floats, to ``out`` by key; the key of no feature is left out."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    if keys[-1] == NONE:
        n = int(np.searchsorted(keys, NONE))
        order, keys = order[:n], keys[:n]
    if not len(keys):
        return
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    out[keys[starts]] += np.add.reduceat(rows[order], starts, axis=0).astype(out.dtype)


class Contexts:
    """Sums, by bucket, of the index vectors of the features in the words around; whole numbers, so in any order the same."""

    def __init__(self, words: Words):
        self.words, self.index = words, index_vectors()
        self.sums = np.zeros((BUCKETS + 1, DIMENSIONS), np.int64)

    def add(self, bodies: list[bytes]) -> None:
        apart = np.zeros(WINDOW, np.int64)
        for group in self.words.batches(bodies):
            flat = np.concatenate([x for own in group for x in (own, apart)])
            for at in range(0, len(flat), CHUNK):
                low = max(at - WINDOW, 0)
                self.add_run(flat[low : at + CHUNK + WINDOW], at - low, min(CHUNK, len(flat) - at))

    def add_run(self, numbers: np.ndarray, skip: int, n: int) -> None:
        """The words around ``n`` words from ``skip`` on."""
        names, at = np.unique(numbers, return_inverse=True)
        keys = self.words.keys[names]
        run = (self.index[keys[:, 0]] + self.index[keys[:, 1]] + self.index[keys[:, 2]])[at]
        around = np.zeros_like(run)
        for k in range(1, WINDOW + 1):
            around[k:] += run[:-k]
            around[:-k] += run[k:]
        at, around = at[skip : skip + n], around[skip : skip + n]
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
        met = at[order[starts]]
        per_word = np.add.reduceat(around[order], starts, axis=0)
        for own in keys[met].T:
            add_by_key(self.sums, own, per_word)


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Random indexing over ``body``: a bucket's index vector plus the normed sum of those in the words around it, in whole ``PARTS_OF_ONE``.

    Tasks read the texts; only the buckets' sums, of fixed size, come to the driver.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts = Contexts(words_of_worker())
        for batch in batches:
            contexts.add(batch.column(0).to_pylist())
        met = np.flatnonzero(contexts.sums[:NONE].any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array([contexts.sums[i].tobytes() for i in met.tolist()], pa.binary())], names=["bucket", "sums"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(part, np.int64)
                sums[i] = sums[i] + own if i in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["bucket", "sums"])

    schema = "bucket long, sums binary"
    sums = np.zeros((BUCKETS + 1, DIMENSIONS))
    for r in texts.select("body").mapInArrow(gather, schema).repartition("bucket").mapInArrow(add_up, schema).collect():
        sums[r["bucket"]] = np.frombuffer(r["sums"], np.int64)
    return whole_vectors(sums)


def whole_vectors(sums: np.ndarray) -> np.ndarray:
    own = index_vectors() / np.sqrt(NONZERO) + sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)
    return np.rint(own * PARTS_OF_ONE).astype(np.int32)


class Pools:
    """Texts to pooled vectors by the buckets' ``vectors``."""

    def __init__(self, words: Words, vectors: np.ndarray):
        self.words, self.vectors = words, vectors

    def of_words(self, names: np.ndarray) -> np.ndarray:
        keys = self.words.keys[names]
        sixths = np.array([6, 6, 3, 2], np.int32)[(keys != NONE).sum(axis=1)]
        return (self.vectors[keys[:, 0]] + self.vectors[keys[:, 1]] + self.vectors[keys[:, 2]]) * sixths[:, None]

    def pooled(self, bodies: list[bytes]) -> np.ndarray:
        """Per text the mean over occurrences, the mean over distinct words, and the shares of distinct and of repeated words."""
        out = [self.pool(group) for group in self.words.batches(bodies)]
        return np.concatenate(out) if out else np.zeros((0, 2 * DIMENSIONS + 3))

    def pool(self, group: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(group), 2 * DIMENSIONS + 3))
        short = [i for i, x in enumerate(group) if 0 < len(x) < CHUNK]
        for i, x in enumerate(group):
            if len(x) >= CHUNK:  # whole numbers below 2^53, so exact
                names, counts = np.unique(x, return_counts=True)
                total = distinct = np.zeros(DIMENSIONS)
                for at in range(0, len(names), CHUNK):
                    part = self.of_words(names[at : at + CHUNK]).astype(float)
                    total, distinct = total + counts[at : at + CHUNK] @ part, distinct + part.sum(axis=0)
                out[i] = self.joined(total[None], distinct[None], np.array([len(x)]), np.array([len(names)]), np.array([(x[1:] == x[:-1]).sum()]))[0]
        if short:
            n = np.array([len(group[i]) for i in short])
            flat, text = np.concatenate([group[i] for i in short]), np.repeat(np.arange(len(short)), n)
            starts = np.r_[0, np.cumsum(n)[:-1]]
            names, at = np.unique(flat, return_inverse=True)
            rows = self.of_words(names)
            own = np.unique(text * len(names) + at)  # each text's distinct words
            n_own = np.bincount(own // len(names), minlength=len(short))
            again = np.bincount(text[1:][(flat[1:] == flat[:-1]) & (text[1:] == text[:-1])], minlength=len(short))
            distinct = np.add.reduceat(rows[own % len(names)], np.r_[0, np.cumsum(n_own)[:-1]], axis=0)
            out[short] = self.joined(np.add.reduceat(rows[at], starts, axis=0), distinct, n, n_own, again)
        return out

    def joined(self, total, distinct, n, n_distinct, again) -> np.ndarray:
        n, n_distinct = n[:, None].astype(float), n_distinct[:, None].astype(float)
        return np.concatenate([total / n / SCALE, distinct / n_distinct / SCALE, n_distinct / n, again[:, None] / n, np.ones_like(n)], axis=1)


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 60) -> dict[str, np.ndarray]:
    """Two layers by Adam on weighted cross-entropy; the temperature from rows that the weights never saw."""
    rng = np.random.default_rng(SEED)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -CLIP, CLIP)
    order = rng.permutation(len(z))
    apart = order[: len(z) // 5]
    own = order[len(z) // 5 :] if len(z) >= FEWEST else order
    w = {"a": rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "d": np.zeros(1)}
    m, v, step = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}, 0
    share = y[own].mean()
    weight = np.where(y == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
            h = np.tanh(z[part] @ w["a"] + w["b"])
            p = 1 / (1 + np.exp(-(h @ w["c"] + w["d"])))
            g = (p - y[part]) * weight[part] / len(part)
            back = np.outer(g, w["c"]) * (1 - h * h)
            grads = {"a": z[part].T @ back + 1e-4 * w["a"], "b": back.sum(axis=0), "c": h.T @ g + 1e-4 * w["c"], "d": g.sum(keepdims=True)}
            step += 1
            for k, grad in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                w[k] = w[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    if len(z) < FEWEST:
        return w | {"mean": mean, "scale": scale, "t": np.ones(1)}
    logits = np.tanh(z[apart] @ w["a"] + w["b"]) @ w["c"] + w["d"]
    temperatures = np.exp(np.linspace(-1.5, 2.5, 81))
    loss = [np.mean(np.logaddexp(0, -np.where(y[apart] == 1, 1, -1) * logits / t)) for t in temperatures]
    return w | {"mean": mean, "scale": scale, "t": np.array([temperatures[int(np.argmin(loss))]])}


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -CLIP, CLIP)
    logits = (np.tanh(z @ model["a"] + model["b"]) @ model["c"] + model["d"]) / model["t"]
    return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """The model: word vectors of all ``docs``, network, temperature. The network reads at most ``FIT_ROWS`` labelled rows."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_most")).filter("_y = _most")
    order = F.xxhash64(F.lit(SEED), F.col(id_col))
    chosen = known.filter(fold(id_col) != 0).orderBy(order, id_col).limit(FIT_ROWS).select(F.col(id_col).alias("_id"), "_y")
    chosen = stage_table(spark, chosen, "labelled")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    texts = texts.groupBy("_id", "_y").agg(F.min(text_of("_text")).cast("binary").alias("body"))
    texts = stage_table(spark, texts.repartition(FIT_TASKS, "_id"), "labelled-texts")
    y = np.array([r["_y"] for r in texts.select("_id", "_y").orderBy("_id").collect()], float)
    if len(set(y.tolist())) < 2:
        return {"share": float(y.mean()) if len(y) else 0.5}
    vectors = word_vectors(docs.select(text_of(text_col).cast("binary").alias("body")))
    shared = spark.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pools = Pools(words_of_worker(), shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in pools.pooled(batch.column(1).to_pylist())], pa.binary())], names=["_id", "pooled"])

    id_type = texts.schema["_id"].dataType.simpleString()
    pooled = texts.select("_id", "body").mapInArrow(pool, f"_id {id_type}, pooled binary").orderBy("_id").collect()  # FIT_ROWS vectors at most
    return {"vectors": vectors} | fit_network(np.stack([np.frombuffer(r["pooled"]) for r in pooled]), y)


def scores(model, bodies: list[bytes]) -> np.ndarray:
    """Rounded, as products of matrices may differ in the last digits with the number of rows."""
    if "vectors" not in model:
        return np.full(len(bodies), model["share"])
    return np.round(probability(model, Pools(words_of_worker(), model["vectors"]).pooled(bodies)), 9)


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``held_out``, ``score``, ``predicted``."""
    model = spark.sparkContext.broadcast(fit(spark, docs, labels, id_col, text_col))  # of fixed size: BUCKETS x DIMENSIONS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores(model.value, batch.column(2).to_pylist()))], names=["id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(fold(id_col) == 0, F.lit(True)).alias("held_out"), text_of(text_col).cast("binary").alias("body"))
    scored = rows.mapInArrow(run, "id long, held_out boolean, score double")
    return scored.withColumnRenamed("id", id_col).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def good_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are not rejected, with their columns; the texts stay where they are."""
    model = spark.sparkContext.broadcast(fit(spark, docs, labels, id_col, text_col))
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [b"" if t is None else t.encode("utf-8", "replace") for t in batch.column(at).to_pylist()]
            yield batch.rename_columns(names).filter(pa.array(scores(model.value, bodies) >= THRESHOLD, pa.bool_()))

    return docs.select(*numbered(docs)).mapInArrow(run, docs.schema)
