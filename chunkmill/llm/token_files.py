"""Token-ID output: flat files of unsigned integers, with 64-bit document offsets, read back memory-mapped.

Documents are dealt out by ranges of the identifier and sorted, so partition after partition holds them in
order. A task encodes its documents and writes one shard, named by its partition's number: ``<name>.ids``, the ids of
all its documents as little-endian unsigned integers (16 bits if every id of the vocabulary fits, else 32), and
``<name>.idx``, the identifiers and the offsets of their ends within the shard as 64-bit integers. Each attempt of a
task writes under a name of its own and gives the shard its name only when both files are whole, so a task that runs
twice replaces equal bytes and leaves no other shard. A running sum over the shards' counts gives each shard's base,
the position of its first id in the whole sequence.

Ranges are cut by identifier, hash of the text and row, so that a repeated or null identifier, however frequent,
spreads over many tasks.

Memory-mapping needs a POSIX path: the shared folder must be a mounted file system (``file:``).

If the tokenizer drops white space and no token spans it (``words_stand_alone`` reads that from its file), a text's
ids are its words' ids in order, and a Python worker encodes each different word once while it stays in its cache,
which lasts from task to task and is bounded; a word of more than ``SHORT`` bytes isn't kept. With any other tokenizer whole texts are encoded.

Nulls: a null text counts as empty and has the end id alone; a null identifier sorts first, and the manifest tells how many a
shard begins with, as the file holds zeros for them. Repeated rows are
documents of their own. A very long text is held once as text and once as ids. An empty table writes no shard and
gives an empty result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from array import array
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, stage_table, text_of

END_ID = 2
#: Different words whose ids a worker keeps in use; as many from before stay at hand.
CACHE_WORDS = 3 << 18
#: Bytes of a kept word.
SHORT = 64
#: The last letter of Latin Extended-A: up to here lower-case letters are composed and lower case is one to one, but for U+0130.
LAST_PLAIN = "\u017f"
#: Ids read at once when a shard is read back.
READ_IDS = 1 << 24
MANIFEST = "shard string, nulls long, documents long, ids long, width int"


def posix_folder(uri: str) -> str:
    at = urlparse(uri)
    if at.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder, got {uri}")
    return at.path


def words_stand_alone(tokenizer) -> bool:
    """Whether encoding words one by one gives a text's ids.

    The normalizers may only compose characters, fold case and fold white space, and the pre-tokenizer must first cut
    by an expression whose matches alone are kept and hold no white space (probed with every white-space byte).
    """
    spec = json.loads(tokenizer.to_str())
    parts = lambda x, name: [] if x is None else x[name] if x["type"] == "Sequence" else [x]
    for n in parts(spec["normalizer"], "normalizers"):
        if n["type"] not in ("NFC", "NFD", "Lowercase") and not (n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " "):
            return False
    first = (parts(spec["pre_tokenizer"], "pretokenizers") or [{"type": ""}])[0]
    if len(parts(spec["pre_tokenizer"], "pretokenizers")) > 2 or first["type"] != "Split" or first["behavior"] != "Removed" or not first["invert"]:
        return False
    if any(t["lstrip"] or t["rstrip"] or t["content"].split() != [t["content"]] for t in spec["added_tokens"]):
        return False
    probe = [f"{a}{w}{b}" for w in " \t\n\x0b\x0c\r" for a in "a1.'" for b in ("b", "2", ",", "s")]
    return all(piece.isspace() is False and len(piece) == 1 for text in probe for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text))


def folded(tokenizer):
    """The tokenizer for words of lower-case letters up to ``LAST_PLAIN``, which its first steps leave as they are: without those steps."""
    from tokenizers import Tokenizer

    spec = json.loads(tokenizer.to_str())
    spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": spec["pre_tokenizer"]["pretokenizers"][1] if spec["pre_tokenizer"]["type"] == "Sequence" else None}
    return Tokenizer.from_str(json.dumps(spec))


class Encoder:
    """Bytes of a text to the bytes of its ids."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.end = np.array([END_ID], self.kind).tobytes()
        self.by_words = words_stand_alone(self.tokenizer)
        self.stops = {s: self.whole(s) for s in (b"", b".", b",", b"!", b"?")} if self.by_words else {}
        self.folded = folded(self.tokenizer) if self.by_words else None
        #: Words and their ids: the ones in use, and those from before it last filled up.
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def whole(self, body: bytes) -> bytes:
        return array(self.code, self.tokenizer.encode(body.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def learn(self, words: set[bytes]) -> None:
        """A word of letters with a stop is cut between them by any such pre-tokenizer, and case is folded anyway, so only lower-case stems are encoded."""
        if len(self.known) + 2 * len(words) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        stems, plain, others = {}, {}, []
        for w in words:
            found = older.get(w)
            if found is not None:
                known[w] = found
                continue
            ended = w[-1:] in self.stops and len(w) > 1
            text = (w[:-1] if ended else w).decode("utf-8", "replace")
            if not text.isalpha() or max(text) > LAST_PLAIN or "\u0130" in text:
                others.append(w)
                continue
            text = text.lower()
            stem = text.encode()
            stems[w] = stem, w[-1:] if ended else b""
            if stem not in known:
                found = older.get(stem)
                if found is None:
                    plain[stem] = text
                else:
                    known[stem] = found
        for names, texts, tokenizer in ((plain, list(plain.values()), self.folded), (others, [w.decode("utf-8", "replace") for w in others], self.tokenizer)):
            for w, e in zip(names, tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                known[w] = array(self.code, e.ids).tobytes()
        for w, (stem, stop) in stems.items():
            known[w] = known[stem] + self.stops[stop]

    def encode(self, body: bytes) -> bytes:
        if not self.by_words:
            return self.whole(body)
        words = body.split()  # of bytes: the six ASCII white-space bytes
        found = list(map(self.known.get, words))
        try:
            return b"".join(found)
        except TypeError:  # some word isn't known
            new = {w for w, ids in zip(words, found) if ids is None}
            long = {w: self.whole(w) for w in new if len(w) > SHORT}
            self.learn(new.difference(long) if long else new)
            known = self.known | long if long else self.known
            return b"".join([known[w] if ids is None else ids for w, ids in zip(words, found)])


@functools.lru_cache(maxsize=2)
def encoder_of(tokenizer_path: str) -> Encoder:
    """One per Python worker and file, so that a worker's next task starts with a filled cache."""
    return Encoder(tokenizer_path)


def write_shards(folder: str, tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = encoder_of(tokenizer_path), TaskContext.get()
        name, own_name = f"{folder}/{task.partitionId():08d}", f"{folder}/.{task.partitionId():08d}-{task.taskAttemptId()}"
        ids, ends, at, nulls, out = [], [], 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                os.makedirs(folder, exist_ok=True)
                out = open(f"{own_name}.ids", "wb")
            for body in batch.column(1):
                found = encoder.encode(body.as_py())
                out.write(found)
                out.write(encoder.end)
                at += len(found) // encoder.kind.itemsize + 1
                ends.append(at)
            nulls += batch.column(0).null_count
            ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        if out is None:
            return
        out.close()
        own = np.concatenate(ids)
        with open(f"{own_name}.idx", "wb") as idx:
            idx.write(own.tobytes())
            idx.write(np.array(ends, "<u8").tobytes())
        for kind in ("ids", "idx"):
            os.replace(f"{own_name}.{kind}", f"{name}.{kind}")
        row = [os.path.basename(name)], [nulls], [len(own)], [at], [encoder.kind.itemsize]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["shard", "nulls", "documents", "ids", "width"])

    return run


def write_token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[DataFrame, str]:
    """Write the shards; the manifest (a row per shard, with ``base``) and the folder."""
    folder = folder or new_folder(spark, "token-files")
    body = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), body.cast("binary").alias("body"), F.xxhash64(body).alias("tie"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange("id", "tie", "row").sortWithinPartitions("id", "tie", "row").select("id", "body")
    shards = stage_table(spark, dealt.mapInArrow(write_shards(posix_folder(folder), tokenizer_path), MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard; partitions are in order of identifiers
    return shards.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))), folder


def read_shards(folder: str):
    """Per document: identifier, position of its first id in the whole sequence, number of ids, checksum of its ids as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, at = row["documents"], f"{folder}/{row['shard']}"
                own, ends = np.memmap(f"{at}.idx", "<i8", "r", 0, n), np.memmap(f"{at}.idx", "<u8", "r", 8 * n, n)
                flat = np.memmap(f"{at}.ids", f"<u{row['width']}", "r")
                ends = ends.astype(np.int64)
                starts = np.r_[0, ends[:-1]]
                for lo in range(0, n, 8192):
                    part = slice(lo, lo + 8192)
                    sums = np.empty(len(ends[part]), np.int64)
                    for i, (a, b) in enumerate(zip(starts[part], ends[part])):
                        crc = 0
                        for x in range(a, b, READ_IDS):
                            crc = zlib.crc32(flat[x : min(b, x + READ_IDS)].astype("<u4").tobytes(), crc)
                        sums[i] = crc
                    id_ = np.asarray(own[part])
                    columns = [pa.array(id_, mask=np.arange(lo, lo + len(id_)) < row["nulls"]), pa.array(starts[part] + row["base"]), pa.array(ends[part] - starts[part]), pa.array(sums)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_files(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the files: id, ``start``, ``n_tokens``, ``ids_crc32``."""
    dealt = manifest.repartition(max(1, manifest.count()))
    return dealt.mapInArrow(read_shards(posix_folder(folder)), "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
