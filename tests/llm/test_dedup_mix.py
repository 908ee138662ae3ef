"""Exact dedup, mixing, SimHash and the pipeline against brute force."""

import hashlib
import itertools
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql.types import LongType, StringType, StructField, StructType

import corpus_pipeline
from chunkmill.llm import exact_dedup, mixing, quality, simhash
from chunkmill.llm.radix_trie import RadixTrie

SPACE = re.compile("[\x20\x09-\x0d]+")
WORD = re.compile("[^\x20\x09-\x0d]+")


def order(row):
    return tuple((x is not None, x) for x in row)


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        sha, keep = hashlib.sha256(text.encode()).hexdigest(), min((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = i == keep and left > 0
            left -= kept
            out.append((i, keep, len(ids), kept, sha))
    return out


@pytest.mark.parametrize("memory", [1 << 12, 96 << 20])
def test_exact_dedup(spark, odd_docs, sample, no_docs, memory):
    for docs in (odd_docs, sample):
        want = brute_exact([(r.doc_id, r.text) for r in docs.collect()])
        assert sorted(map(tuple, exact_dedup.exact_dedup(docs, memory_bytes=memory).collect()), key=order) == sorted(want, key=order)
    assert exact_dedup.exact_dedup(no_docs).collect() == []
    kept = exact_dedup.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    found, want = kept.collect(), [r for r in brute_exact([(r.doc_id, r.text) for r in odd_docs.collect()]) if r[3]]
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in found) == sorted((r[0] is not None, r[0] or 0) for r in want)


def test_trie_spills_and_merges():
    rng = np.random.default_rng(0)
    keys = [bytes(rng.integers(0, 3, rng.integers(0, 40), dtype=np.uint8)) for _ in range(4000)] + [b"same prefix " * 30 + bytes([i % 7]) for i in range(500)]
    trie = RadixTrie(lambda a, b: (a[0], a[1] + b[1]), 20_000)
    for k in keys:
        trie.insert(k, (k, 1))
    assert trie.spills > 0
    found = Counter()
    for k, n in trie.items():
        assert k not in found
        found[k] = n
    assert found == Counter(keys)


def hashed(kind, value, seed=42):
    return xxhash.xxh64_intdigest(struct.pack(kind, value), seed)


def brute_targets(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * size[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        free -= over
    return target, {s: i + 1 for i, s in enumerate(names)}


def salted(docs):
    return docs.select("doc_id", "source", "text", mixing.salt("doc_id", "text").alias("salt")).collect()


def brute_mix(rows):
    """Rows (id, source, text, salt) to (id, size, source_size, target, taken)."""
    sized = [(i, s, len(WORD.findall(t or "")), salt) for i, s, t, salt in rows]
    size = Counter()
    for _, s, n, _ in sized:
        size[s] += n
    target, rank = brute_targets(size)
    place_of = lambda x: (c if x[3] % 2 == 0 else mixing.LAST_PLACE - c) if (c := int(np.floor(np.log2(x[2] + 1) * mixing.CLASSES))) is not None else 0
    rows_in = Counter((x[1], place_of(x)) for x in sized)
    out = []
    for s in size:
        seeded = hashed("<i", rank[s], hashed("<i", mixing.SEED))
        upto = (seeded - (1 << 64) * (seeded >> 63)) % (1 << 20) / float(1 << 20)
        large = lambda x: x[2] * mixing.LARGE > size[s]

        def order_of(x):
            place = place_of(x)
            parts = -(-rows_in[s, place] // mixing.BLOCK_ROWS)
            place = max(place, mixing.LAST_PLACE - place) if large(x) else place
            return (not large(x), place, (x[3] >> 1) % parts, x[2] if place < mixing.LAST_PLACE // 2 else -x[2], x[0] is not None, x[0] or 0)

        own = sorted((x for x in sized if x[1] == s), key=order_of)
        goal = target[s] if size[s] else 0.0
        words, left, n = goal, size[s], 0
        for x in own:
            if n == 0:
                rate, start = min(max(words / left, 0.0), 3.0) if left else 0.0, upto
            n += not large(x)
            upto, last = (start + rate, upto) if large(x) else (start + n * rate, start + (n - 1) * rate)
            copies = min(int(np.floor(upto) - np.floor(last)), 3)
            if large(x):
                words, left = words - copies * x[2], left - x[2]
            out.append((x[0], x[2], size[s], goal, copies * x[2]))
    return out


def near(rows):
    return sorted(((*r[:3], round(r[3], 6), r[4]) for r in map(tuple, rows)), key=order)


@pytest.mark.parametrize("block_rows, large", [(4096, 1024), (3, 1024), (3, 8), (4096, 1)])
def test_mix(spark, odd_docs, sample, no_docs, monkeypatch, block_rows, large):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(mixing, "LARGE", large)
    small = spark.createDataFrame([(i, f"s{min(i, 3)}", "w " * (1 if i < 3 else 200)) for i in range(40)], "doc_id long, source string, text string")
    for docs in (odd_docs, sample, small):
        found = mixing.mix(spark, docs)
        want = brute_mix(map(tuple, salted(docs)))
        assert near(found.select("doc_id", "size", "source_size", "target", "taken").collect()) == near(want)
        assert near(found.select("doc_id", "size", "source_size", "target", "taken").collect()) == near(want)
        assert all(r.taken <= 3 * r.size for r in found.collect())
        made = mixing.mixed_documents(spark, docs)
        assert made.columns == docs.columns and made.count() == sum(r.copies for r in found.collect())
    capped = {r.source_size: r.target for r in mixing.mix(spark, small).collect()}
    assert capped[1] == 3.0
    assert mixing.mix(spark, no_docs).collect() == []


def test_mix_comes_near_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = mixing.mix(spark, docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] / r["max(target)"] - 1) < 0.01 for r in found)


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, fps):
    at = np.array(fps, np.uint64)
    label = list(range(len(at)))
    todo = set(label)
    out = [None] * len(at)
    while todo:
        group, front = set(), [todo.pop()]
        while front:
            x = front.pop()
            group.add(x)
            new = [j for j in np.flatnonzero(np.bitwise_count(at ^ at[x]) <= 2).tolist() if j in todo]
            todo -= set(new)
            front += new
        low = min((ids[j] for j in group if ids[j] is not None), default=None)
        for j in group:
            out[j] = low
    return out


def test_simhash(spark, odd_docs, sample, no_docs):
    for docs in (odd_docs, sample):
        rows = docs.collect()
        fps = [brute_fingerprint(r.text) for r in rows]
        want = [(r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components([r.doc_id for r in rows], fps))]
        assert sorted(map(tuple, simhash.simhash_components(spark, docs).collect()), key=order) == sorted(want, key=order)
    assert simhash.simhash_components(spark, no_docs).collect() == []
    kept = simhash.one_of_each(spark, odd_docs)
    assert kept.columns == odd_docs.columns


def test_one_of_each_component_with_null_and_repeated_ids(spark):
    texts = [f"{w} only words of {w} stand in {w}" for w in ("apple", "birch", "cedar", "daisy", "elder")]
    rows = [(None, t, i) for i, t in enumerate(texts[:3])] + [(7, texts[3], 3), (7, texts[4], 4), (8, texts[3], 5), (None, texts[4], 6), (-(2**63), "zinnia", 7), (None, None, 8), (None, "", 9)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, n int")
    assert len(set(brute_components([1, 2, 3, 4, 5], [brute_fingerprint(t) for t in texts]))) == 5
    kept = simhash.one_of_each(spark, docs).collect()
    assert sorted((r.n for r in kept if r.n < 8)) == [0, 1, 2, 3, 4, 7]
    assert sum(r.n >= 8 for r in kept) == 1 and len(kept) == 7


def test_mixed_documents_follow_the_decision_on_each_row(spark):
    rows = [(None if i % 2 else 5, "w " * (1 + i % 7) + f"x{i % 11}", ("a", "b", None)[i % 3]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = Counter()
    for r in mixing.mixed_documents(spark, docs).collect():
        found[r.doc_id, r.source, len(r.text.split())] += 1
    want = Counter()
    sources = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("a", "b", None)}
    assert len(set(sources.values())) == 3  # a decision's source is told by its size
    for r in mixing.mix(spark, docs).collect():
        want[r.doc_id, next(s for s, n in sources.items() if n == r.source_size), r.size] += r.copies
    assert found == +want


#: Names that the operators use inside, and one with a dot.
INNER = "row key sha owned keep order nth id body doc_nth taken_key copies row_key fp low root no_id salt place sub size score a.b KEY_ piece_ids".split()


def test_stages_keep_columns_of_any_name(spark):
    rows = [(i, f"some words of text {i % 7} " * 9, f"s{i % 2}", *[f"{n}{i}" for n in INNER]) for i in range(30)]
    docs = spark.createDataFrame(rows, StructType([StructField("doc_id", LongType()), *[StructField(n, StringType()) for n in ["text", "source", *INNER]]]))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    given = {tuple(r) for r in docs.collect()}
    for made in (exact_dedup.drop_copies(docs), simhash.one_of_each(spark, docs), mixing.mixed_documents(spark, docs), quality.good_documents(spark, docs, labels)):
        found = [tuple(r) for r in made.collect()]
        assert made.columns == docs.columns and set(found) <= given
    assert exact_dedup.drop_copies(docs).count() == 7 and exact_dedup.exact_dedup(docs).count() == 30 and mixing.mix(spark, docs).count() == 30


def test_anchors_lose_no_link():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 300, dtype=np.uint64)
    x[:20] = simhash.anchors(x[:20])[1][:20]  # words of the code, too
    for a, b in itertools.combinations(range(64), 2):
        y = x ^ np.uint64(1 << a) ^ np.uint64(1 << b)
        i, j = a * 64 + b, (a * 64 + b) % 300
        own = set(simhash.anchors(x[j : j + 1])[1].tolist())
        assert own & set(simhash.anchors(y[j : j + 1])[1].tolist()) and len(own) <= 32, i


def test_dense_group_of_fingerprints(spark):
    rng = np.random.default_rng(5)
    near = np.unique(np.array([0x0123456789ABCDEF ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(3000)], np.uint64))
    rows = spark.createDataFrame([(int(x),) for x in near.view(np.int64)], "fp long")
    spread = rows.mapInArrow(simhash.replicate, "anchor long, fp long").repartition(8, "anchor").sortWithinPartitions("anchor", "fp")
    roots = {r.node: r.root for r in simhash.components(spark, spread.mapInArrow(simhash.compare, "u long, v long")).collect()}
    want = brute_components(near.view(np.int64).tolist(), near.tolist())
    assert all(roots.get(x, x) == w for x, w in zip(near.view(np.int64).tolist(), want))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1002, 1001), (1002, 1002)], "u long, v long")
    found = {r.node: r.root for r in simhash.components(spark, edges).collect()}
    assert found == {i: 0 for i in range(301)} | {i: 1000 for i in (1000, 1001, 1002)}


def test_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    model = quality.fit(spark, docs, labels)
    rows = [r for r, p in zip(rows, quality.scores(model, [(r[2] or "").encode() for r in rows])) if p >= quality.THRESHOLD]
    kept = {r[0] for r in brute_exact([(i, t) for i, _, t in rows]) if r[3]}
    rows = [r for r in rows if r[0] in kept]
    roots = brute_components([r[0] for r in rows], [brute_fingerprint(r[2]) for r in rows])
    rows = [r for r, c in zip(rows, roots) if r[0] == c]
    salts = {r.doc_id: r.salt for r in salted(docs)}
    want = Counter({i: taken // size for i, size, _, _, taken in brute_mix([(*r, salts[r[0]]) for r in rows]) if taken})
    found = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in found) == +want and all(r.decoded for r in found)
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier"
