"""Nearest records against brute force, with bounds and several salts, and open metadata."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkmill.operators import chunking, metadata, retrieve
from chunkmill.sources.collection import Collection


@pytest.mark.parametrize("metric", retrieve.METRICS)
@pytest.mark.parametrize("k", [1, 7, 500])
def test_top_k_against_brute_force(spark, monkeypatch, metric, k):
    for name, value in (("RECORD_BLOCK", 20), ("QUERY_CHUNK", 3), ("SALT_BLOCKS", 2), ("FIRST_BLOCKS", 2)):
        monkeypatch.setattr(retrieve, name, value)
    v = np.random.default_rng(3).integers(-3, 4, (300, 4)).astype(float)  # ties abound
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>").repartition(5)
    asked = rows.filter("id % 30 = 0").select(F.col("id").alias("query_id"), "embedding")
    found = {}
    for r in retrieve.top_k(rows, asked, k, metric).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.id, r.score))
    d = retrieve.distances(v[::30], v, metric)
    for q in range(10):
        order = np.lexsort((np.arange(300), d[q]))[:k]
        assert [i for i, _ in found[q * 30]] == order.tolist() and np.allclose([s for _, s in found[q * 30]], d[q][order])


def test_bounds_keep_shuffled_rows_few(spark, monkeypatch):
    """Of 60 blocks the second pass sends on little more than k rows per query, not k per block."""
    monkeypatch.setattr(retrieve, "RECORD_BLOCK", 50)
    v = np.random.default_rng(4).normal(size=(3000, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").withColumn("bound", F.lit(float("inf")))
    blocks = retrieve.packed(rows, 50).drop("bounds").withColumn("block", F.monotonically_increasing_id())
    asked = rows.filter("id < 20")
    kth = np.sort(retrieve.distances(v[:20], v, "l2"), axis=1)[:, 40]  # a bound as a first pass over a tenth would give
    bounded = asked.join(spark.createDataFrame([(i, float(x)) for i, x in enumerate(kth)], "id long, kth double"), "id").select("id", "v", F.col("kth").alias("bound"))
    schema = "query_id long, id long, score double"
    count = lambda q: retrieve.meet(blocks, q, 4).mapInPandas(retrieve.best_of(5, "l2"), schema).count()
    assert count(asked) == 20 * 60 * 5 and count(bounded) <= 20 * 41


def test_later_keys_win(spark):
    kind = metadata.MAP
    rows = spark.createDataFrame([({"a": "1", "b": "1"}, {"b": "2"}, None), (None, None, None), ({}, {"x": None}, {"x": "y"})], f"m {kind}, n {kind}, o {kind}")
    assert [r[0] for r in rows.select(metadata.merged(F.col("m"), F.col("n"), F.col("o"))).collect()] == [{"a": "1", "b": "2"}, {}, {"x": "y"}]


def test_metadata_of_chunks_through_a_collection(spark, tmp_path):
    table = "| city | pop |\n| --- | --- |\n| Rom | 28 |\n| Ulm | 12 |\n"
    rows = [("f", "a.md", table, {"owner": "me", "isTable": "perhaps", "chunkIndex": "9", "pageNumber": "7"}), ("g", "b.txt", "One. Two.", None)]
    docs = spark.createDataFrame(rows, "file_id string, file_name string, text string, extra map<string,string>")
    made = metadata.with_metadata(chunking.ingest_records(chunking.chunk_documents(docs)))
    found = {r.id: r.metadata for r in made.collect()}
    assert found["g-0"] == {"sourceFile": "b.txt", "fileExt": ".txt", "chunkStrategy": "sentence", "chunkCharStart": "0", "chunkCharEnd": "9", "chunkTokenCount": "9", "fileId": "g", "fileName": "b.txt", "mimeType": "text/plain", "chunkIndex": "0", "totalChunks": "1"}
    own = found["f-0"]
    assert (own["owner"], own["isTable"], own["chunkIndex"], own["pageNumber"], own["tableColumns"], own["tableRowCount"]) == ("me", "perhaps", "0", "7", '["city","pop"]', "2")
    into = Collection(spark, str(tmp_path), "c", 4)
    into.upsert(made.select("id", F.col("text").alias("document"), "metadata"))
    into.upsert(made.filter("id = 'g-0'").select("id", F.lit("changed").alias("document"), F.create_map(F.lit("new"), F.lit("k")).alias("metadata")))
    kept = into.read()
    ids = lambda which: [r.id for r in kept.filter(which).orderBy("id").collect()]
    assert ids(metadata.where("owner", "me")) == ["f-0"] and ids(metadata.where("new", None)) == ["g-0"] and ids(metadata.where("none", "x")) == []
    assert ids(metadata.where_contains("fileName", "a.m")) == ["f-0"] and ids(metadata.where_contains("fileName", "")) == ["f-0", "g-0"]
    records = kept.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    hits = retrieve.hits(retrieve.top_k(records, asked, 2, where=metadata.where("owner", "me")), records).collect()
    assert [(r.id, r.metadata["owner"]) for r in hits] == [("f-0", "me")]
