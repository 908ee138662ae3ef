"""What grows with the tables: how work is dealt to tasks and memory is bounded."""

import glob
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from chunkmill.functions import tokenizers as tok
from chunkmill.functions.config import RecursiveConfig
from chunkmill.operators import chunk_lists, cuts
from chunkmill.plans import queries as plans
from chunkmill.sources.collection import Collection
from chunkmill.sources.staging import new_folder
from chunkmill.streaming import jobs


def test_a_sent_batch_is_written_by_all_tasks_and_stays_one_batch(spark):
    path, taken = new_folder(spark, "sent"), []
    rows = spark.range(0, 1000, 1, 4)
    batches = rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), rows.filter("id < 0")
    run = lambda stream: jobs.run_batches(stream, path, lambda df, n: taken.append((n, df.count(), df.rdd.getNumPartitions())))
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    try:
        plans.streamed(spark, batches, path, "id long", run)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(glob.glob(f"{path.removeprefix('file://')}/sent/*.json")) > 4 * 2
    assert [t[:2] for t in taken if t[1]] == [(0, 500), (1, 500)] and all(parts >= 4 for _, n, parts in taken if n)


def test_streams_read_back_what_the_last_call_left(spark):
    path = new_folder(spark, "sent")
    run = lambda stream: jobs.run_until_done(stream.groupBy("k").count(), path)
    rows = spark.range(20).withColumn("k", F.col("id") % 3)
    found = plans.streamed(spark, (rows.filter("id < 10"), rows.filter("id >= 10")), path, "id long, k long", run)
    last = found.groupBy("k").agg(F.max_by("count", "batch")).collect()
    assert sorted(map(tuple, last)) == [(0, 7), (1, 7), (2, 6)]


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 8).select(F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("document"))
    own = Collection(spark, f"file://{tmp_path}", "few", 1)
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "64m"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        own.upsert(rows.repartition(8, "id"))
        own.upsert(rows.filter("id < 5").withColumn("document", F.lit("new")))
    finally:
        for k in small:
            spark.conf.unset(k)
    for version in (1, 2):
        files = glob.glob(f"{own.folders(version)['0'].removeprefix('file://')}/bucket=0/*.parquet")
        sizes = [spark.read.parquet(f"file://{f}").count() for f in files]
        assert len(sizes) > 1 and max(sizes) < 15_000 and sum(sizes) == 20_000
    found = own.read()
    assert found.count() == found.select("id").distinct().count() == 20_000 and found.filter("document = 'new'").count() == rows.filter("id < 5").count()


def test_blocks_take_whole_texts_and_ids_need_no_window_over_tokens(spark, monkeypatch):
    texts = ["b a b", None, "", " ", "a  c ", "\u00e4 \U0001f600 b", "a, b, , c", "x" * 1000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    asked = []
    monkeypatch.setattr(tok.Tokenizer, "tokens", lambda self, text, own=tok.Tokenizer.tokens: asked.append(self) or own(self, text))
    for tokenizer in (tok.WORD, tok.Tokenizer(", ")):
        vocab = tok.vocabulary(docs, tokenizer)
        assert not asked and "row_number" not in vocab._jdf.queryExecution().toString()
        ids, want = {r.token: r.id for r in vocab.collect()}, {}
        for t in texts:
            for x in tokenizer.split_text(t) if t is not None else ():
                want.setdefault(x, len(want))
        assert ids == want
        encoded = tok.encode(docs, tokenizer, vocab)
        assert {r.doc_id: r.ids for r in encoded.collect()} == {i: [ids[x] for x in tokenizer.split_text(t)] if t is not None else [] for i, t in enumerate(texts)}
        odd = encoded.withColumn("ids", F.when(F.col("doc_id") == 3, F.array(*map(F.lit, (0, None, -7, -8))).cast("array<bigint>")).otherwise(F.col("ids")))
        back = {r.doc_id: (r.text, r.error) for r in tok.decode(odd, tokenizer, vocab).collect()}
        assert back == {i: (None, "Unknown token id: -7") if i == 3 else (t or "", None) for i, t in enumerate(texts)}


def test_html_tables_are_parsed_without_an_object_per_tag():
    rows = "".join(f"<TR><td>{i}</td></tr>" for i in range(3))
    text = f"<p>\u0130</p><Table id=1><tbody>{rows}</TBODY></table>"
    for t in (text, text + "<b>" * 300_000):
        header, _, spans, footer = cuts.parse_html(t)
        assert (header, "".join(t[a:b] for a, b in spans), footer) == ("<Table id=1><tbody>", rows, "</TBODY></table>") and len(spans) == 3
    long = text + ">" * 300_000
    tracemalloc.start()
    cuts.parse_html(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(long)


def test_chunks_are_python_objects_for_a_slice_at_a_time():
    texts = pa.array(["a b\n" * 50] * 30_000 + [None, "", "x y " * 600_000])
    parts = list(chunk_lists.sliced(texts))
    assert sum(map(len, parts)) == len(texts) and all(len(p) == 1 or p.nbytes <= chunk_lists.SLICE_BYTES for p in parts)
    cut = lambda t: cuts.recursive(t, RecursiveConfig(120, 1, tokenizer=tok.CHARACTER))
    held = []

    def run(part):
        rows = [chunk_lists.cut_all(t, cut) for t in part.to_pylist()]
        held.append(sum(map(len, rows)))
        return chunk_lists.lists(rows, chunk_lists.CUT)

    few = texts.slice(0, 20_000)
    found = chunk_lists.by_slices(few, run)
    whole = [chunk_lists.cut_all(t, cut) for t in few.slice(0, 3).to_pylist()]
    assert len(held) > 3 and max(held) < sum(held) / 3
    assert found.slice(0, 3).equals(chunk_lists.lists(whole, chunk_lists.CUT)) and found.slice(19_997).equals(found.slice(0, 3))


def test_a_short_markdown_file_is_prepared_once_and_cut_by_few_calls(spark, tmp_path):
    """The extension is made once a row, the helper runs once, rows of a table are told before the shuffle, and rules end when nothing is left to cut."""
    spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 9, 1)], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = plans.c6_markdown_segments(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(") == 1 and plan.count("ArrowEvalPython") == 1
    assert plan.index("partial_collect_list") < plan.rindex("Exchange hashpartitioning(l_orderkey") < plan.index("concat(| ")
    head = len("| name | key |\n| --- | :---: |\n")
    assert sorted(map(tuple, found.collect())) == [(1, "recursive", 1, 10), (1, "table", 1, head + 19), (2, "recursive", 1, 10), (2, "table", 1, head + 9)]

    asked = []

    class Counted(tok.TextTokenizer):
        def split_text(self, text):
            return list(text)

        def count_texts(self, texts):
            asked.append(len(texts))
            return [len(t) for t in texts]

    assert [c[0] for c in cuts.recursive("Prose of 1", RecursiveConfig(tokenizer=Counted()))] == ["Prose of 1"] and sum(asked) == 1 and len(asked) <= 2
