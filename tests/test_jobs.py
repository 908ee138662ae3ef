"""Uploads, collections, retrieval and chat logs: literal cases, and streams against their batch twins."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from chunkmill.functions import text as T
from chunkmill.functions import tokenizers
from chunkmill.operators import chat, retrieve, uploads
from chunkmill.sources import files, staging
from chunkmill.sources.collection import Collection, list_documents, summary, where_file
from chunkmill.streaming import jobs, processors


def parts(spark, *rows):
    return spark.createDataFrame([("f", "f.txt", i, n, None if d is None else base64.b64encode(d).decode(), s) for s, (i, n, d) in enumerate(rows)], files.PART_SCHEMA)


UPLOADS = [
    ([(1, 2, b"B"), (0, 2, b"A")], b"AB", None),
    ([(0, 2, b"x"), (0, 2, b"A"), (1, 2, b"B")], b"AB", None),
    ([(0, 2, b"A"), (1, 2, b"")], None, "Missing chunk 1 for f"),
    ([(0, 2, b"A"), (5, 2, b"B")], None, "Missing chunk 1 for f"),
    ([(0, 3, b"A"), (1, 3, b"B"), (2, 2, b"C")], b"AB", None),  # more parts than the last message tells of
    ([(0, 0, b"A")], b"", None),
    ([(0, 2, b"A"), (1, 2, b"B"), (1, 2, b"C")], b"AB", None),  # a part behind the end opens another upload
]


@pytest.mark.parametrize("rows,content,error", UPLOADS)
def test_assemble(spark, rows, content, error):
    r = uploads.assemble(parts(spark, *rows)).first()
    assert (bytes(r.content) if r.content is not None else None, r.error) == (content, error)


def test_open_uploads(spark):
    r = uploads.assemble(parts(spark, (0, 3, b"A"), (0, 4, b"B"))).first()
    assert (r.total_chunks, r.received, r.complete, r.content, r.error) == (4, 1, False, None, None)
    odd = spark.createDataFrame([("f", None, None, None, "?", 1), (None, "n", 0, 1, "QQ==", 1)], files.PART_SCHEMA)
    found = {r.file_id: (r.complete, r.content) for r in uploads.assemble(odd).collect()}
    assert found == {"f": (True, b""), None: (True, b"A")}
    assert uploads.assemble(odd.limit(0)).collect() == []


def streamed(spark, batches, run, folder, schema, mode="append"):
    """Rows of a stream whose batches come as a file each; a second call on the same folder goes on."""
    for batch in batches:
        batch.coalesce(1).write.mode("append").json(f"{folder}/in")
    stream = run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/in"))
    return jobs.run_until_done(stream, f"file://{folder}", mode).collect()


def outcomes(rows):
    return [(r.event, None if r.content is None else bytes(r.content), r.error) for r in rows if r.event != "chunk-received"]


def test_assemble_stream_is_the_batch(spark, tmp_path):
    every = [p.withColumn("file_id", F.lit(f"f{k}")) for k, (rows, _, _) in enumerate(UPLOADS) for p in [parts(spark, *rows)]]
    whole = every[0]
    for p in every[1:]:
        whole = whole.unionByName(p)
    batches = [whole.filter("seq = 0"), whole.filter("seq = 1"), whole.filter("seq > 1")]
    out = streamed(spark, batches, jobs.assemble_stream, tmp_path, files.PART_SCHEMA)
    assert sum(r.event == "chunk-received" for r in out) == sum(len(rows) for rows, _, _ in UPLOADS)
    twin = uploads.assembly_events(whole).collect()
    assert len(out) == len(twin)
    for k, (_, content, error) in enumerate(UPLOADS):
        error = error and error.replace("for f", f"for f{k}")
        own = [outcomes(r for r in rows if r.file_id == f"f{k}") for rows in (out, twin)]
        assert own[0] == own[1] == [("file" if error is None else "ingest-failed", content, error)]


def test_assembly_goes_on_from_its_checkpoint(spark, tmp_path):
    first = streamed(spark, [parts(spark, (0, 3, b"A"), (1, 3, b"B"))], jobs.assemble_stream, tmp_path, files.PART_SCHEMA)
    assert outcomes(first) == []
    both = streamed(spark, [parts(spark, (2, 3, b"C"))], jobs.assemble_stream, tmp_path, files.PART_SCHEMA)
    assert outcomes(both) == [("file", b"ABC", None)] and len(both) == 4


class Fake:
    """A state as the processors see one, in a dictionary; a map state, or a value state under one key."""

    def __init__(self):
        self.kept, self.calls = {}, 0

    def containsKey(self, key):
        self.calls += 1
        return key in self.kept

    def getValue(self, key):
        return self.kept[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.kept[key] = value

    def clear(self):
        self.kept = {}

    def get(self):
        return self.kept.get(None)

    def update(self, value):
        self.kept[None] = value


class Handle:
    def __init__(self):
        self.timers = []

    def getMapState(self, *schemas):
        return Fake()

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def listTimers(self):
        return iter(self.timers)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def test_abandoned_and_too_large_uploads(monkeypatch):
    own, handle = processors.Assembly(1000), Handle()
    own.init(handle)
    row = lambda i, n, data, seq: {"file_name": "f.txt", "chunk_index": i, "total_chunks": n, "bytes": data, "seq": seq}
    assert len(list(own.handleInputRows(("f",), iter([row(0, 2, b"A", 1)]), Now(5)))) == 1 and handle.timers == [1005]
    list(own.handleInputRows(("f",), iter([row(0, 2, b"B", 2)]), Now(50)))
    assert handle.timers == [1050]
    gone = list(own.handleExpiredTimer(("f",), Now(1051), None))
    assert [(r.event, r.error) for r in gone] == [("ingest-failed", "Upload abandoned: f")] and own.so_far.get() is None and own.parts.kept == {}
    monkeypatch.setattr(uploads, "MAX_FILE_BYTES", 3)
    out = list(own.handleInputRows(("f",), iter([row(0, 9, b"ABCD", 3), row(1, 9, b"A", 4)]), Now(60)))
    assert [r.error for r in out] == [None, "f.txt: exceeds 100MB limit", None] and own.so_far.get() == ("f.txt", 1, 1)


def test_ingest_of_a_stream_is_exactly_once(spark, tmp_path):
    own = Collection(spark, str(tmp_path), "c", 4)
    batch = spark.createDataFrame([("file", "f", "a.txt", None, b"One. Two.", None), ("file", "g", "b.exe", None, b"x", None), ("file", "h", "c.txt", None, b" ", None), ("chunk-received", "f", "a.txt", 0, None, None), ("ingest-failed", "i", "d.txt", None, None, "bad")], uploads.EVENTS)
    run = jobs.ingest(own, lambda r: retrieve.embed(r, retrieve.hashing_embedder(8), "document"), str(tmp_path / "events"))
    for _ in range(2):  # the second time as after a failure
        run(batch, 0)
        assert [r.id for r in own.read().collect()] == ["f-0"] and own.versions() == [1]
        told = {}
        for e in sorted(spark.read.parquet(str(tmp_path / "events")).collect(), key=lambda e: e.ord):
            told.setdefault(e.id, []).append((e._tag, e.processed, e.total, e.message))
        assert told["f"] == [("ingest-start", None, None, None), ("ingest-progress", 1, 1, None), ("ingest-complete", None, 1, None)]
        assert told["g"] == [("ingest-failed", None, None, "Unsupported file type: b.exe")]
        assert told["h"] == [("ingest-start", None, None, None), ("ingest-complete", None, 0, None)]
        assert told["i"] == [("ingest-failed", None, None, "bad")]
    run(batch.filter("file_id = 'h'"), 1)
    assert own.versions() == [1, 2] and own.current()[2] == {"uploads": 1} and own.count() == 1
    own.drop()
    assert own.read() is None and own.current()[2] == {"uploads": 1}


def test_upsert_of_null_ids(spark, tmp_path):
    own = Collection(spark, str(tmp_path), "n", 2)
    rows = spark.createDataFrame([(None, "a"), ("x", "b")], "id string, document string")
    assert own.upsert(rows) == 2 and own.upsert(rows.withColumn("document", F.lit("c"))) == 2
    assert sorted((r.id or "", r.document) for r in own.read().collect()) == [("", "c"), ("x", "c")]


def test_progress_in_batches(spark):
    rows = uploads.ingest_events(spark.createDataFrame([("f", 2500, None)], "file_id string, chunks int, error string")).orderBy("ord").collect()
    assert [(r._tag, r.processed, r.total) for r in rows] == [("ingest-start", None, None), ("ingest-progress", 1000, 2500), ("ingest-progress", 2000, 2500), ("ingest-progress", 2500, 2500), ("ingest-complete", None, 2500)]


def test_validate(spark):
    rows = [("1", "a.txt", 104857601, "text/plain"), ("2", "a.exe", 1, "x"), ("3", "notes.bin", 1, "text/plain"), ("4", "pdf", 1, ""), ("5", "A.MD", 104857600, None)]
    found = {r.id: r.reject_reason for r in files.validate_files(spark.createDataFrame(rows, "id string, name string, size long, type string")).collect()}
    assert found == {"1": "a.txt: exceeds 100MB limit", "2": "a.exe: unsupported file type", "3": None, "4": None, "5": None}


def test_upload_fold(spark):
    states = spark.createDataFrame([("a", "pending"), ("b", "pending"), ("c", "pending")], "id string, status string")
    e = [("status", "a", "uploading", None, None, None, 1), ("ingest", "a", "start", None, None, None, 2), ("progress", "a", None, None, 3, 60, 3), ("ingest", "a", "complete", None, None, None, 4), ("ingest", "b", "start", None, None, None, 1), ("ingest", "b", "error", None, None, None, 2), ("status", "z", "error", "x", None, None, 1)]
    events = spark.createDataFrame(e, "_tag string, id string, status string, error string, chunks_uploaded int, progress int, seq long")
    rows = {r.id: tuple(r)[1:] for r in uploads.upload_states(states, events).collect()}
    assert rows == {"a": ("complete", None, False, 3, 60), "b": ("error", "Ingest failed. Check server logs.", False, 0, 0), "c": ("pending", None, False, 0, 0)}


def test_files_and_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"\xef\xbb\xbfhi \xff")
    (tmp_path / "in" / "x.docx").write_bytes(b"no")
    rows = {r.file_name: (r.text, r.error) for r in files.read_files(spark, str(tmp_path / "in")).collect()}
    assert rows == {"a.txt": ("hi �", None), "x.docx": (None, "Unsupported file type: x.docx")}
    cut = files.upload_parts(spark.createDataFrame([("f", "f", b"x" * 1025), ("e", "e", b"")], "file_id string, file_name string, content binary"), 512).collect()
    assert [(r.chunk_index, r.total_chunks, len(base64.b64decode(r.data))) for r in cut] == [(0, 3, 512), (1, 3, 512), (2, 3, 1)]
    files.write_events(spark.createDataFrame([("s", 1, "thinking", "m")], "session_id string, seq long, _tag string, message string"), str(tmp_path / "log"))
    assert files.read_events(spark, str(tmp_path / "log")).first().message == "m"
    assert [r.ext for r in spark.createDataFrame([("a.tar.GZ",), ("noext",), (".md",)], "n string").select(T.file_extension(F.col("n")).alias("ext")).collect()] == [".gz", "", ".md"]


def test_collection(spark, tmp_path):
    own = Collection(spark, str(tmp_path), "docs", 4)
    assert own.read() is None and own.count() == 0
    rows = spark.createDataFrame([("r1", "Kestrels hover", "rep.md"), ("r2", "Otters swim", "x"), ("r3", "A granite ledge", "Rep")], "id string, document string, file_name string")
    assert own.upsert(rows) == 3
    assert own.upsert(spark.createDataFrame([("r2", "Otters swim!", 7)], "id string, document string, more int")) == 1
    assert own.count() == 3 and own.read().filter("id = 'r2'").first().document == "Otters swim!"
    assert [r.id for r in list_documents(own.read(), "ledge").collect()] == ["r3"] and len(list_documents(own.read(), None, 2).collect()) == 2
    assert [r.id for r in own.read().filter(where_file("rep")).collect()] == ["r1"]
    assert tuple(summary(own.read()).first()) == (3, "r1", 14)
    assert own.drop() == "docs" and own.read() is None


def test_collection_of_two_writers_and_vacuum(spark, tmp_path):
    own, other = Collection(spark, str(tmp_path), "docs", 4), Collection(spark, str(tmp_path), "docs", 4)
    rows = spark.createDataFrame([(f"d{i}", f"text {i}") for i in range(40)], "id string, document string")
    own.upsert(rows)
    version, folders, sources = own.current()
    assert own.publish(version + 1, folders, sources) and not other.publish(version + 1, folders, sources)
    one = spark.createDataFrame([("d7", "changed")], "id string, document string")
    other.upsert(one)
    after = other.current()[1]
    assert sum(after[b] != folders[b] for b in folders) == 1  # one bucket is written anew
    assert own.count() == 40 and own.read().filter("id = 'd7'").first().document == "changed"
    for _ in range(3):
        own.upsert(one)
    assert own.vacuum(1) == 3 and own.vacuum(1) == 0 and own.count() == 40 and len(own.versions()) == 1


def test_running_total_of_sparse_orders(spark):
    rng = np.random.default_rng(2)
    orders = np.unique(rng.integers(-(10**15), 10**15, 500))
    n = rng.integers(0, 9, len(orders))
    counts = spark.createDataFrame([(int(o), int(x)) for o, x in zip(orders, n)], "o long, n long").repartition(5)
    found = {r.o: r.before for r in tokenizers.running_total(counts, "o", "n").collect()}
    assert found == dict(zip(orders.tolist(), (np.cumsum(n) - n).tolist()))


def test_retrieval_by_text_with_filters_and_metadata(spark):
    rows = [("a", "red apples here", "x"), ("b", "red apples here", "y"), ("c", "blue sky", "x"), ("d", None, "x")]
    records = retrieve.embed(spark.createDataFrame(rows, "id string, document string, kind string"), retrieve.hashing_embedder(16), "document")
    asked = spark.createDataFrame([(1, "red apples here"), (2, "blue sky")], "query_id long, text string")
    found = retrieve.retrieve_texts(records, asked, retrieve.hashing_embedder(16), 1, where=F.col("kind") == "x").collect()
    assert {(r.query_id, r.id, r.document, r.kind, r.rank) for r in found} == {(1, "a", "red apples here", "x", 1), (2, "c", "blue sky", "x", 1)}
    found = retrieve.retrieve_texts(records, asked, retrieve.hashing_embedder(16), 5, where_document="sky").collect()
    assert {(r.query_id, r.id) for r in found} == {(1, "c"), (2, "c")}


def test_staging_on_a_cluster_wants_a_shared_folder():
    class Session:
        conf, sparkContext = {}, type("C", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session)


def test_long_sessions_and_many_parts(spark):
    tools = [("tool-call-start", {"id": f"t{i % 50}", "name": "n"}) for i in range(2000)] + [("tool-execution-complete", {"id": f"t{i}", "result": "r", "success": True}) for i in range(50)]
    r = folded(spark, *tools)
    assert len(r.segments) == 2000 and all(s.tool.status == "complete" for s in r.segments)
    n = spark.range(1).select(T.starts_of(F.sequence(F.lit(1), F.lit(5000))).alias("s")).first().s
    assert n == (np.cumsum(np.arange(1, 5001)) - np.arange(1, 5001)).tolist()
    assert spark.range(1).select(T.starts_of(F.array().cast("array<int>")).alias("s")).first().s == []


def test_top_k(spark):
    e = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 2.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, embedding array<float>")
    rows = retrieve.top_k(e, q, 2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in rows] == [(1, 1, "a", 0.0), (1, 2, "b", 0.0), (2, 1, "c", 1.0), (2, 2, "a", 2.0)]
    assert len(retrieve.top_k(e, q, 10).collect()) == 6 and retrieve.top_k(e, q.limit(0), 3).collect() == []
    assert retrieve.hits(retrieve.top_k(e, q, 1), e.withColumn("document", F.lit(None).cast("string"))).first().document == ""
    with pytest.raises(ValueError):
        retrieve.top_k(e, q, 1, "x")
    assert retrieve.hashing_embedder(4)(["a b", ""]).shape == (2, 4)
    assert np.isclose(np.linalg.norm(retrieve.hashing_embedder(4)(["a b"])), 1)


FIELDS = [f.split()[0] for f in files.CHAT_EVENT_SCHEMA.split(", ")]


def events(spark, *rows, session="s"):
    return spark.createDataFrame([tuple(({"session_id": session, "seq": i, "_tag": t} | v).get(f) for f in FIELDS) for i, (t, v) in enumerate(rows)], files.CHAT_EVENT_SCHEMA)


HELLO = [("iteration-start", {"iteration": 1}), ("text-delta", {"delta": "He"}), ("text-delta", {"delta": "llo"})]
CALL = [("tool-call-start", {"id": "t1", "name": "retriever"}), ("tool-call-delta", {"id": "t1", "arguments_delta": '{"a":'}), ("tool-call-delta", {"id": "t1", "arguments_delta": "1}"}), ("tool-call-complete", {"id": "t1", "arguments": '{"a":1}'}), ("tool-execution-start", {"id": "t1"}), ("tool-execution-complete", {"id": "t1", "result": "r", "success": True})]
FINISH = ("finish", {"finish_reason": "stop", "prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 7})


def folded(spark, *rows):
    return chat.fold_chat(events(spark, *rows)).first()


def test_chat_fold(spark):
    r = folded(spark, *HELLO)
    assert (r._tag, r.current_iteration, [(s.content, s.is_complete) for s in r.segments]) == ("streaming", 1, [("Hello", False)])
    r = folded(spark, *HELLO, ("text-complete", {}), ("text-delta", {"delta": "!"}))
    assert [(s.content, s.is_complete) for s in r.segments] == [("Hello", True), ("!", False)]
    r = folded(spark, *HELLO, *CALL, ("tool-call-delta", {"id": "t9", "arguments_delta": "x"}))
    tool = r.segments[1].tool
    assert (tool.arguments_text, tool.arguments, tool.status, tool.result, tool.success) == ('{"a":1}', '{"a":1}', "complete", "r", True)
    r = folded(spark, *HELLO, FINISH)
    assert (r._tag, len(r.segments), r.total_tokens, r.finish_reason) == ("complete", 1, 7, "stop")
    assert folded(spark, *HELLO, FINISH, FINISH).segments == []
    r = folded(spark, *HELLO, FINISH, ("text-delta", {"delta": "more"}))
    assert r._tag == "streaming" and [s.content for s in r.segments] == ["Hellomore"] and r.total_tokens is None
    r = folded(spark, *HELLO, ("error", {"message": "bad", "recoverable": False}))
    assert (r._tag, len(r.segments), r.error_message, r.recoverable) == ("error", 1, "bad", False)
    r = folded(spark, ("thinking", {"message": "hm"}), ("iteration-start", {"iteration": 2}), ("iteration-end", {}))
    assert (r.thinking, r.current_iteration) == ("hm", None)


def test_chat_stream_is_the_batch(spark, tmp_path):
    rows = [*HELLO, *CALL, ("text-delta", {"delta": "x"}), FINISH]
    whole = events(spark, *rows).unionByName(events(spark, *HELLO, FINISH, FINISH, *HELLO, session="cleared")).unionByName(events(spark, FINISH, session="none"))
    batches = [whole.filter(F.col("seq") < 5), whole.filter(F.col("seq") >= 5)]
    out = streamed(spark, batches, jobs.chat_changes, tmp_path, files.CHAT_EVENT_SCHEMA, "update")
    again = jobs.chat_states(spark.createDataFrame(out, f"{processors.CHANGES}, batch int")).orderBy("session_id").collect()
    assert again == chat.fold_chat(whole).orderBy("session_id").collect() and len(again) == 3


def test_a_batch_touches_what_it_changes():
    own, handle = processors.ChatSession(), Handle()
    own.init(handle)
    event = lambda seq, tag, **v: Row(*FIELDS)(*(({"session_id": "s", "seq": seq, "_tag": tag} | v).get(f) for f in FIELDS))
    calls = [event(i, "tool-call-start", id=f"t{i}", name="n") for i in range(500)]
    list(own.handleInputRows(("s",), iter(calls), None))
    own.segments.calls = own.places.calls = 0
    out = list(own.handleInputRows(("s",), iter([event(900, "tool-execution-complete", id="t7", result="r", success=True), event(800, "tool-execution-start", id="t7")]), None))
    assert [r.pos for r in out] == [None, 7] and json.loads(out[1].told)["tool"]["status"] == "complete"
    assert own.segments.calls <= 2 and own.places.calls <= 2
    odd = [event(1000, "tool-call-start", name="n"), event(1001, "tool-call-start", id="", name="n"), event(1002, "tool-call-complete", arguments="{}")]
    out = list(own.handleInputRows(("s",), iter(odd), None))
    assert [json.loads(r.told)["tool"]["arguments"] for r in out if r.pos is not None] == ["{}", None]  # a null id isn't an empty one


def test_upload_states_stream(spark, tmp_path):
    schema = "_tag string, id string, status string, error string, chunks_uploaded int, progress int, seq long"
    one = spark.createDataFrame([("status", "a", "uploading", None, None, None, 1), ("progress", "a", None, None, 2, 20, 2), ("status", "zzz", "uploading", None, None, None, 1)], schema)
    two = spark.createDataFrame([("ingest", "a", "start", None, None, None, 3), ("ingest", "a", "error", None, None, None, 4)], schema)
    known = spark.createDataFrame([("a", "pending"), ("b", "pending")], "id string, status string")
    out = streamed(spark, [one, two], lambda e: jobs.upload_state_stream(known, e), tmp_path, schema, "update")
    assert {r.id for r in out} == {"a"}
    last = spark.createDataFrame([max(out, key=lambda r: r.batch)], jobs.upload_state_stream(known, one).schema.add("batch", IntegerType())).drop("batch")
    found = uploads.states_of(known, last).orderBy("id").collect()
    assert found == uploads.upload_states(known, one.unionByName(two)).orderBy("id").collect()
    assert tuple(found[0]) == ("a", "error", "Ingest failed. Check server logs.", False, 2, 20) and tuple(found[1]) == ("b", "pending", None, False, 0, 0)


PART_FIELDS = "session_id string, seq long, type string, id string, name string, delta string, result string, is_failure boolean, reason string, input_tokens long, output_tokens long, error string"


def model_parts(spark, *rows):
    names = [f.split()[0] for f in PART_FIELDS.split(", ")]
    return spark.createDataFrame([tuple(({"session_id": "s", "seq": i, "type": t} | v).get(n) for n in names) for i, (t, v) in enumerate(rows)], PART_FIELDS)


def test_model_parts(spark):
    own = model_parts(
        spark, ("text-delta", {"delta": "hi"}), ("tool-params-start", {"id": "t", "name": "n"}), ("tool-params-delta", {"id": "t", "delta": "{bad"}), ("tool-params-end", {"id": "t"}),
        ("tool-params-delta", {"id": "u", "delta": "x"}), ("tool-result", {"id": "t", "result": "r", "is_failure": True}), ("other", {}), ("finish", {"reason": "tool-calls"}),
        ("tool-params-start", {"id": "v", "name": "n"}), ("tool-params-delta", {"id": "v", "delta": '{"a": 1}'}), ("tool-params-end", {"id": "v"}), ("finish", {"reason": "stop", "input_tokens": 3}), 
    )
    rows = chat.part_events(own).orderBy("seq").collect()
    assert [r._tag for r in rows] == ["iteration-start", "text-delta", "tool-call-start", "tool-call-delta", "tool-call-complete", "tool-execution-start", "tool-execution-complete", "iteration-start", "tool-call-start", "tool-call-delta", "tool-call-complete", "tool-execution-start", "finish"]
    assert [r.arguments for r in rows if r._tag == "tool-call-complete"] == ["{}", '{"a": 1}'] and [r.success for r in rows if r._tag == "tool-execution-complete"] == [False]
    assert (rows[-1].prompt_tokens, rows[-1].completion_tokens, rows[-1].total_tokens) == (3, 0, 3)
    assert tuple(chat.session_summary(own).first()) == ("s", 2, "stop", False)
    many = model_parts(spark, *[("finish", {"reason": "tool-calls"})] * 12)
    assert chat.part_events(many).orderBy(F.desc("seq")).first().message == "Reached maximum iterations (12). Stopping here."
    assert tuple(chat.session_summary(many).first()) == ("s", 12, "tool-calls", True)


def test_part_stream_is_the_batch(spark, tmp_path):
    rows = [("text-delta", {"delta": "hi"}), ("tool-params-start", {"id": "t", "name": "n"}), ("tool-params-delta", {"id": "t", "delta": '{"a":'}), ("tool-params-delta", {"id": "t", "delta": " 1}"}), ("tool-params-end", {"id": "t"}), ("finish", {"reason": "tool-calls"}),
            ("tool-params-delta", {"id": "t", "delta": "x"}), ("tool-result", {"id": "t", "result": "r"}), ("error", {"error": "bad"}), ("finish", {"reason": "stop", "output_tokens": 2})]
    whole = model_parts(spark, *rows)
    batches = [whole.filter("seq < 3"), whole.filter("seq BETWEEN 3 AND 5"), whole.filter("seq > 5")]
    out = sorted(streamed(spark, batches, jobs.part_event_stream, tmp_path, PART_FIELDS), key=lambda r: r.seq)
    assert [tuple(r)[:-1] for r in out] == [tuple(r) for r in chat.part_events(whole).orderBy("seq").collect()]
    assert [r.arguments for r in out if r._tag == "tool-call-complete"] == ['{"a": 1}']
    assert [r._tag for r in out][-3:] == ["iteration-start", "error", "finish"]  # the call of the iteration before isn't open any more


def test_history(spark):
    rows = spark.createDataFrame([("assistant", "m", [("text", "a"), ("tool-call", "x"), ("text", "b")]), ("assistant", "m", []), ("user", "u", [("text", "z")])], "role string, message string, segments array<struct<kind:string,content:string>>")
    assert [r.content for r in chat.history_messages(rows).collect()] == ["ab", "m", "u"]


def test_texts(spark):
    df = spark.createDataFrame([(" a\r\nb\t\x0b c\n\n\n\nd﻿ ", '{"k": 1}')], "t string, j string")
    r = df.select(T.normalize_whitespace(F.col("t")).alias("n"), T.tool_arguments(F.col("j")).alias("a"), T.preview(F.lit("x" * 181)).alias("p"), T.with_offsets(T.split_lines(F.col("t"))).alias("l")).first()
    assert r.n == "a\nb c\n\nd" and r.a == {"k": "1"} and r.p == "x" * 180 + "..." and r.l[1].start_idx == 4
    next_, none = df.select(T.split_by_delimiters(F.lit("a.b.."), ["."], "next").alias("x"), T.split_by_delimiters(F.lit("a.b.."), ["."], None).alias("y")).first()
    assert next_ == ["a", ".b", ".", "."] and none == ["a", "b"]
