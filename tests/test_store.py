"""Sources, streams, snapshots and the entry points."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mnemolake import store as M
from mnemolake.api import Memory
from mnemolake.operators.consolidate import Domain
from mnemolake.providers import HashingEmbedder, Heuristic, embed_missing, query_vector
from mnemolake.sources import tail, transcripts
from mnemolake.streaming import state

NOW = dt.datetime(2024, 2, 1)


def lines(spark, rows):
    return spark.createDataFrame([("f", i + 1, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "path string, line long, value string")


def test_map_lines(spark):
    rows = [
        {"type": "user", "sessionId": "s", "message": {"role": "user", "content": "hello"}, "timestamp": "2024-01-01T00:00:00Z"},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "thinking", "text": "no"}, {"type": "tool_use", "id": "t", "name": "run", "input": {"a": 1}}, {"type": "text", "text": "one"}, {"type": "text", "text": "two"}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "content": "{}"}]}},
        {"role": "user", "message": {"content": [{"type": "text", "text": "x <user_query>ask</user_query>"}]}},
        {"type": "user", "isMeta": True, "message": {"content": "meta"}},
        {"type": "summary", "summary": "no"},
        "{broken",
    ]
    got = [(r.line, r.ordinal, r.event_type, r.role, r.content, r.content_type) for r in transcripts.map_lines(lines(spark, rows)).orderBy("line", "ordinal").collect()]
    assert [g[:4] for g in got] == [(1, 0, "message", "user"), (2, 0, "message", "assistant"), (2, 1, "tool_call", "assistant"), (3, 0, "tool_result", "tool"), (4, 0, "message", "user")]
    assert got[1][4] == "one\ntwo" and json.loads(got[2][4])["name"] == "run" and got[3][5] == "json" and got[4][4] == "ask"


def test_chat_history(spark):
    rows = [{"type": "user", "content": "hi"}, {"type": "assistant", "content": "yo", "tool_calls": [{"id": "1", "name": "f", "arguments": '{"a":1}'}]}, {"type": "reasoning", "content": "no"}, {"type": "user", "content": "made", "synthetic_reason": "x"}]
    got = [(r.line, r.event_type) for r in transcripts.map_chat_history(lines(spark, rows)).orderBy("line", "ordinal").collect()]
    assert got == [(1, "message"), (2, "message"), (2, "tool_call")]


def test_discover(spark):
    paths = ["/h/projects/g/a.jsonl", "/h/projects/g/agent-transcripts/b.jsonl", "/h/projects/g/agent-transcripts/subagents/c.jsonl", "/h/sessions/g/s1/chat_history.jsonl", "/h/sessions/g/s2/chat_history.jsonl", "/h/sessions/g/s1/subagents/s2.json"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path for r in transcripts.discover(files, "agent").collect()} == {paths[1]}
    assert {r.path for r in transcripts.discover(files, "chat").collect()} == {paths[3]}
    assert transcripts.resolve([]) == []
    with pytest.raises(ValueError):
        transcripts.resolve([{"kind": "unknown", "home": "/h"}])


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"b": 2}\n')
    assert [(r.line, r.value) for r in transcripts.read_lines(spark, [str(tmp_path)]).orderBy("line").collect()] == [(1, '{"a": 1}'), (3, '{"b": 2}')]


def tailed(reader, start, end):
    return [(r["line"], r["value"]) for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]


def test_tail_resumes_and_restarts(tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text("one\ntwo\npart")
    reader = tail.TailReader(str(tmp_path / "*.jsonl"), 5)
    none, first = reader.initialOffset(), reader.latestOffset()
    assert tailed(reader, none, first) == [(0, "one"), (4, "two")]
    with f.open("a") as out:
        out.write("ial\nmore\n")
    # A file that has grown since the offset was taken: the batch is what it was, the next one has the rest.
    assert tailed(reader, none, first) == [(0, "one"), (4, "two")]
    second = reader.latestOffset()
    assert tailed(reader, first, second) == [(8, "partial"), (16, "more")]
    assert tailed(reader, second, reader.latestOffset()) == []
    f.write_text("new\n")
    assert tailed(reader, second, reader.latestOffset()) == [(0, "new")]


def test_lines_without_a_clock_have_the_file_s(spark, tmp_path):
    import os

    (tmp_path / "a.jsonl").write_text('{"type": "user", "message": {"role": "user", "content": "hi"}}\n{"type": "user", "timestamp": "2024-02-03T04:05:06Z", "message": {"role": "user", "content": "ho"}}\n')
    os.utime(tmp_path / "a.jsonl", (86400, 86400))
    got = {r.content: str(r.occurred_at) for r in transcripts.map_lines(transcripts.read_lines(spark, [str(tmp_path)])).select("content", F.col("occurred_at").cast("string").alias("occurred_at")).collect()}
    assert got == {"hi": "1970-01-02 00:00:00", "ho": "2024-02-03 04:05:06"}


def test_folders_of_a_working_directory(spark, tmp_path):
    """Encoded names, one segment, a drive, a shortened folder by its record, and names that would lead out."""
    names = ["%2Fhome%2Fme%2Fa%20b", "plain", "C%3A%5Cdev", "long-0123", "other"]
    for n in names:
        (tmp_path / n / "s1").mkdir(parents=True)
        (tmp_path / n / "s1" / "chat_history.jsonl").write_text("{}")
    long = "/" + "x" * 300
    (tmp_path / "long-0123" / ".cwd").write_text(long + "\n")
    (tmp_path / "other" / ".cwd").write_text("/home/me/a b")  # has a folder of its name, which counts
    cwds = spark.createDataFrame([(c,) for c in ("/home/me/a b/", "plain", "c:/dev", long, "..", ".", "../plain", "", "/none")], "cwd string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select(F.lit(f"file:{tmp_path}").alias("root"), "path")
    folders = files.select(F.regexp_extract("path", r"^(.*)/s1/[^/]*$", 1).alias("folder"))
    got = sorted((r.cwd, r.folder.rsplit("/", 1)[1]) for r in transcripts.folders_of(files, cwds, transcripts.records(folders)).collect())
    assert got == sorted([("/home/me/a b/", names[0]), ("plain", "plain"), ("c:/dev", names[2]), (long, "long-0123")])


def test_ranges_cut_lines_exactly_once(tmp_path):
    import random

    rng = random.Random(3)
    lines = ["x" * rng.choice([0, 1, 5, 40]) + "é" for _ in range(200)]
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\npartial")
    for size in (1, 2, 7, 64, 1000, 10**6):
        reader = tail.TailReader(str(tmp_path / "x.jsonl"), size)
        end = reader.latestOffset()
        assert [v for _, v in tailed(reader, reader.initialOffset(), end)] == lines
        marks = [r["mark"] for p in reader.partitions(reader.initialOffset(), end) for b in reader.read(p) for r in b.to_pylist() if r["mark"]]
        assert marks == [end["files"][str(tmp_path / "x.jsonl")][1]]
    (tmp_path / "y.jsonl").write_text("no end")
    assert tail.complete_end(str(tmp_path / "y.jsonl")) == 0


def said(role, text, session="c1"):
    import json

    return json.dumps({"type": role, "sessionId": session, "message": {"role": role, "content": text}}) + "\n"


def test_a_copy_is_exactly_once(spark, tmp_path):
    """Two runs of a stream over a growing file, a batch that is replayed, and two streams into one store."""
    from mnemolake.streaming.sink import copier

    (tmp_path / "projects" / "p").mkdir(parents=True)
    f = tmp_path / "projects" / "p" / "x.jsonl"
    f.write_text(said("user", "one") + said("assistant", "two") + '{"type": "summary"}\n')
    spark.dataSource.register(tail.JsonlTail)
    store = M.Store(spark, f"file://{tmp_path}/store")
    seen = []

    def write(batch, number):
        copier(store, "copy")(batch, number)
        seen.append(number)
        copier(store, "copy")(batch, number)  # as after a crash between the commit and the checkpoint

    def run(name="cp", sink=write):
        q = spark.readStream.format("jsonl_tail").option("rangeBytes", "64").load(str(tmp_path / "projects/*/*.jsonl")).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()

    run()
    with f.open("a") as out:
        out.write(said("user", "three") + said("assistant", "fo")[:-5])
    run()
    rows = store.table("session_events").orderBy("sequence").collect()
    assert [(r.sequence, r.role, r.content, r.client_session_id) for r in rows] == [(1, "user", "one", "c1"), (2, "assistant", "two", "c1"), (3, "user", "three", "c1")]
    mark = store.table("source_watermarks").collect()
    assert [(m.byte_offset, m.line_number) for m in mark] == [(tail.complete_end(str(f)), 4)] and mark[0].fingerprint == tail.fingerprint(str(f), mark[0].byte_offset)
    assert [(s.id, s.project) for s in store.table("sessions").collect()] == [("c1", "p")] and len(seen) >= 2
    run("cp2", copier(store, "other"))
    assert sorted(r.sequence for r in store.table("session_events").collect()) == [1, 2, 3, 4, 5, 6]


def test_extraction_as_a_sink(spark, tmp_path):
    """Marks stop before what fails; the next batch goes on from there, and a replay adds nothing."""
    from mnemolake.operators.extraction import sentences
    from mnemolake.streaming.sink import extractor, shaped

    store = M.Store(spark, f"file://{tmp_path}/store")
    rows = [(f"e{s}", c, s, "message", "user", t) for c, s, t in (("a", 1, "the first of a."), ("b", 2, "the first of b."), ("a", 3, "x" * 60), ("b", 4, "the second of b."), ("a", 5, "the last of a."))]
    store.append("session_events", shaped(spark.createDataFrame(rows, "id string, client_session_id string, sequence long, event_type string, role string, content string"), "session_events"))
    found = lambda: (sorted(r.content for r in store.table("session_facts").collect()), {r.conversation_id: r.last_event_sequence for r in store.table("extract_watermarks").collect()})
    strict, lax = (extractor(store, "extract", sentences(n), size=1, characters=100) for n in (40, 1000))
    strict(None, 0)
    assert found() == (["the first of a", "the first of b", "the second of b"], {"a": 1, "b": 4})
    lax(None, 0)
    assert found()[1] == {"a": 1, "b": 4}
    lax(None, 1)
    assert found() == (sorted(["the first of a", "the first of b", "the second of b", "x" * 60, "the last of a"]), {"a": 5, "b": 4})


def test_stream_marks_and_windows(spark, tmp_path):
    rows = [("c", 3, "2024-01-01 00:10:00", 1.0), ("c", 1, "2024-01-01 00:20:00", 2.0), ("d", 5, "2024-01-01 01:10:00", 3.0)]
    spark.createDataFrame(rows, "conversation string, sequence long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("conversation string, sequence long, ts timestamp, value double").parquet(str(tmp_path / "in"))
    for name, df, mode in (("marked", state.marks(read()), "update"), ("rolled", state.rolling(read(), "ts", ["conversation"], "1 hour", "1 hour", "10 minutes", "value"), "complete")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {(r.conversation, r.mark, r.seen) for r in spark.table("marked").collect()} == {("c", 3, 2), ("d", 5, 1)}
    assert {(r.conversation, r.n, r.total) for r in spark.table("rolled").collect()} == {("c", 2, 3.0), ("d", 1, 3.0)}


def test_policies():
    assert state.due("close", 0, 0, False) and not state.due("close", 0, 0, True) and not state.due("idle", 10, 60, False) and state.due("idle", 10, 120, False)
    assert M.may_take(None, "a", 0) and M.may_take(M.Lease("b", 0), "a", 121) and not M.may_take(M.Lease("b", 0), "a", 100)
    assert (M.room(5, None, 0), M.room(10, 10, 1), M.room(10, 10, 0)) == ("ok", "prune", "refuse")


def test_memory(spark, tmp_path):
    memory = Memory(M.Store(spark, f"file://{tmp_path}/store"), Heuristic([Domain("drinks", ("coffee|tea",), 0.9)]), HashingEmbedder())
    assert memory.get_stats(NOW).first().facts == 0
    for i, text in enumerate(["prefers dark roast coffee", "prefers dark roast coffee", "owns a red bicycle"]):
        memory.capture_fact(f"f{i}", "s", text, NOW)
    assert memory.consolidate("r1", NOW).first().facts_integrated == 2
    memory.capture_fact("f3", "s", "prefers light roast coffee instead", NOW)
    later = NOW + dt.timedelta(days=1)
    memory.consolidate("r2", later)
    facts = {r.id: (r.domain, r.status, r.superseded_by) for r in memory.store.table("facts").collect()}
    assert facts == {"f0": ("drinks", "superseded", "f3"), "f2": ("general", "active", None), "f3": ("drinks", "active", None)}
    # Vectors, relations and run records came with the commits.
    assert sorted(r.fact_id for r in memory.store.table("fact_embeddings").collect()) == ["f0", "f2", "f3"]
    assert [(r.consolidation_id, r.fact_id, r.related_fact_id, r.kind) for r in memory.store.table("fact_relations").collect()] == [("r2", "f3", "f0", "superseded")]
    assert sorted((r.id, r.facts_in, r.facts_integrated) for r in memory.store.table("consolidations").collect()) == [("r1", 2, 2), ("r2", 1, 1)]
    assert memory.store.lease() is None and memory.store.table("intelligence_runs").count() == 2
    now = later + dt.timedelta(days=1)
    assert [r.id for r in memory.search_knowledge("coffee", now).collect()] == ["f3"]
    assert [r.id for r in memory.search_knowledge("coffee dark", now, as_of_system_time="2024-02-01T12:00:00").collect()][:1] == ["f0"]
    assert memory.prune() == 0


def test_a_run_writes_the_graph(spark, tmp_path):
    """Entities, links, edges, sources and domains come with the facts, grow with the next run, and lead back to staged facts."""
    memory = Memory(M.Store(spark, f"file://{tmp_path}/store"), Heuristic())
    both = [{"name": "Ann", "type": "person", "relationship": "subject_of"}, {"name": "Oslo", "type": "place"}]
    memory.capture_fact("f1", "s", "Ann lives in Oslo", NOW, entities=both)
    memory.capture_fact("f2", "s", "tea is hot", NOW, domain_hint="Drinks")
    memory.consolidate("r1", NOW)
    table = lambda n: memory.store.table(n).collect()
    names = {r.id: r.name for r in table("entities")}
    assert sorted(names.values()) == ["Ann", "Oslo"]
    assert sorted((r.fact_id, names[r.entity_id], r.relationship) for r in table("fact_entities")) == [("f1", "Ann", "subject_of"), ("f1", "Oslo", "mentions")]
    (edge,) = table("entity_edges")
    assert {names[edge.from_entity], names[edge.to_entity]} == {"Ann", "Oslo"} and round(edge.strength, 9) == 0.3
    assert sorted(r.name for r in table("domains")) == ["drinks", "general"]
    memory.capture_fact("f3", "s", "Ann works in Oslo too", NOW, entities=both + both)
    memory.consolidate("r2", NOW + dt.timedelta(days=1))
    assert sorted(r.name for r in table("entities")) == ["Ann", "Oslo"] and len(table("fact_entities")) == 4
    assert [round(e.strength, 9) for e in table("entity_edges")] == [0.51]
    assert sorted((r.id, r.metadata) for r in table("sources")) == [(f"src:f{i}", f'{{"session_fact_id":"f{i}"}}') for i in (1, 2, 3)]
    assert {r.id: r.source_id for r in table("facts")} == {f"f{i}": f"src:f{i}" for i in (1, 2, 3)}
    assert all(r.usage == '{"input_tokens": 0, "output_tokens": 0}' for r in table("intelligence_runs"))
    assert sorted(r.id for r in memory.get_entity("ann", NOW + dt.timedelta(days=2)).collect()) == ["f1", "f3"]


def test_a_failing_embedder_loses_no_run(spark, tmp_path):
    class Broken(HashingEmbedder):
        def embed(self, texts):
            raise RuntimeError

    memory = Memory(M.Store(spark, f"file://{tmp_path}/store"), Heuristic(), Broken())
    for i in range(5):
        memory.capture_fact(f"f{i}", "s", f"fact number {i}", NOW)
    memory.consolidate("r1", NOW)
    assert memory.store.table("facts").count() == 5 and memory.store.table("fact_embeddings").count() == 0
    memory.embedder = HashingEmbedder()
    assert memory.embed(NOW, batch=2) == 3 and memory.store.table("fact_embeddings").count() == 5 and memory.embed(NOW) == 0


def test_writers_don_t_lose_each_other_s_commits(spark, tmp_path, monkeypatch):
    store, other = (M.Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    domain = lambda n: spark.createDataFrame([(n, [], NOW)], M.S.schema("domains"))
    store.commit({"domains": domain("a")})
    assert store.take("me", 0.0) and not other.take("you", 60.0) and store.take("me", 90.0) and not other.take("you", 200.0)
    # The holder's heart stops: the lease changes hands, and the late commit of the first holder is refused.
    assert other.take("you", 300.0)
    with pytest.raises(M.Conflict):
        store.commit({"domains": domain("b")}, holder="me")
    store.release("me")
    assert other.lease().holder == "you"
    other.release("you")
    # A rewrite between the read and the commit is seen even without a lease; one of another table doesn't matter.
    base = store.head()
    other.commit({"entities": spark.createDataFrame([], M.S.schema("entities"))})
    store.commit({"domains": domain("b")}, base=base)
    base = store.head()
    other.commit({"domains": domain("c")})
    with pytest.raises(M.Conflict):
        store.commit({"domains": domain("d")}, base=base)
    assert [r.name for r in other.table("domains").collect()] == ["c"]
    # Appends add files alone, and a rewrite keeps what was appended after its read.
    base = store.head()
    other.append("domains", domain("z"))
    assert sorted(r.name for r in other.table("domains").collect()) == ["c", "z"] and len(other.head().tables["domains"]) == 2
    store.commit({"domains": domain("e")}, base=base)
    assert sorted(r.name for r in other.table("domains").collect()) == ["e", "z"]


def test_many_writers_at_once(spark, tmp_path):
    """Appends by eight threads, each with a store of its own, and old versions that go."""
    from concurrent.futures import ThreadPoolExecutor

    def add(i):
        M.Store(spark, f"file://{tmp_path}/s").append("domains", spark.createDataFrame([(f"d{i}", [], NOW)], M.S.schema("domains")))

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(add, range(24)))
    store = M.Store(spark, f"file://{tmp_path}/s")
    assert sorted(r.name for r in store.table("domains").collect()) == sorted(f"d{i}" for i in range(24))
    assert store.head().number == 24


def test_a_dead_writer_s_version_is_void(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M.Store, "PATIENCE", 0.1)
    store = M.Store(spark, f"file://{tmp_path}/s")
    domain = lambda n: spark.createDataFrame([(n, [], NOW)], M.S.schema("domains"))
    store.append("domains", domain("a"))
    (tmp_path / "s" / "_VERSIONS" / f"{2:012d}").touch()
    assert [r.name for r in store.table("domains").collect()] == ["a"]
    store.append("domains", domain("b"))
    assert store.head().number == 3 and sorted(r.name for r in store.table("domains").collect()) == ["a", "b"]


def test_a_capture_during_a_run_stays_staged(spark, tmp_path, monkeypatch):
    """Between the run's first read and its commit, and between the read of staged facts and the pointer's."""
    from mnemolake.operators import consolidate as C

    memory = Memory(M.Store(spark, f"file://{tmp_path}/store"), Heuristic())
    memory.capture_fact("f1", "s", "likes tea", NOW)
    real, late = C.consolidate, []

    def slow(*args):
        if not late:
            late.append(1)
            memory.capture_fact("f2", "s", "likes coffee", NOW)
        return real(*args)

    monkeypatch.setattr(C, "consolidate", slow)
    memory.consolidate("r1", NOW)
    staged = {r.id: r.consolidation_id for r in memory.store.table("session_facts").collect()}
    assert staged == {"f1": "r1", "f2": None} and [r.id for r in memory.store.table("facts").collect()] == ["f1"]
    memory.consolidate("r2", NOW)
    assert {r.id: r.consolidation_id for r in memory.store.table("session_facts").collect()} == {"f1": "r1", "f2": "r2"}
    assert sorted(r.id for r in memory.store.table("facts").collect()) == ["f1", "f2"]


def test_a_heartbeat_keeps_the_lease(spark, tmp_path, monkeypatch):
    import time

    monkeypatch.setattr(M, "BEAT_SECONDS", 0.05)
    store = M.Store(spark, f"file://{tmp_path}/s")
    assert store.take("me", 0.0)
    with store.beating("me"):
        time.sleep(1)
    assert store.lease().heartbeat > 1 and not store.take("you", time.time())


def test_a_failing_embedder_degrades():
    class Broken:
        model, dimensions = "x", 2

        def embed(self, texts):
            raise RuntimeError

    assert query_vector(Broken(), "q") is None and query_vector(None, "q") is None


def test_summary():
    h = Heuristic()
    assert h.summarise([], [], "before") == "before" and h.summarise([("a", 2)], ["x" * 70], "") == "Integrated 2 a. " + "x" * 60
