"""Small literal cases: rules that the driver's tables don't reach."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from mnemolake.functions import predicates as P
from mnemolake.functions import text as X
from mnemolake.functions.vectors import cosine, pack, unpack
from mnemolake.operators import consolidate as C
from mnemolake.operators import facts as K
from mnemolake.operators import graph as G
from mnemolake.operators import log as L
from mnemolake.operators import search as R
from mnemolake.operators import usage as U


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()[0]


@pytest.mark.parametrize(
    "value, f, want",
    [
        ("  Hello   World!!. ", X.dedup_key, "hello world"),
        ("Mary-Jane_O'Neil", X.fold, "mary jane o neil"),
        ("", X.domain_name, "general"),
        (" Work  Notes ", X.domain_name, "work_notes"),
        ("a <user_query> hi </user_query> b", X.spoken_text, "hi"),
        ("plain", X.spoken_text, "plain"),
        ("Yes!", X.is_assent, True),
        ("yesterday", X.is_assent, False),
        ("I don't like it", X.has_negation, True),
        ("nothing", X.has_negation, False),
        ("/home/Me/app/", X.group_dir_slug, "home-me-app"),
        ("C:\\dev\\app", X.group_dir_plain, "C--dev-app"),
        ("%2Fhome%2Fme", X.project_key, "home-me"),
        ("12345", X.project_key, None),
        ("x-0123456789abcdef", X.project_key, None),
        ("2GB", X.size_bytes, 2 << 30),
        ("2 parsecs", X.size_bytes, None),
        ("1.5k", X.token_count, 1500),
        ("3MB", X.token_count, None),
        ("stage-1-extract", X.stage_name, "extract"),
        ("stage-7-other", X.stage_name, "other"),
        ('  {"a": 1} ', X.looks_json, True),
        ("2024-13-01", X.iso_timestamp, None),
        ("the user likes tea", X.about_user, True),
        ("<task-notification>", X.is_noise, True),
    ],
)
def test_text(spark, value, f, want):
    assert one(spark, value, f) == want


def test_project_relation(spark):
    rows = [("a", "a", "same"), ("a-b", "a", "same"), ("ab", "a", "different"), (None, "a", "not_comparable"), (None, None, "not_comparable")]
    df = spark.createDataFrame(rows, "a string, b string, want string").withColumn("got", X.project_relation(F.col("a"), F.col("b")))
    assert all(r.got == r.want for r in df.collect())


def test_temporal_score(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    rows = [("2024-02-01", 1.0, 1.0), ("2024-01-02", 1.0, 0.5), ("2024-01-02", 0.0, 1 / 11), ("2024-03-01", 0.5, 1.0)]
    df = spark.createDataFrame(rows, "d string, importance double, want double").withColumns({"valid_from": F.lit(None).cast("timestamp"), "created_at": F.col("d").cast("timestamp")})
    assert all(abs(r.got - r.want) < 1e-9 for r in df.withColumn("got", P.temporal_score(now)).collect())


def test_system_time():
    assert P.parse_system_time("2024-01-02").isoformat() == "2024-01-02T00:00:00+00:00"
    with pytest.raises(ValueError):
        P.parse_system_time("yesterday")
    assert P.system_time_warning(P.parse_system_time("2024-01-02"), None)
    assert P.system_time_warning(P.parse_system_time("2024-01-02"), P.parse_system_time("2024-01-01")) is None


def test_bm25(spark):
    corpus = spark.createDataFrame([(1, "dark coffee coffee"), (2, "dark tea no longer"), (3, "longer no"), (4, "plain"), (5, "words")], "id int, content string")
    queries = spark.createDataFrame([("one", "coffee"), ("phrase", "no-longer"), ("both", "dark tea"), ("none", "absent dark"), ("marks", "? coffee"), ("empty", "?")], "query_id string, query string")
    got = {(r.query_id, r.id): r.score for r in R.bm25(R.indexed(corpus, "id", ["content"]), queries).collect()}
    mean, n = (3 + 4 + 2 + 1 + 1) / 5, 5

    def part(df, f, d):
        return math.log((n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean))

    assert set(got) == {("one", 1), ("phrase", 2), ("both", 2), ("marks", 1)}
    assert got["one", 1] == pytest.approx(part(1, 2, 3))
    assert got["phrase", 2] == pytest.approx(part(1, 1, 4))
    assert got["both", 2] == pytest.approx(part(2, 1, 4) + part(1, 1, 4))


def test_bm25_frequent_term_keeps_a_little_weight(spark):
    corpus = spark.createDataFrame([(i, "same") for i in range(4)], "id int, content string")
    queries = spark.createDataFrame([("q", "same")], "query_id string, query string")
    assert all(0 < r.score < 1e-5 for r in R.bm25(R.indexed(corpus, "id", ["content"]), queries).collect())


def test_rrf_starts_at_zero(spark):
    a = spark.createDataFrame([("q", 1, 0), ("q", 2, 1)], "query_id string, id int, rank0 long")
    got = {r.id: r.rrf for r in R.rrf([a, a.where("id = 2").withColumn("rank0", F.lit(0).cast("long"))]).collect()}
    assert got[1] == pytest.approx(1 / 60) and got[2] == pytest.approx(1 / 61 + 1 / 60)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(2**-0.5) and got[1] == 0
    assert unpack(pack([0.5, -0.0])) == [0.5, -0.0]
    with pytest.raises(ValueError):
        unpack(b"abc")


def test_vector_floor_comes_before_ratio(spark):
    v = spark.createDataFrame([(1, "m", 2, [1.0, 0.0]), (2, "m", 2, [0.9, 0.5]), (3, "m", 2, [0.0, 1.0]), (4, "x", 2, [1.0, 0.0])], "fact_id int, model string, dimensions int, vector array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0], "m", 2)], "query_id string, query_vector array<float>, model string, dimensions int")
    live = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    assert [r.id for r in R.vector_list(v, q, live, 10, 0.0, 0.85).orderBy("rank0").collect()] == [1, 2]
    assert R.vector_list(v, q, live, 10, 1.1, 0.85).count() == 0


def test_ann_gate():
    assert not R.should_use_ann(False, True, 10**9, 512) and not R.should_use_ann(True, False, 1, 1)
    assert R.should_use_ann(True, True, 1, 1) and R.should_use_ann(None, True, 8193, 1024) and not R.should_use_ann(None, True, 8192, 1024)


def test_approximate_neighbours_find_the_same(spark):
    """Two shards, two models, null and zero vectors; what is found goes through the same floor and liveness."""
    import random

    from mnemolake.operators import neighbourgraph as N

    rng = random.Random(5)
    rows = [(i, "mn"[i % 7 == 0], 8, [rng.gauss(0, 1) + 4 * (i % 4 == k % 4) for k in range(8)]) for i in range(200)] + [(900, "m", 8, [0.0] * 8), (901, "m", 8, None)]
    v = spark.createDataFrame(rows, "fact_id int, model string, dimensions int, vector array<float>")
    q = v.where("fact_id < 10").select(F.col("fact_id").cast("string").alias("query_id"), F.col("vector").alias("query_vector"), "model", "dimensions")
    exact = R.ranked(R.similarities(v.where("vector is not null"), q, -1.0), [F.desc("similarity"), F.col("id")], 5)
    graph = N.build(v, degree=8, shard_rows=100)
    found = N.search(graph, q, 5)
    assert N.recall(found, exact).first().recall >= 0.9 and {r.query_id: r.n for r in found.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {str(i): 5 for i in range(10)}
    assert graph.links.groupBy("model", "shard", "id").count().agg(F.max("count")).first()[0] <= 2 * 8 + N.RANDOM
    assert graph.nodes.select("shard").distinct().count() == 2
    live = v.where("fact_id % 2 = 1").select(F.col("fact_id").alias("id"))
    near = R.vector_recall(v.where("vector is not null"), q, live, 5, 0.0, 0.0, ann=True).collect()
    assert near and all(r.id % 2 for r in near)


def test_hybrid_is_exact_at_any_size(spark, monkeypatch):
    """Vectors above the size from which a graph would be in order: no neighbour is missed."""
    import random

    rng = random.Random(7)
    one = lambda: [rng.gauss(0, 1) for _ in range(128)]
    v = spark.createDataFrame([(i, "m", 128, one()) for i in range(3000)], "fact_id int, model string, dimensions int, vector array<float>")
    q = spark.createDataFrame([(f"q{k}", one(), "m", 128) for k in range(60)], "query_id string, query_vector array<float>, model string, dimensions int")
    absent = lambda *names: [f"cast(null as timestamp) as {n}" for n in names]
    facts = spark.range(3000).selectExpr("cast(id as int) as id", "'x' as content", "'d' as domain", "'s' as subdomain", "'active' as status", "true as is_latest", "0.5D as confidence", "0.5D as importance", "timestamp '2024-01-01' as created_at", *absent("valid_from", "valid_until", "system_retired_at"))
    want = {(r.query_id, r.id) for r in R.vector_list(v, q, facts, R.pool(10)).where("rank0 < 10").collect()}
    monkeypatch.setattr(R.S, "ANN_BYTES", 0)
    got = {(r.query_id, r.id) for r in R.hybrid(facts, q.select("query_id", F.lit("none").alias("query")), F.expr("timestamp '2024-02-01'"), 10, vectors=v, query_vectors=q).collect()}
    assert len(want) > 200 and got == want


def test_equal_vectors_are_equally_similar(spark):
    """Wherever they are: in a full portion of a batch, and among the three that are left."""
    import random

    rng = random.Random(3)
    one, n = [rng.gauss(0, 1) for _ in range(64)], R.PORTION + 3
    v = spark.createDataFrame([(n - i, "m", 64, one) for i in range(n)], "fact_id int, model string, dimensions int, vector array<float>").coalesce(1)
    q = spark.createDataFrame([(f"q{k}", [a + rng.gauss(0, 1) for a in one], "m", 64) for k in range(4)], "query_id string, query_vector array<float>, model string, dimensions int")
    assert R.similarities(v, q, -1.0).select("query_id", "similarity").distinct().count() == 4
    got = R.vector_list(v, q, v.select(F.col("fact_id").alias("id")), 50).collect()
    assert {r.query_id for r in got} == {f"q{k}" for k in range(4)} and all(r.id == r.rank0 + 1 for r in got) and len(got) == 200


def test_closure_stops_at_the_cap(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(40)] + [("a", "b"), ("b", "c")], "from_entity string, to_entity string")
    seeds = spark.createDataFrame([("n00",), ("a",), ("z",)], "seed string")
    got = {}
    for r in G.same_as_closure(seeds, edges).collect():
        got.setdefault(r.seed, set()).add(r.member)
    assert got == {"n00": {"n00"}, "a": {"a", "b", "c"}, "z": {"z"}}


def test_ambiguous_fold_finds_nothing(spark):
    e = spark.createDataFrame([("1", "Ann-Lee", "ann-lee"), ("2", "Ann Lee", "ann lee"), ("3", "Bo_Ek", "bo_ek")], "id string, name string, canonical_name string")
    n = spark.createDataFrame([("ann_lee",), ("ANN LEE",), ("Bo Ek",)], "name string")
    assert {(r.name, r.id) for r in G.resolve_names(n, e).collect()} == {("ANN LEE", "2"), ("Bo Ek", "3")}


def test_strength_is_the_recurrence(spark):
    s = 0.0
    for n in range(1, 6):
        s += (1 - s) * 0.3
        got = spark.range(1).select(G.potentiated(F.lit(n)).alias("x"), G.potentiated(F.lit(1), F.lit(s)).alias("y")).first()
        assert got.x == pytest.approx(s) and got.y == pytest.approx(s + (1 - s) * 0.3)


def log(spark):
    rows = [
        ("1", "c", None, 1, "message", "user", "I like green tea"), ("2", "c", "", 2, "message", "assistant", "noted: I like green tea"), ("3", "c", None, 3, "tool_result", "tool", '{"name": "shop", "x": "I like green tea"}'),
        ("4", "c", None, 4, "message", "user", "Yes."), ("5", "", "m", 5, "message", "user", "other"), ("6", None, None, 6, "message", "user", None), ("7", "c", None, 7, "message", "user", "I like green tea"),
    ]
    return L.keyed(spark.createDataFrame(rows, "id string, client_session_id string, mcp_session_id string, sequence long, event_type string, role string, content string"))


def test_conversations(spark):
    assert {r.id: (r.kind, r.conversation) for r in log(spark).collect() if r.id in "156"} == {"1": ("client", "c"), "5": ("mcp", "m"), "6": ("unkeyed", "6")}


def test_provenance(spark):
    facts = spark.createDataFrame([(9, "c", "I like green tea"), (10, "c", "absent")], "id int, conversation string, content string")
    got = {(r.session_fact_id, r.extraction_type): r.event_id for r in L.provenance(facts, log(spark)).collect()}
    assert got == {(9, "primary"): "1", (9, "observation"): "3", (9, "restatement"): "2", (9, "assent"): "4", (9, "corroborating"): "7"}


def test_marks_and_prune(spark):
    marks = spark.createDataFrame([("client", "c", 4), ("mcp", "m", 5), ("unkeyed", "6", 6)], "kind string, conversation_id string, last_event_sequence long")
    assert L.global_mark(log(spark), marks).first().mark == 6
    assert [r.id for r in L.unexamined(log(spark), marks).collect()] == ["7"]
    sources = spark.createDataFrame([("1",)], "event_id string")
    assert {r.id for r in L.prunable(log(spark), marks, sources, 1).collect()} == {"2", "3", "4"}
    assert L.pruned(log(spark), marks, sources, 1).count() == 4


def test_cap_takes_oldest_conversations_first(spark):
    none = spark.createDataFrame([], "kind string, conversation_id string, last_event_sequence long")
    assert {r.id for r in L.admitted(log(spark), none, 3).collect()} == {"1", "2", "3"}
    assert L.admitted(log(spark), none, None).count() == 7


def test_packing_starts_anew(spark):
    got = {r.id: r.chunk for r in L.packed(log(spark), characters=160, most=16).collect()}
    assert [got[i] for i in "12347"] == [0, 0, 1, 1, 2]


def test_tool_names_stop_at_a_user(spark):
    got = {r.id: r.tool for r in L.tool_names(log(spark)).collect()}
    assert got["3"] == "shop" and got["4"] is None


def test_names_in_text(spark):
    names = spark.createDataFrame([("e1", "GREEN tea"), ("e2", "shop"), ("e3", "")], "id string, name string")
    got = {(r.entity_id, r.event_id) for r in L.names_in_text(names, log(spark), keep=2).collect()}
    assert got == {("e1", "7"), ("e1", "3"), ("e2", "3")}


def test_twins(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "Tea.", "a", "inferred", t), (2, "tea", "b", "explicit", t), (3, "TEA", "b-x", "inferred", t), (4, "tea!", None, "inferred", t), (5, "milk", "a", "inferred", t)]
    df = spark.createDataFrame(rows, "id int, content string, project string, source_origin string, created_at timestamp")
    assert {r.id: r.fate for r in C.twins(df).collect()} == {1: "corroborates", 2: "stays", 3: "rejected", 4: "rejected", 5: "stays"}


def test_supersession_claims_once(spark):
    t = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([(1, "prefers dark roast coffee", "d", None, t, "active", True, None)], "id int, content string, domain string, project string, created_at timestamp, status string, is_latest boolean, valid_until timestamp")
    new = spark.createDataFrame([(7, 0, "prefers light roast coffee instead", "d", None), (8, 1, "prefers no dark roast coffee instead", "d", None), (9, 2, "prefers dark roast coffee often", "d", None)], "id int, position int, content string, domain string, project string")
    got = {r.new_id: r.accepted for r in C.supersessions(new, old, F.lit("2024-02-01").cast("timestamp")).collect()}
    assert got == {7: True, 8: False}


def test_budget_counts_from_the_cutoff_on(spark):
    now = dt.datetime(2024, 1, 2)
    runs = spark.createDataFrame([("p", now - dt.timedelta(hours=1), 5, 1), ("p", now - dt.timedelta(hours=1, seconds=1), 7, 0), ("q", now, None, 3)], "provider string, created_at timestamp, input_tokens long, output_tokens long")
    caps = spark.createDataFrame([("p", "hour", 6), ("p", "day", 100), ("q", "day", 9)], "provider string, scale string, cap long")
    report = U.budget(runs, caps, F.lit(now).cast("timestamp"))
    got = {(r.provider, r.scale): (r.used, r.remaining, r.unmetered) for r in report.collect()}
    assert got == {("p", "hour"): (6, 0, False), ("p", "day"): (13, 87, False), ("q", "day"): (3, 6, True)}
    assert {r.provider: r.reason for r in U.breach(report).collect()} == {"p": "hour", "q": "unmetered"}


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, 5)], "k string, v int, at int")
    new = spark.createDataFrame([("a", 2, 5), ("b", 3, 1), ("b", 4, 0)], "k string, v int, at int")
    assert {(r.k, r.v) for r in K.upsert_last(old, new, ["k"], "at").collect()} == {("a", 2), ("b", 3)}
    assert {(r.k, r.v) for r in K.insert_ignore(old, new, ["k"], [F.col("at")]).collect()} == {("a", 1), ("b", 4)}
    assert {(r.k, r.at) for r in K.advance_watermarks(old.select("k", "at"), new.select("k", F.lit(3).alias("at")), ["k"], "at").collect()} == {("a", 5), ("b", 3)}


def test_the_graph_finds_what_is_near_queries_that_it_does_not_hold(spark):
    """Vectors without structure, in several shards: nine tenths of the nearest."""
    import numpy as np

    from mnemolake.operators import neighbourgraph as N

    made = np.random.default_rng(3).normal(size=(3060, 48)).astype("float32").tolist()
    v = spark.createDataFrame([(i, "m", 48, x) for i, x in enumerate(made[:3000])], "fact_id long, model string, dimensions int, vector array<float>")
    q = spark.createDataFrame([(str(i), x, "m", 48) for i, x in enumerate(made[3000:])], "query_id string, query_vector array<float>, model string, dimensions int")
    exact = R.ranked(R.similarities(v, q, -1.0), [F.desc("similarity"), F.col("id")], 10)
    assert N.recall(N.search(N.build(v, shard_rows=1000), q, 10), exact).first().recall >= 0.9
    assert N.search(N.build(v.limit(0)), q, 10).count() == 0 and N.search(N.build(v.limit(1)), q, 10).count() == 60


def test_a_task_keeps_the_nearest_of_each_query(spark):
    """Equal vectors in many portions: the same rows as ranking all similarities, and no more than so many from a task."""
    rows = [(i, "m", 2, [1.0, float(i % 3)]) for i in range(5000)]
    v = spark.createDataFrame(rows, "fact_id long, model string, dimensions int, vector array<float>").coalesce(1)
    q = spark.createDataFrame([("a", [1.0, 0.0], "m", 2), ("b", [1.0, 2.0], "m", 2), ("c", [0.0, -1.0], "m", 2)], "query_id string, query_vector array<float>, model string, dimensions int")
    order = [F.desc(F.round("similarity", 9)), F.col("id")]
    some = R.nearest(v, q, 0.1, 7)
    assert some.count() == 14
    shown = lambda df: sorted((r.query_id, r.id, r.rank0) for r in R.ranked(df, order, 7).collect())
    assert shown(some) == shown(R.similarities(v, q, 0.1))


def test_edges_at_entities(spark):
    """Only pairs with an asked end, each once though both ends are asked and links repeat, counted over all facts."""
    rows = [(f, e) for f, es in ((1, "abc"), (2, "abd"), (3, "cd"), (4, "a"), (5, "bbaa")) for e in es]
    links = spark.createDataFrame(rows + rows[:4], "fact_id long, entity_id string")
    at = spark.createDataFrame([("a",), ("b",), ("nobody",)], "id string")
    whole = {(r.a, r.b, r.n) for r in G.co_occurrences(links).collect()}
    got = [(r.a, r.b, r.n) for r in G.co_occurrences(links, at).collect()]
    assert sorted(got) == sorted(w for w in whole if set(w[:2]) & {"a", "b"}) and ("a", "b", 3) in got and ("c", "d", 1) not in got


def test_context_of_repeated_links(spark):
    """The newest facts are different ones, however often a link is stated; centers are no neighbours."""
    edges = spark.createDataFrame([("a", "b", "co_mentioned", 0.3), ("c", "a", "co_mentioned", 0.5), ("a", "z", "co_mentioned", 0.9), ("a", "s", "same_as", 1.0)], "from_entity string, to_entity string, relationship string, strength double")
    links = spark.createDataFrame([(f, "b", "m") for f in (9, 9, 9, 8, 8, 7)] + [(5, "c", "m"), (9, "c", "m"), (9, "c", "n")], "fact_id long, entity_id string, relationship string")
    got = G.context(spark.createDataFrame([("a",), ("z",)], "id string"), edges, links, 10, 2).collect()
    assert sorted((r.center, r.neighbour, r.fact_id) for r in got) == [("a", "b", 8), ("a", "b", 9), ("a", "c", 5), ("a", "c", 9)]


def test_a_run_meets_facts_of_its_domains(spark):
    """Equal texts of other domains, closed facts and null texts are no match; a replacement is claimed within the domain."""
    t = dt.datetime(2024, 1, 1)
    columns = "id int, content string, project string, domain_hint string, source_origin string, created_at timestamp"
    staged = spark.createDataFrame([(1, "Tea.", None, "a", "explicit", t), (2, "milk", None, "a", "explicit", t), (3, None, None, "a", "explicit", t), (4, "no longer sugar in coffee", None, "a", "explicit", t), (5, "old", None, "b", "explicit", t)], columns)
    columns = "id int, content string, domain string, project string, status string, is_latest boolean, superseded_by int, confidence double, importance double, created_at timestamp, valid_from timestamp, valid_until timestamp, system_retired_at timestamp"
    held = lambda i, content, domain, latest=True: (i, content, domain, None, "active", latest, None, 0.7, 0.5, t, t, None, None)
    facts = spark.createDataFrame([held(11, "tea", "a"), held(10, "TEA!", "a"), held(12, "milk", "c"), held(13, None, "a"), held(14, "sugar in coffee", "a"), held(15, "sugar in coffee", "c"), held(16, "old", "b", False)], columns)
    out = C.consolidate(staged, facts, F.lit("2024-02-01").cast("timestamp"), [], "r")
    assert {r.id: (r.outcome, r.existing_id) for r in out["decisions"].collect()} == {1: ("noop", 10), 2: ("add", None), 3: ("add", None), 4: ("add", None), 5: ("add", None)}
    assert out["counts"].first()[:] == (5, 4, 1)
    assert [(r.fact_id, r.related_fact_id) for r in out["relations"].collect()] == [("4", "14")]
    assert {r.id for r in out["facts"].where("status = 'superseded'").collect()} == {14} and out["facts"].count() == 11
