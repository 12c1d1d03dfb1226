"""Extraction, budgets, marks and topics on small logs; the stream against the batch fold."""

import random

from pyspark.sql import functions as F

from mnemolake.operators import extraction as E
from mnemolake.operators import log as L
from mnemolake.operators import situation as U

LOG = "kind string, conversation string, sequence long, id string, event_type string, role string, content string"


def log(spark, rows):
    """Rows (conversation, sequence, role, content) as a keyed log."""
    return spark.createDataFrame([("client", c, s, f"{c}:{s}", "message", r, t) for c, s, r, t in rows], LOG)


def outcome(**given):
    """A provider's outcome with the columns given, the others null."""
    kinds = {"status": "string", "confidence": "double", "facts": f"array<{E.FACT}>", "now": "string", "referents": "array<string>", "shifted": "boolean"}
    return F.struct(*[(given[c] if c in given else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def said(text):
    return F.array(F.struct(text.alias("content"), F.lit(None).cast("string").alias("domain_hint"), F.lit(None).cast("string").alias("entities_json")))


def leaves(got):
    return sorted((r.conversation, r.lo, r.hi, r.status) for r in got.outcomes.collect())


def test_overflow_is_halved_until_it_fits(spark):
    events = log(spark, [("a", s, "user", "x" * 10) for s in range(1, 8)])
    got = E.extract(events, E.sentences(25), size=7, characters=10)
    assert leaves(got) == [("a", 1, 2, "done"), ("a", 3, 4, "done"), ("a", 5, 6, "done"), ("a", 7, 7, "done")]
    assert got.rounds == 3
    assert E.staged(got.outcomes).count() == 7


def test_single_event_that_overflows_stops_its_conversation_alone(spark):
    """The mark stays before the event; what came after it is the next run's, also where it was done."""
    rows = [("a", 1, "user", "one"), ("a", 2, "user", "x" * 50), ("a", 3, "user", "three"), ("b", 1, "user", "one"), ("b", 2, "user", "two")]
    got = E.extract(log(spark, rows), E.sentences(20), size=1, characters=100)
    assert leaves(got) == [("a", 1, 1, "done"), ("a", 2, 2, "failed"), ("a", 3, 3, "done"), ("b", 1, 2, "done")]
    assert sorted((r.conversation, r.content) for r in E.staged(got.outcomes).collect()) == [("a", "one"), ("b", "one"), ("b", "two")]
    assert {r.conversation: r.last_event_sequence for r in E.marks(log(spark, rows), got.outcomes).collect()} == {"a": 1, "b": 2}


def test_unsure_answers_are_asked_once_more_with_a_reminder(spark):
    """The first batch has nothing before it and is given up: examined, without facts."""
    rows = [("a", s, "user", f"fact {s}") for s in range(1, 31)]
    seen = []

    def provider(asked):
        seen.append({(r.lo, r.again): (len(r.evidence), r.reminder and [e.sequence for e in r.reminder]) for r in asked.collect()})
        return E.sentences(1000, F.lit(True))(asked)

    got = E.extract(log(spark, rows), provider, size=10, characters=7, evidence=3, reread=5)
    found = leaves(got)
    assert found[0][3] == "given_up" and {x[3] for x in found[1:]} == {"done"} and len(found) > 2 and got.rounds == 2
    for (lo, again), (evidence, reminder) in {**seen[0], **seen[1]}.items():
        assert evidence == min(3, lo - 1)
        assert (reminder or None) == ([*range(max(1, lo - 5), lo)] or None if again else None)
    assert [r.last_event_sequence for r in E.marks(log(spark, rows), got.outcomes).collect()] == [30]
    assert min(r["first"] for r in E.staged(got.outcomes).collect()) == found[1][1]


def test_failures_and_missing_confidence(spark):
    rows = [("a", 1, "user", "good"), ("b", 1, "user", "bad"), ("c", 1, "tool", "none")]

    def provider(asked):
        text = F.col("events")[0]["content"]
        return asked.withColumn("outcome", outcome(status=F.when(text == "bad", "failed").otherwise("ok"), facts=F.when(text == "good", said(text))))

    got = E.extract(log(spark, rows), provider)
    assert leaves(got) == [("a", 1, 1, "done"), ("b", 1, 1, "failed"), ("c", 1, 1, "done")]
    assert {r.conversation: r.last_event_sequence for r in E.marks(log(spark, rows), got.outcomes).collect()} == {"a": 1, "c": 1}


def test_budget_admits_the_batch_that_reaches_it(spark):
    rng = random.Random(4)
    costs = [(i, rng.choice([None, 0, 1, 5, 9])) for i in range(300)]
    df = spark.createDataFrame(costs, "id long, cost long").repartition(7)
    for budget, spent in ((0, 0), (1, 0), (500, 0), (500, 480), (500, 500), (10**9, 0)):
        want, total = [], spent
        for i, c in costs:
            if total >= budget:
                break
            want.append(i)
            total += c or 0
        assert sorted(r.id for r in E.admit(df, ["id"], "cost", budget, spent).collect()) == want


def test_budget_leaves_the_tail_unexamined(spark):
    rows = [(c, s * 10 + k, "user", "abcdefgh") for k, c in enumerate("ab") for s in range(1, 5)]
    got = E.extract(log(spark, rows), E.sentences(100), size=2, characters=8, budget=5)
    assert leaves(got) == [("a", 1, 2, "done"), ("a", 3, 4, "done"), ("b", 1, 2, "left"), ("b", 3, 4, "left")]
    assert {r.conversation: r.last_event_sequence for r in E.marks(log(spark, rows), got.outcomes).collect()} == {"a": 40}
    none = E.extract(log(spark, rows), E.sentences(100), size=2, characters=8, budget=0)
    assert {x[3] for x in leaves(none)} == {"left"} and none.rounds == 0
    assert leaves(E.extract(log(spark, []), E.sentences(100))) == []


def test_honest_prefix_of_interleaved_conversations(spark):
    """Sequences of two conversations alternate; each is held by its own remaining events alone."""
    schema = "kind string, conversation string, sequence long"
    examined = spark.createDataFrame([("client", "a", 1), ("client", "b", 2), ("client", "a", 3), ("client", "b", 4), ("client", "a", 7), ("mcp", "a", 9)], schema)
    remaining = spark.createDataFrame([("client", "a", 5), ("client", "b", 2)], schema)
    assert sorted(tuple(r) for r in E.honest(examined, remaining).collect()) == [("client", "a", 1), ("client", "a", 3), ("mcp", "a", 9)]


def test_a_run_marks_what_it_passes_over(spark):
    """Events that aren't eligible, and events without a conversation."""
    rows = [("client", "a", 1, "a1", "message", "user", "a long enough text"), ("client", "a", 2, "a2", "message", "user", "short"), ("unkeyed", "u", 9, "u9", "message", "user", "a long enough text")]
    events = spark.createDataFrame(rows, LOG)
    none = spark.createDataFrame([], "kind string, conversation_id string, last_event_sequence long")
    got, facts, marks = E.run(events, none, E.sentences(1000))
    assert [r.content for r in facts.collect()] == ["a long enough text"]
    assert {(r.kind, r.conversation): r.last_event_sequence for r in marks.collect()} == {("client", "a"): 2, ("unkeyed", "u"): 9}
    again = marks.withColumnRenamed("conversation", "conversation_id")
    assert E.run(events, again, E.sentences(1000))[1].count() == 0


def test_packing_streams(spark):
    rng = random.Random(2)
    rows = [(c, s, "user", "x" * rng.choice([0, 3, 20, 90])) for c in "abc" for s in range(200)]
    got = {(r.conversation, r.sequence): (r.chunk, r.place) for r in L.packed(log(spark, rows), 100, 40, 5).collect()}
    for c in "abc":
        used = chunk = 0
        for n, (_, s, _, t) in enumerate([r for r in rows if r[0] == c], 1):
            cost = min(len(t), 40) + 5
            if used and used + cost > 100:
                used, chunk = 0, chunk + 1
            used += cost
            assert got[c, s] == (chunk, n)


ANSWERS = "kind string, conversation string, first long, before long, now string, referents array<string>, shifted boolean"


def fold_one_by_one(rows):
    """The state after each row that changes it."""
    state, out = {}, []
    for kind, conv, first, before, now, referents, shifted in sorted(rows, key=lambda r: (r[1], r[2])):
        if now is None and referents is None and not shifted:
            continue
        topic, start, mentioned = state.get(conv, (None, None, []))
        closed = None
        if shifted and (topic is not None or mentioned):
            closed = (start if start is not None else before, before, topic or "", mentioned)
            start = None
        state[conv] = (topic if now is None else now, first if start is None else start, mentioned if referents is None else referents[:8])
        out.append((conv, first, *state[conv][:2], tuple(state[conv][2]), closed and (*closed[:3], tuple(closed[3]))))
    return sorted(out, key=str)


def shown(rows):
    return sorted(((r.conversation, r["first"], r.topic, r.start, tuple(r.mentioned), r.closed and (r.closed.start_sequence, r.closed.end_sequence, r.closed.gist, tuple(r.closed.referents))) for r in rows), key=str)


def made(seed, n=150):
    rng = random.Random(seed)
    return [("client", c, 10 * i + 1, 10 * i, rng.choice([None, None, "tea", "work"]), rng.choice([None, [], ["a"], [str(k) for k in range(12)]]), rng.random() < 0.3) for c in "abcd" for i in range(n // 4)]


def test_fold_in_windows_equals_one_by_one(spark):
    rows = made(1)
    df = spark.createDataFrame(rows, ANSWERS)
    got = U.fold(df)
    assert shown(got.collect()) == fold_one_by_one(rows)
    assert U.segments(got).count() == sum(1 for r in fold_one_by_one(rows) if r[-1])
    # A run that goes on from the state of an earlier one.
    early, late = [r for r in rows if r[2] < 200], [r for r in rows if r[2] >= 200]
    first = U.fold(spark.createDataFrame(early, ANSWERS))
    second = U.fold(spark.createDataFrame(late, ANSWERS), U.present(first))
    assert shown(first.union(second).collect()) == fold_one_by_one(rows)


def test_stream_equals_batch_across_a_restart(spark, tmp_path):
    from mnemolake.streaming.situation import ROCKSDB, topics

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        rows = made(7, 80)
        thirds = [[r for r in rows if lo <= r[2] < hi] for lo, hi in ((0, 60), (60, 120), (120, 10**6))]
        for part in thirds:
            # A repeat of the part before changes nothing.
            repeat = thirds[0] if part is thirds[1] else []
            spark.createDataFrame(part + repeat, ANSWERS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = topics(spark.readStream.schema(ANSWERS).parquet(str(tmp_path / "in")))
            q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
            q.awaitTermination(180)
            assert q.exception() is None
        assert shown(spark.read.parquet(str(tmp_path / "out")).collect()) == fold_one_by_one(rows)
    finally:
        spark.conf.set(name, before)


def test_stated_entities_route_rows(spark):
    from mnemolake.operators.consolidate import capitalised, entities_of

    texts = {"whole": '[{"name": " Ann ", "type": "person", "relationship": "subject_of"}]', "malformed": '[{"name"', "null": None, "empty": "[]", "object": "{}", "after": '[{"name": "x"}] y', "partial": '[{"name": "Bo"}, {"type": "t"}, 3, null]', "nameless": '[{"type": "t"}]', "numbers": '[{"name": 5, "type": ["x"]}]', "text": ""}
    df = spark.createDataFrame([(k, "Tea with Cy and Tea", v) for k, v in texts.items()], "id string, content string, entities_json string").withColumn("name", F.lit(1))
    got = {}
    for r in entities_of(df, capitalised()).collect():
        got.setdefault(r.fact_id, []).append((r.name, r.type, r.relationship, r.stated))
    words = [("Cy", "thing", "mentions", False), ("Tea", "thing", "mentions", False)]
    assert got.pop("whole") == [("Ann", "person", "subject_of", True)] and got.pop("partial") == [("Bo", None, None, True)]
    assert [x[0] for x in got.pop("numbers")] == ["5"] and "nameless" not in got
    assert {k: sorted(v) for k, v in got.items()} == {k: words for k in ("malformed", "null", "empty", "object", "after", "text")}
