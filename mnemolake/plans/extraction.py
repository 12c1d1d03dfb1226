"""Queries of extraction: batches, retries, budgets, marks, topics, entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.functions.predicates import eligible
from mnemolake.operators import extraction as E
from mnemolake.operators import log as L
from mnemolake.plans import adapters as A
from mnemolake.plans.catalog import CTE, query

#: Of the queries: a batch has some four thousand characters, the provider takes 1,500 and is unsure about every third beginning.
SIZE, CHARACTERS, OVERFLOW = 2, 2000, 1500


def events(spark, sf):
    return L.keyed(A.session_events(spark, sf))


def extracted(spark, sf, **options):
    """(events taken on, the extraction)."""
    loaded = L.unexamined(events(spark, sf), A.extract_watermarks(spark, sf))
    return loaded, E.extract(loaded.where(eligible()), E.sentences(OVERFLOW, F.col("first") % 3 == 0, F.col("last") % 2 == 1), SIZE, CHARACTERS, **options)


_PACK = """{name} AS (SELECT kind, conversation, place, len AS used, 0 AS chunk FROM {of} WHERE place = 1
      UNION ALL SELECT e.kind, e.conversation, e.place, CASE WHEN p.used > 0 AND p.used + e.len > {most} THEN e.len ELSE p.used + e.len END, CASE WHEN p.used > 0 AND p.used + e.len > {most} THEN p.chunk + 1 ELSE p.chunk END
      FROM {name} p JOIN {of} e ON e.kind = p.kind AND e.conversation = p.conversation AND e.place = p.place + 1)"""

#: Batches by halving whatever overflows, their status, and the first that failed in each conversation.
_LEAVES = f"""WITH RECURSIVE {CTE["session_events"]}, {CTE["extract_watermarks"]},
    rest AS (SELECT e.* FROM session_events e LEFT JOIN extract_watermarks m ON m.kind = e.kind AND m.conversation_id = e.conversation WHERE e.sequence > coalesce(m.last_event_sequence, 0)),
    el AS (SELECT *, length(substr(content, 1, {CHARACTERS})) AS len, row_number() OVER (PARTITION BY kind, conversation ORDER BY sequence) AS place
      FROM rest WHERE role IN ('user', 'assistant', 'tool') AND length(coalesce(content, '')) >= 10),
    cum AS (SELECT *, sum(len) OVER (PARTITION BY kind, conversation ORDER BY place) AS total FROM el),
    {_PACK.format(name="pk", of="el", most=SIZE * CHARACTERS)},
    chunks AS (SELECT kind, conversation, chunk, min(place) AS lo, max(place) AS hi FROM pk GROUP BY ALL),
    sized AS (SELECT chunks.*, sum(ceil(len / 4))::BIGINT AS cost, min(sequence) AS first FROM chunks JOIN el ON el.kind = chunks.kind AND el.conversation = chunks.conversation AND el.place BETWEEN lo AND hi GROUP BY ALL),
    b AS (SELECT kind, conversation, chunk, lo, hi FROM chunks
      UNION ALL SELECT b.kind, b.conversation, b.chunk, CASE h WHEN 0 THEN lo ELSE lo + (hi - lo + 2) // 2 END, CASE h WHEN 0 THEN lo + (hi - lo + 2) // 2 - 1 ELSE hi END
      FROM b JOIN cum f ON f.kind = b.kind AND f.conversation = b.conversation AND f.place = lo JOIN cum l ON l.kind = b.kind AND l.conversation = b.conversation AND l.place = hi, (VALUES (0), (1)) v(h)
      WHERE hi > lo AND l.total - f.total + f.len > {OVERFLOW}),
    leaves AS (SELECT b.kind, b.conversation, chunk, lo, hi, f.sequence AS first, l.sequence AS last, hi - lo + 1 AS n,
        CASE WHEN l.total - f.total + f.len > {OVERFLOW} THEN 'failed' WHEN f.sequence % 3 = 0 AND lo = 1 THEN 'given_up' ELSE 'done' END AS status,
        l.total - f.total + f.len <= {OVERFLOW} AND f.sequence % 3 = 0 AS again
      FROM b JOIN cum f ON f.kind = b.kind AND f.conversation = b.conversation AND f.place = lo JOIN cum l ON l.kind = b.kind AND l.conversation = b.conversation AND l.place = hi
      WHERE hi = lo OR l.total - f.total + f.len <= {OVERFLOW}),
    stop AS (SELECT kind, conversation, min(first) AS halt FROM leaves WHERE status = 'failed' GROUP BY ALL),
    marks AS (SELECT kind, conversation, max(sequence) AS mark FROM (
        SELECT kind, conversation, sequence FROM rest ANTI JOIN stop USING (kind, conversation)
        UNION ALL SELECT kind, conversation, last FROM leaves LEFT JOIN stop USING (kind, conversation) WHERE status <> 'failed' AND (halt IS NULL OR last < halt)) GROUP BY ALL)
"""


@query("ss_split", _LEAVES + "SELECT kind, conversation, chunk::BIGINT AS chunk, lo, hi, n, status = 'failed' AS failed FROM leaves")
def _(spark, sf):
    _, got = extracted(spark, sf)
    return got.outcomes.select("kind", "conversation", "chunk", "lo", "hi", "n", (F.col("status") == "failed").alias("failed"))


@query("ss_reread", _LEAVES + "SELECT kind, conversation, lo, hi, status FROM leaves WHERE again")
def _(spark, sf):
    _, got = extracted(spark, sf)
    return got.outcomes.where("again").select("kind", "conversation", "lo", "hi", "status")


@query("ss_prefix", _LEAVES + "SELECT kind, conversation, lo, hi FROM leaves LEFT JOIN stop USING (kind, conversation) WHERE status = 'done' AND (halt IS NULL OR last < halt)")
def _(spark, sf):
    _, got = extracted(spark, sf)
    return E.committed(got.outcomes).select("kind", "conversation", "lo", "hi")


@query(
    "co_extract",
    _LEAVES + """, said AS (SELECT leaves.kind, leaves.conversation, count(*) FILTER (trim(regexp_extract(el.content, '^[^.!?]*')) <> '') AS facts FROM leaves LEFT JOIN stop USING (kind, conversation) JOIN el ON el.kind = leaves.kind AND el.conversation = leaves.conversation AND el.place BETWEEN lo AND hi
        WHERE status = 'done' AND (halt IS NULL OR last < halt) AND role = 'user' GROUP BY ALL)
    SELECT r.kind, r.conversation, any_value(mark) AS mark, any_value(coalesce(facts, 0))::BIGINT AS facts FROM (SELECT DISTINCT kind, conversation FROM rest) r
    LEFT JOIN marks m ON m.kind = r.kind AND m.conversation = r.conversation LEFT JOIN said s ON s.kind = r.kind AND s.conversation = r.conversation GROUP BY ALL""",
)
def _(spark, sf):
    """How far each conversation was examined and how many facts that staged."""
    loaded, got = extracted(spark, sf)
    facts = E.staged(got.outcomes).groupBy("kind", "conversation").agg(F.count("*").alias("facts"))
    marks = E.marks(loaded, got.outcomes).withColumnRenamed("last_event_sequence", "mark")
    every = loaded.select("kind", "conversation").distinct()
    return every.join(marks, ["kind", "conversation"], "left").join(facts, ["kind", "conversation"], "left").na.fill(0, ["facts"])


@query(
    "ss_budget_stop",
    _LEAVES + """, o AS (SELECT *, min(first) OVER (PARTITION BY kind, conversation) AS oldest FROM sized),
    a AS (SELECT *, coalesce(sum(cost) OVER (ORDER BY oldest, kind, conversation, lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < sum(cost) OVER () / 2 AS admitted FROM o)
    SELECT kind, conversation, chunk::BIGINT AS chunk, NOT admitted AS unexamined FROM a""",
)
def _(spark, sf):
    """A run that may spend half of what all batches cost: which ones it leaves to the next."""
    loaded = L.unexamined(events(spark, sf), A.extract_watermarks(spark, sf))
    _, cost = E.batches(loaded.where(eligible()), SIZE, CHARACTERS)
    half = cost.agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0] / 2
    _, got = extracted(spark, sf, budget=half)
    return got.outcomes.groupBy("kind", "conversation", "chunk").agg(F.bool_and(F.col("status") == "left").alias("unexamined"))


@query("wn_pack", f"""WITH RECURSIVE {CTE["session_events"]},
    el AS (SELECT *, least(length(coalesce(content, '')), 600) + 64 AS len, row_number() OVER (PARTITION BY kind, conversation ORDER BY sequence) AS place FROM session_events),
    {_PACK.format(name="pk", of="el", most=1500)}
    SELECT e.conversation, e.id, e.sequence, chunk::BIGINT AS chunk, e.place FROM pk JOIN el e USING (kind, conversation, place)""")  # fmt: skip
def _(spark, sf):
    return L.packed(events(spark, sf), characters=1500, most=600)


#: The fold in SQL: the last topic named, the referents of the row, segments at shifts.
_FOLD = _LEAVES + """, ok AS (SELECT l.*, coalesce(lag(last) OVER (PARTITION BY l.kind, l.conversation ORDER BY lo), m.last_event_sequence, 0) AS before
      FROM leaves l LEFT JOIN stop USING (kind, conversation) LEFT JOIN extract_watermarks m ON m.kind = l.kind AND m.conversation_id = l.conversation WHERE status <> 'failed' AND (halt IS NULL OR last < halt)),
    said AS (SELECT ok.kind, ok.conversation, ok.first, ok.last, ok.before, coalesce(list(el.id ORDER BY sequence) FILTER (role = 'user'), []) AS refs
      FROM ok JOIN el ON el.kind = ok.kind AND el.conversation = ok.conversation AND el.place BETWEEN lo AND hi WHERE status = 'done' GROUP BY ALL),
    st AS (SELECT *, last_value(refs[-1] IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS topic, refs[1:8] AS mentioned, row_number() OVER w AS rn FROM said WINDOW w AS (PARTITION BY kind, conversation ORDER BY first)),
    tr AS (SELECT *, lag(topic) OVER w AS had, lag(mentioned) OVER w AS were, last % 2 = 1 AND (lag(topic) OVER w IS NOT NULL OR coalesce(len(lag(mentioned) OVER w), 0) > 0) AS turned FROM st WINDOW w AS (PARTITION BY kind, conversation ORDER BY first)),
    sf AS (SELECT *, last_value(CASE WHEN turned OR rn = 1 THEN first END IGNORE NULLS) OVER (PARTITION BY kind, conversation ORDER BY first ROWS UNBOUNDED PRECEDING) AS start FROM tr),
    fold AS (SELECT *, lag(start) OVER (PARTITION BY kind, conversation ORDER BY first) AS begun FROM sf)
"""


def folded(spark, sf):
    from mnemolake.operators import situation as U

    _, got = extracted(spark, sf)
    return U.fold(U.answers(got.outcomes, A.extract_watermarks(spark, sf)))


@query("ss_situation", _FOLD + "SELECT kind, conversation, topic, start, array_to_string(mentioned, ' ') AS mentioned FROM fold QUALIFY row_number() OVER (PARTITION BY kind, conversation ORDER BY first DESC) = 1")
def _(spark, sf):
    from mnemolake.operators.situation import present

    return present(folded(spark, sf)).withColumn("mentioned", F.array_join("mentioned", " "))


@query("fn_situation", _FOLD + "SELECT kind, conversation, begun AS start_sequence, before AS end_sequence, coalesce(had, '') AS gist, array_to_string(were, ' ') AS referents FROM fold WHERE turned")
def _(spark, sf):
    from mnemolake.operators.situation import segments

    return segments(folded(spark, sf)).withColumn("referents", F.array_join("referents", " "))


@query("xs_situation", _FOLD + """SELECT kind, conversation, arg_max(topic, first) AS now, to_json(arg_max(mentioned, first)) AS now_referents,
    coalesce(to_json(list({'start_sequence': begun, 'end_sequence': before, 'gist': coalesce(had, ''), 'referents': were} ORDER BY first) FILTER (turned)), '[]') AS segments FROM fold GROUP BY ALL""")  # fmt: skip
def _(spark, sf):
    from mnemolake.operators.situation import as_json

    return as_json(folded(spark, sf))


#: What stands for the statements of extractions: whole, malformed, missing, empty, no array, partial, with text after it, of other types.
_STATED = """CASE id % 8 WHEN 0 THEN '[{"name": "N' || id || '", "type": "thing", "relationship": "subject_of"}]' WHEN 1 THEN '[{"name": ' WHEN 3 THEN '[]' WHEN 4 THEN '{"name": "x"}'
    WHEN 5 THEN '[{"name": "A"}, {"type": "t"}, {"name": " ", "type": "t"}]' WHEN 6 THEN '[{"name": "B"}] and more' WHEN 7 THEN '[7, {"name": "C", "type": null, "relationship": "near"}]' END"""


@query(
    "co_entities",
    f""", s AS (SELECT id, content, {_STATED} AS entities_json FROM session_facts),
    p AS (SELECT *, CASE WHEN json_valid(entities_json) THEN json_type(entities_json) = 'ARRAY' AND json_array_length(entities_json) > 0 ELSE FALSE END AS stated FROM s),
    e AS (SELECT id, unnest(CAST(entities_json AS JSON[])) AS x FROM p WHERE stated),
    own AS (SELECT id, x ->> 'name' AS name, x ->> 'type' AS type, x ->> 'relationship' AS relationship FROM e WHERE trim(coalesce(x ->> 'name', '')) <> ''),
    words AS (SELECT id, regexp_extract_all(content, '\\b[A-Z][a-z]+') AS w FROM p WHERE stated IS NOT TRUE),
    rest AS (SELECT id, unnest(list_filter(w, lambda y, i: list_position(w, y) = i)[1:3]) AS name FROM words)
    SELECT id AS fact_id, name, type, relationship, TRUE AS stated FROM own UNION ALL SELECT id, name, 'thing', 'mentions', FALSE FROM rest""".lstrip(),
    "session_facts",
)
def _(spark, sf):
    from mnemolake.operators.consolidate import capitalised, entities_of

    facts = A.session_facts(spark, sf).withColumn("entities_json", F.expr(_STATED))
    return entities_of(facts, capitalised())
