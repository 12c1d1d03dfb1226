"""The event log: progress marks, admission, provenance, look-back, windows of conversations, retention."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake import schemas as S
from mnemolake.functions.text import conversation_key, conversation_kind, is_assent
from mnemolake.scratch import written


def numbered(rows: DataFrame, order: str | list[str], after: int = 0, name: str = "sequence") -> DataFrame:
    """``rows`` with consecutive numbers by ``order`` from ``after`` + 1 on, without sorting all rows in one task.

    Rows go to ranges of the order, as many as Spark makes shuffle partitions; a row's number is its place in its range after the
    counts of the ranges before, which are few rows. Rows that agree in the order are in one range, in no particular order.
    """
    order = [order] if isinstance(order, str) else order
    dealt = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered-ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn(name, (F.lit(after) + F.col("_before") + F.col("_place")).cast("long")).drop("_range", "_place", "_before")


def keyed(events: DataFrame) -> DataFrame:
    """With the conversation and its kind: client, mcp, or an event of its own."""
    client, mcp = F.col("client_session_id"), F.col("mcp_session_id")
    return events.withColumns({"conversation": conversation_key(client, mcp, F.col("id")), "kind": conversation_kind(client, mcp)})


def unexamined(events: DataFrame, marks: DataFrame) -> DataFrame:
    """Keyed events beyond their conversation's mark."""
    m = marks.select("kind", F.col("conversation_id").alias("conversation"), F.col("last_event_sequence").alias("_mark"))
    return events.join(m, ["kind", "conversation"], "left").where(F.col("sequence") > F.coalesce("_mark", F.lit(0))).drop("_mark")


def backlog(events: DataFrame, marks: DataFrame) -> DataFrame:
    """Per conversation: first unexamined sequence and how many."""
    return unexamined(events, marks).groupBy("kind", "conversation").agg(F.min("sequence").alias("first"), F.count("*").alias("n"))


def global_mark(events: DataFrame, marks: DataFrame) -> DataFrame:
    """One row: everything up to ``mark`` is examined."""
    low = unexamined(events, marks).agg(F.min("sequence").alias("low"))
    return events.agg(F.max("sequence").alias("high")).crossJoin(low).select(F.coalesce(F.col("low") - 1, F.col("high"), F.lit(0)).alias("mark"))


def admitted(events: DataFrame, marks: DataFrame, cap: int | None = S.EXTRACT_CAP) -> DataFrame:
    """Unexamined events of a run, oldest conversation first, ``cap`` in all (null: no cap).

    The running sum is over conversations that could be within the cap: the ``cap`` oldest, as each has an event.
    """
    rest = unexamined(events, marks)
    if cap is None:
        return rest
    oldest = backlog(events, marks).orderBy("first", "conversation").limit(cap)
    w = Window.orderBy("first", "conversation").rowsBetween(Window.unboundedPreceding, -1)
    room = oldest.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") < cap)
    own = rest.join(F.broadcast(room.select("kind", "conversation", "before")), ["kind", "conversation"])
    place = F.row_number().over(Window.partitionBy("kind", "conversation").orderBy("sequence"))
    return own.withColumn("_place", place + F.col("before")).where(F.col("_place") <= cap).drop("_place", "before")


def newest_rank(events: DataFrame) -> DataFrame:
    return events.withColumn("rn", F.row_number().over(Window.partitionBy("conversation").orderBy(F.desc("sequence"))).cast("long"))


def prunable(events: DataFrame, marks: DataFrame, sources: DataFrame, spare: int) -> DataFrame:
    """Events that nothing can reach: examined, cited by no fact, and not of the ``spare`` newest of their conversation."""
    mark = global_mark(events, marks)
    old = newest_rank(events).crossJoin(F.broadcast(mark)).where((F.col("sequence") <= F.col("mark")) & (F.col("rn") > spare))
    return old.join(sources.select(F.col("event_id").alias("id")).distinct(), "id", "left_anti").drop("mark", "rn")


def pruned(events: DataFrame, marks: DataFrame, sources: DataFrame, spare: int) -> DataFrame:
    """The log without them, by the same rule."""
    return events.join(prunable(events, marks, sources, spare).select("id"), "id", "left_anti")


def provenance(facts: DataFrame, events: DataFrame) -> DataFrame:
    """Sources of staged facts: rows (session_fact_id, event_id, extraction_type, relevance).

    ``facts`` has (id, conversation, content). Primary is the first event of the conversation that contains the text;
    later ones of the same role corroborate; an observation, a restatement and an assent each back it once.
    """
    f = facts.select(F.col("id").alias("session_fact_id"), "conversation", F.col("content").alias("said"))
    both = f.join(events.select(F.col("id").alias("event_id"), "conversation", "sequence", "role", "content"), "conversation")
    holds = both.withColumn("holds", F.contains("content", "said"))
    w = Window.partitionBy("session_fact_id")
    first = F.min(F.when(F.col("holds"), F.struct("sequence", "event_id", "role"))).over(w)
    own = holds.withColumn("p", first).where("p is not null")
    later, other = F.col("sequence") > F.col("p.sequence"), F.col("event_id") != F.col("p.event_id")
    observed = other & F.col("holds") & (F.col("role") == "tool") & (F.col("p.role") != "tool")
    restated = later & F.col("holds") & (F.col("role") != F.col("p.role")) & (F.col("role") != "tool")
    assented = later & (F.col("role") == "user") & is_assent(F.col("content"))

    def pick(test: Column, kind: str, relevance: float) -> DataFrame:
        got = own.where(test).groupBy("session_fact_id").agg(F.min_by("event_id", "sequence").alias("event_id"))
        return got.select("session_fact_id", "event_id", F.lit(kind).alias("extraction_type"), F.lit(relevance).cast("double").alias("relevance"))

    again = own.where(later & F.col("holds") & (F.col("role") == F.col("p.role"))).select("session_fact_id", "event_id", F.lit("corroborating").alias("extraction_type"), F.lit(0.5).cast("double").alias("relevance"))
    return pick(~other, "primary", 0.8).union(again).union(pick(observed, "observation", 0.6)).union(pick(restated, "restatement", 0.55)).union(pick(assented, "assent", 0.7))


def nearest_user(events: DataFrame, reach: int = 8) -> DataFrame:
    """Each event with the last user event of its conversation at most ``reach`` sequences before it (itself too)."""
    w = Window.partitionBy("conversation").orderBy("sequence").rangeBetween(-reach, 0)
    return events.withColumn("near_user", F.last(F.when(F.col("role") == "user", F.col("id")), ignorenulls=True).over(w))


def within(events: DataFrame, hits: DataFrame, radius: int = 3) -> DataFrame:
    """Events at most ``radius`` sequences from a hit (id) of their conversation, each once with its hits."""
    h = events.join(hits.select("id"), "id", "left_semi").select("conversation", F.col("sequence").alias("at"), F.col("id").alias("hit"))
    return events.join(h, "conversation").where(F.abs(F.col("sequence") - F.col("at")) <= radius).groupBy("id").agg(F.count("*").alias("hits"))


def tool_names(events: DataFrame, back: int = 4) -> DataFrame:
    """An event's tool: its own, else the last within ``back`` rows, not across a user's turn."""
    from mnemolake.functions.text import tool_name

    w = Window.partitionBy("conversation").orderBy("sequence")
    turns = events.withColumn("_turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w))
    near = Window.partitionBy("conversation", "_turn").orderBy("sequence").rowsBetween(-back, 0)
    return turns.withColumn("tool", F.last(tool_name(F.col("content")), ignorenulls=True).over(near)).drop("_turn")


def tail(events: DataFrame, last: int) -> DataFrame:
    """The newest ``last`` events of each conversation."""
    return newest_rank(events).where(F.col("rn") <= last).drop("rn")


def packed(events: DataFrame, characters: int, most: int, overhead: int = 64, keys: tuple[str, ...] = ("conversation",)) -> DataFrame:
    """Events with a chunk number and their place: chunks of a conversation hold at most ``characters`` (each event cut at ``most``).

    A running sum that starts anew can't be a window: conversations stream by in order, and a task keeps the sum alone.
    """
    cost = (F.least(F.length(F.coalesce("content", F.lit(""))), F.lit(most)) + overhead).cast("long").alias("cost")
    rows = events.select(*keys, "sequence", F.col("id").cast("string").alias("id"), cost)
    names = [*keys, "sequence", "id", "cost"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, chunk, place = None, 0, 0, 0
        for b in batches:
            chunks, places = [], []
            for *key, spent in zip(*(b.column(c).to_pylist() for c in (*keys, "cost"))):
                if key != now:
                    now, used, chunk, place = key, 0, 0, 0
                if used and used + spent > characters:
                    used, chunk = 0, chunk + 1
                used, place = used + spent, place + 1
                chunks.append(chunk)
                places.append(place)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), pa.array(chunks, pa.int64()), pa.array(places, pa.int64())], [*names[:-1], "chunk", "place"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names[:-1])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "sequence", "id").mapInArrow(number, f"{schema}, chunk long, place long")


def names_in_text(names: DataFrame, events: DataFrame, keep: int = 12, batch: int = 4096) -> DataFrame:
    """Entities (id, name) whose name occurs in an event's content, case folded: counts and the newest ``keep`` events.

    Names are a stated set of at most ``batch``: one automaton scans each text once. Larger sets go in blocks.
    """
    import ahocorasick

    total = names.count()
    blocks = names.randomSplit([1.0] * max(1, -(-total // batch)), seed=1) if total > batch else [names]
    found = None
    for block in blocks:
        shared = events.sparkSession.sparkContext.broadcast([(r[0], r[1].lower()) for r in block.select("id", "name").where("name <> ''").toLocalIterator()])

        def scan(batches, shared=shared):
            tree: dict[str, list] = {}
            for key, name in shared.value:
                tree.setdefault(name, []).append(key)
            machine = ahocorasick.Automaton()
            for name, keys in tree.items():
                machine.add_word(name, keys)
            machine.make_automaton()
            for b in batches:
                rows = []
                for event, seq, content in zip(*(b.column(i).to_pylist() for i in range(3))):
                    hit = {k for _, keys in machine.iter((content or "").lower()) for k in keys} if tree else set()
                    rows += [(k, event, seq) for k in sorted(hit)]
                yield pa.RecordBatch.from_pydict({"entity_id": pa.array([r[0] for r in rows], pa.string()), "event_id": pa.array([r[1] for r in rows], pa.string()), "sequence": pa.array([r[2] for r in rows], pa.int64())})

        got = events.select("id", "sequence", "content").mapInArrow(scan, "entity_id string, event_id string, sequence long")
        found = got if found is None else found.union(got)
    w = Window.partitionBy("entity_id").orderBy(F.desc("sequence"), "event_id")
    counted = found.withColumn("total", F.count("*").over(Window.partitionBy("entity_id"))).withColumn("place", F.row_number().over(w).cast("long"))
    return counted.where(F.col("place") <= keep)
