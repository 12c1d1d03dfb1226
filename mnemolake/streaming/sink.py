"""Micro-batches into the store: rows, marks and the batch's number in one commit, so that a batch which is replayed adds nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake import schemas as S
from mnemolake.functions.text import content_hash
from mnemolake.operators import extraction as E
from mnemolake.operators import log as L
from mnemolake.scratch import written
from mnemolake.sources.transcripts import map_lines
from mnemolake.store import Store


def shaped(rows: DataFrame, table: str) -> DataFrame:
    """``rows`` with the table's columns; those it lacks are null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.schema(table)])


def copier(store: Store, name: str, mapping: Callable[[DataFrame], DataFrame] = map_lines, source_tool: str = "transcript") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over the tail source: events, sessions and source marks of a batch.

    A line is known by its path and byte. Sequences are reserved in the store, so that writers beside each other don't share one.
    """

    def write(batch: DataFrame, number: int) -> None:
        if store.head().batches.get(name, -1) >= number:
            return
        lines = written(batch, "copy-lines")
        session = F.coalesce("session_id", F.regexp_extract("path", r"([^/]+?)(?:\.jsonl)?$", 1))
        own = mapping(lines).withColumns({"client_session_id": session, "source_tool": F.lit(source_tool), "created_at": F.current_timestamp()})
        own = written(own.withColumn("id", F.sha2(F.concat_ws(":", "path", F.col("line").cast("string"), F.col("ordinal").cast("string")), 256)), "copy-events")
        after = store.reserve("sequence", own.count())
        events = L.numbered(own, ["path", "line", "ordinal"], after)
        done = lines.groupBy("path").agg(F.max(F.col("line") + F.col("size")).alias("byte_offset"), F.count("*").alias("_n"), F.min("line").alias("_from"), F.max("mark").alias("fingerprint"))
        before = store.table("source_watermarks").select("path", F.col("line_number").alias("_before"))
        marks = done.join(before, "path", "left").withColumns({"line_number": F.col("_n") + F.when(F.col("_from") > 0, F.coalesce("_before", F.lit(0))).otherwise(0), "updated_at": F.current_timestamp()})
        sessions = own.groupBy(F.col("client_session_id").alias("id")).agg(F.min("source_tool").alias("source_tool"), F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("last_activity_at"), F.min(F.regexp_extract("path", r"/projects/([^/]+)/", 1)).alias("project"))
        store.commit({t: shaped(x, t) for t, x in (("session_events", events), ("source_watermarks", marks), ("sessions", sessions))}, add=True, batch=(name, number))

    return write


def extractor(store: Store, name: str, provider: E.Extractor, cap: int | None = S.EXTRACT_CAP, **options) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over anything that says that there are events: a run over what lies beyond the marks.

    Facts and marks are one commit. A mark only moves to the last examined event before all that remains of its conversation, so
    what a batch leaves is the next one's.
    """

    def write(_: DataFrame, number: int) -> None:
        head = store.head()
        if head.batches.get(name, -1) >= number:
            return
        events = L.keyed(store.table("session_events", head))
        got, facts, marks = E.run(events, store.table("extract_watermarks", head), provider, cap, **options)
        new = facts.withColumns(
            {"session_id": F.col("conversation"), "content_hash": content_hash(F.col("content")), "source_origin": F.lit("inferred"), "created_at": F.current_timestamp(), "id": F.sha2(F.concat_ws(":", "kind", "conversation", F.col("first").cast("string"), "content"), 256)}
        )
        moved = marks.withColumns({"conversation_id": F.col("conversation"), "updated_at": F.current_timestamp()})
        store.commit({"session_facts": shaped(new, "session_facts"), "extract_watermarks": shaped(moved, "extract_watermarks")}, add=True, batch=(name, number))

    return write
