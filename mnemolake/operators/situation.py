"""What a conversation is about: its topic now, what is referred to, and the closed segments before.

A batch's answer may name a topic and referents, and say that the topic shifted. A shift closes the topic so far as a segment; what
isn't named stays. The fold has no step that needs the one before it done: the topic at a row is the last one named, and
a segment begins at the last shift, so windows do it. ``streaming.situation`` keeps the same state for a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REFERENTS = 8
KEYS = ("kind", "conversation")
SEGMENT = "struct<start_sequence:bigint,end_sequence:bigint,gist:string,referents:array<string>>"


def answers(outcomes: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows (kind, conversation, first, before, now, referents, shifted) of an extraction's committed batches; ``before`` is the last
    sequence that was examined before the batch."""
    from mnemolake.operators.extraction import honest

    remaining = outcomes.where("status in ('failed', 'left')").select(*KEYS, F.col("first").alias("sequence"))
    examined = honest(outcomes.where("status in ('done', 'given_up')").withColumn("sequence", F.col("last")), remaining)
    m = marks.select("kind", F.col("conversation_id").alias("conversation"), F.col("last_event_sequence").alias("_mark"))
    so_far = F.lag("last").over(Window.partitionBy(*KEYS).orderBy("first"))
    known = examined.join(m, [*KEYS], "left").withColumn("before", F.coalesce(so_far, "_mark", F.lit(0).cast("long")))
    return known.where("status = 'done'").select(*KEYS, "first", "before", "outcome.now", "outcome.referents", F.coalesce("outcome.shifted", F.lit(False)).alias("shifted"))


def fold(rows: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """``rows`` of :func:`answers` that change something, with the state after each (topic, start, mentioned) and the segment it closes
    (``closed``, null if none).

    ``prior`` has at most one row (kind, conversation, topic, start, mentioned) for a conversation, from earlier runs.
    """
    own = rows.where("now is not null or referents is not null or shifted").withColumn("given", F.lit(None).cast("long"))
    own = own.select(*KEYS, "first", "before", "now", F.slice("referents", 1, REFERENTS).alias("referents"), "shifted", "given")
    if prior is not None:
        own = own.unionByName(prior.select(*KEYS, F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("before"), F.col("topic").alias("now"), F.col("mentioned").alias("referents"), F.lit(False).alias("shifted"), F.col("start").alias("given")))
    order = Window.partitionBy(*KEYS).orderBy(F.asc_nulls_first("first"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    state = own.withColumns({"topic": last("now"), "mentioned": F.coalesce(last("referents"), F.array().cast("array<string>"))})
    had, were = F.lag("topic").over(order), F.lag("mentioned").over(order)
    turned = F.col("shifted") & (had.isNotNull() | (F.coalesce(F.size(were), F.lit(0)) > 0))
    state = state.withColumns({"turned": F.coalesce(turned, F.lit(False)), "had": had, "were": were, "n": F.row_number().over(order)})
    state = state.withColumn("start", F.last(F.when(F.col("given").isNotNull(), F.col("given")).when(F.col("turned") | (F.col("n") == 1), F.col("first")), ignorenulls=True).over(so_far))
    closed = F.struct(F.coalesce(F.lag("start").over(order), "before").alias("start_sequence"), F.col("before").alias("end_sequence"), F.coalesce("had", F.lit("")).alias("gist"), F.coalesce("were", F.array().cast("array<string>")).alias("referents"))
    return state.withColumn("closed", F.when(F.col("turned"), closed)).where("first is not null").select(*KEYS, "first", "topic", "start", "mentioned", "closed")


def present(folded: DataFrame) -> DataFrame:
    """The state after the last row: (kind, conversation, topic, start, mentioned)."""
    return folded.groupBy(*KEYS).agg(F.max_by(F.struct("topic", "start", "mentioned"), "first").alias("s")).select(*KEYS, "s.*")


def segments(folded: DataFrame) -> DataFrame:
    """A row for each closed segment."""
    return folded.where("closed is not null").select(*KEYS, "closed.*")


def as_json(folded: DataFrame) -> DataFrame:
    """The state as the store keeps it in ``consolidations``: (kind, conversation, now, now_referents, segments), lists as JSON.

    The one place that puts a conversation's segments into a row, as that table has them.
    """
    listed: Column = F.sort_array(F.collect_list(F.col("closed")))
    closed = folded.groupBy(*KEYS).agg(F.to_json(listed).alias("segments"))
    return present(folded).join(closed, [*KEYS]).select(*KEYS, F.col("topic").alias("now"), F.to_json("mentioned").alias("now_referents"), "segments")
