"""From events to staged facts: batches of events as rows that are tried until each has an answer, and the marks that follow.

A batch is a range of places in its conversation. Each round gives all open batches to the provider at once: what
overflows comes back as two halves, an unsure answer is asked for once more with a reminder of the events before, and the
rest is settled. Rounds are as many as a batch can be halved, whatever the number of events; nothing but their
count is on the driver. Where a batch fails for good, its conversation's later batches are left for the next run, so that a
mark never passes over an event that nobody examined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake import schemas as S
from mnemolake.operators.log import packed
from mnemolake.scratch import written

CONVERSATION = ("kind", "conversation")
EVENT = "struct<sequence:bigint,id:string,role:string,content:string>"
FACT = "struct<content:string,domain_hint:string,entities_json:string>"
#: What a provider returns for each batch: status is ok, overflow or failed; null now, referents and confidence weren't given.
OUTCOME = f"struct<status:string,confidence:double,facts:array<{FACT}>,now:string,referents:array<string>,shifted:boolean>"
#: (kind, conversation, first, last, events, evidence, reminder) to the same rows with ``outcome``.
Extractor = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Extraction:
    """``outcomes``: a row for each settled batch, with status done, given_up, failed or left. ``rounds``: how many it took."""

    members: DataFrame
    outcomes: DataFrame
    rounds: int


def admit(rows: DataFrame, order: list[str], cost: str, budget: float, spent: float = 0.0) -> DataFrame:
    """The first ``rows`` by ``order`` until ``spent`` and their costs reach ``budget``; the row that reaches it is the last.

    Rows are sorted by range, and the ranges' totals, few rows, are summed first. Only the ranges before the cut are read again,
    each summed inside by a task of its own. Null costs are 0; ``order`` must be unique for a defined result.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "budget-ranges")
    value = F.coalesce(F.col(cost), F.lit(0))
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = totals.withColumn("_base", F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_total")
    near = ranged.join(F.broadcast(before.where(F.col("_base") + spent < budget)), "_range")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return near.withColumn("_inside", inside).where(F.col("_base") + F.col("_inside") + spent < budget).drop("_range", "_base", "_inside")


def batches(events: DataFrame, size: int, characters: int) -> tuple[DataFrame, DataFrame]:
    """Members (events with ``chunk`` and ``place``) and batches (kind, conversation, chunk, lo, hi, first, last, n, cost).

    A batch holds ``size`` times ``characters`` of content, each event cut to ``characters``. ``cost`` is in tokens of four.
    """
    own = events.select(*CONVERSATION, "id", "sequence", "role", F.substring(F.coalesce("content", F.lit("")), 1, characters).alias("content"))
    places = packed(own, size * characters, characters, 0, CONVERSATION)
    members = written(own.join(places.select(*CONVERSATION, "id", "sequence", "chunk", "place"), [*CONVERSATION, "id", "sequence"]), "extract-members")
    found = members.groupBy(*CONVERSATION, "chunk").agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count("*").alias("n"), F.sum(F.ceil(F.length("content") / 4)).alias("cost"))
    return members, found


def _before(open_: DataFrame, members: DataFrame, reach: int, name: str) -> DataFrame:
    """The ``reach`` events before each batch, by place: equal keys, no range join."""
    asked = open_.select(*CONVERSATION, "lo", "hi", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("lo") - reach), F.col("lo") - 1)).alias("place")).where("place < lo") if reach else None
    events = F.struct("sequence", "id", "role", "content")
    return asked.join(members, [*CONVERSATION, "place"]).groupBy(*CONVERSATION, "lo", "hi").agg(F.sort_array(F.collect_list(events)).alias(name))


def _asked(open_: DataFrame, members: DataFrame, evidence: int, reread: int) -> DataFrame:
    """Open batches with their events and the events before them, as the provider gets them."""
    own = members.join(open_, [*CONVERSATION, "chunk"]).where("place between lo and hi")
    whole = own.groupBy(*CONVERSATION, "chunk", "lo", "hi", "again").agg(F.sort_array(F.collect_list(F.struct("sequence", "id", "role", "content"))).alias("events"))
    none = F.array().cast(f"array<{EVENT}>")
    whole = whole.join(_before(open_.where("lo > 1"), members, evidence, "evidence"), [*CONVERSATION, "lo", "hi"], "left")
    whole = whole.join(_before(open_.where("lo > 1 and again"), members, reread, "reminder"), [*CONVERSATION, "lo", "hi"], "left")
    return whole.withColumns({"evidence": F.coalesce("evidence", none), "reminder": F.when(F.col("again"), F.coalesce("reminder", none)), "first": F.col("events")[0]["sequence"], "last": F.element_at("events", -1)["sequence"]})


def extract(events: DataFrame, provider: Extractor, size: int = 50, characters: int = 2000, evidence: int = 8, reread: int = 20, sure: float = 0.5, budget: float | None = None, spent: float = 0.0) -> Extraction:
    """Facts of keyed ``events``, which are the eligible ones that a run takes on.

    With ``budget``, batches are admitted in order of their conversation's first event until it is reached; the others are
    ``left``. A single event that overflows, and what fails, is ``failed``; what is unsure twice is ``given_up``: examined, without facts.
    """
    members, first = batches(events, size, characters)
    keys = [*CONVERSATION, "chunk", "lo", "hi"]
    left = None
    if budget is not None:
        oldest = first.withColumn("oldest", F.min("first").over(Window.partitionBy(*CONVERSATION)))
        taken = written(admit(oldest, ["oldest", *CONVERSATION, "lo"], "cost", budget, spent).drop("oldest"), "extract-admitted")
        left, first = first.join(taken.select(*CONVERSATION, "chunk"), [*CONVERSATION, "chunk"], "left_anti"), taken
    open_ = written(first.select(*keys, F.lit(False).alias("again")), "extract-open")
    settled, rounds = [], 0
    while open_.limit(1).count():
        rounds += 1
        answers = written(provider(_asked(open_, members, evidence, reread)).withColumn("outcome", F.col("outcome").cast(OUTCOME)), "extract-answers")
        many, status = F.size("events") > 1, F.col("outcome.status")
        unsure = (status == "ok") & (F.coalesce(F.col("outcome.confidence"), F.lit(1.0)) < sure)
        split = (status == "overflow") & many
        verdict = F.when(split, "split").when(unsure & ~F.col("again"), "again").when(unsure, "given_up").when(status == "ok", "done").otherwise("failed")
        judged = answers.withColumn("status", verdict)
        middle = F.col("lo") + F.ceil((F.col("hi") - F.col("lo") + 1) / 2)
        halves = F.array(F.struct(F.col("lo").alias("l"), (middle - 1).alias("h")), F.struct(middle.alias("l"), F.col("hi").alias("h")))
        both = judged.where("status = 'split'").select(*CONVERSATION, "chunk", F.explode(halves).alias("x")).select(*CONVERSATION, "chunk", F.col("x.l").alias("lo"), F.col("x.h").alias("hi"), F.lit(False).alias("again"))
        more = judged.where("status = 'again'").select(*keys, F.lit(True).alias("again"))
        given = F.when(F.col("status") == "done", F.col("outcome"))
        settled.append(judged.where("status in ('done', 'given_up', 'failed')").select(*keys, "again", "first", "last", F.size("events").cast("long").alias("n"), "status", given.alias("outcome")))
        open_ = written(both.union(more), "extract-open")
    # Without a round there was no batch at all, or none was admitted.
    if left is not None or not settled:
        settled.append((first if left is None else left).select(*keys, F.lit(False).alias("again"), "first", "last", "n", F.lit("left").alias("status"), F.lit(None).cast(OUTCOME).alias("outcome")))
    out = settled[0]
    for rows in settled[1:]:
        out = out.unionByName(rows)
    return Extraction(members, written(out, "extract-outcomes"), rounds)


def honest(examined: DataFrame, remaining: DataFrame) -> DataFrame:
    """Of ``examined`` events (kind, conversation, sequence) those that stand before all that ``remaining`` has of their conversation.

    Evaluated as an anti-join: an event at or after the first remaining one is not kept.
    """
    first = remaining.groupBy(*CONVERSATION).agg(F.min("sequence").alias("_first"))
    e, r = examined.alias("e"), first.alias("r")
    return e.join(r, (F.col("e.kind") == F.col("r.kind")) & (F.col("e.conversation") == F.col("r.conversation")) & (F.col("e.sequence") >= F.col("r._first")), "left_anti")


def marks(loaded: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows (kind, conversation, last_event_sequence): how far each conversation of ``loaded`` (all events that the run took on, also those
    that aren't eligible) has been examined; conversations whose first batch failed or was left have none."""
    places = outcomes.select(*CONVERSATION, "first", "last", "status")
    remaining = places.where("status in ('failed', 'left')").select(*CONVERSATION, F.col("first").alias("sequence"))
    # What isn't eligible counts as examined once all before it is: up to the last examined batch, or to the end where nothing remains.
    examined = places.where("status in ('done', 'given_up')").select(*CONVERSATION, F.col("last").alias("sequence"))
    stopped = remaining.select(*CONVERSATION).distinct()
    whole = loaded.select(*CONVERSATION, "sequence").join(stopped, [*CONVERSATION], "left_anti")
    return honest(examined, remaining).select(*CONVERSATION, "sequence").union(whole).groupBy(*CONVERSATION).agg(F.max("sequence").alias("last_event_sequence"))


def committed(outcomes: DataFrame) -> DataFrame:
    """Batches whose facts count: done, and before the first of their conversation that failed or was left."""
    remaining = outcomes.where("status in ('failed', 'left')").select(*CONVERSATION, F.col("first").alias("sequence"))
    return honest(outcomes.where("status = 'done'").withColumn("sequence", F.col("last")), remaining).drop("sequence")


def staged(outcomes: DataFrame) -> DataFrame:
    """Facts of committed batches: (kind, conversation, first, last, content, domain_hint, entities_json); empty contents drop out."""
    facts = committed(outcomes).select(*CONVERSATION, "first", "last", F.explode("outcome.facts").alias("f")).select(*CONVERSATION, "first", "last", "f.*")
    return facts.where(F.trim(F.coalesce("content", F.lit(""))) != "")


def sentences(overflow: int, odd: Column | None = None, shift: Column | None = None) -> Extractor:
    """A provider of rules: the first sentence of each user turn is a fact. Batches above ``overflow`` characters overflow; batches
    where ``odd`` (of ``first`` and ``last``, sequences) holds are unsure, unless a reminder has events; the topic shifts where ``shift`` holds."""

    def run(asked: DataFrame) -> DataFrame:
        size = F.aggregate("events", F.lit(0), lambda a, e: a + F.length(F.coalesce(e["content"], F.lit(""))))
        said = F.filter("events", lambda e: e["role"] == "user")
        facts = F.transform(said, lambda e: F.struct(F.regexp_extract(e["content"], r"^[^.!?]*", 0).alias("content"), F.lit(None).cast("string").alias("domain_hint"), F.lit(None).cast("string").alias("entities_json")))
        unsure = F.lit(False) if odd is None else odd & (F.coalesce(F.size("reminder"), F.lit(0)) <= 0)
        outcome = F.struct(
            F.when(size > overflow, "overflow").otherwise("ok").alias("status"), F.when(unsure, 0.3).otherwise(0.9).alias("confidence"), F.when(size <= overflow, facts).alias("facts"),
            F.try_element_at(F.transform(said, lambda e: e["id"]), F.lit(-1)).alias("now"), F.transform(said, lambda e: e["id"]).alias("referents"), (F.lit(False) if shift is None else shift).alias("shifted"),
        )
        return asked.withColumn("outcome", outcome)

    return run


def run(events: DataFrame, marks_: DataFrame, provider: Extractor, cap: int | None = S.EXTRACT_CAP, **options) -> tuple[Extraction, DataFrame, DataFrame]:
    """One run over the log: the extraction of what is eligible beyond the marks, oldest conversations first up to ``cap`` events; the staged
    facts and the new marks. Events without a conversation are passed over and marked."""
    from mnemolake.functions.predicates import eligible
    from mnemolake.operators.log import admitted

    loaded = written(admitted(events, marks_, cap), "extract-loaded")
    got = extract(loaded.where(eligible() & (F.col("kind") != "unkeyed")), provider, **options)
    return got, staged(got.outcomes), marks(loaded, got.outcomes)
