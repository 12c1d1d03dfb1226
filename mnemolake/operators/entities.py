"""Writing entities: finding or creating them, spellings, speakers, the user's own node, access counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake import schemas as S
from mnemolake.functions.text import canonical_name, fold
from mnemolake.operators.facts import first_of


def find_or_create(mentions: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities for ``mentions`` (mention_id, name, type, position): assignments, and the entities to add.

    In turn: the same canonical name and type; the name's family (one canonical name for its fold) with the same type;
    the family with a type of the same fold, whose spelling is recorded; else a new one, in the family's spelling if
    there is a family. Mentions of one fold and type share what the first of them creates.
    """
    m = mentions.select("mention_id", "name", "type", "position", canonical_name(F.col("name")).alias("canonical_name"), fold(F.col("name")).alias("fold"), fold(F.col("type")).alias("type_fold"))
    e = entities.select(F.col("id").alias("entity_id"), F.col("type").alias("e_type"), F.col("name").alias("e_name"), F.col("canonical_name").alias("e_canonical"), fold(F.col("name")).alias("fold"), fold(F.col("type")).alias("e_type_fold"))
    exact = e.groupBy(F.col("e_canonical").alias("canonical_name"), F.col("e_type").alias("type")).agg(F.min("entity_id").alias("exact"))
    family = e.where("fold <> ''").groupBy("fold").agg(F.count_distinct("e_canonical").alias("n"), F.min_by("e_name", "entity_id").alias("spelling")).where("n = 1").drop("n")
    typed = e.groupBy("fold", F.col("e_type").alias("type")).agg(F.min("entity_id").alias("typed"))
    folded = e.groupBy("fold", F.col("e_type_fold").alias("type_fold")).agg(F.count_distinct("e_type").alias("n"), F.min("entity_id").alias("by_type_fold")).where("n = 1").drop("n")
    own = m.join(exact, ["canonical_name", "type"], "left").join(family, "fold", "left").join(typed, ["fold", "type"], "left").join(folded, ["fold", "type_fold"], "left")
    known = F.col("spelling").isNotNull()
    key = F.when(F.col("fold") != "", F.col("fold")).otherwise(F.col("canonical_name"))
    found = F.coalesce("exact", F.when(known, F.col("typed")), F.when(known, F.col("by_type_fold")))
    fresh = F.sha2(F.concat_ws("\u0001", key, "type"), 256)
    got = own.withColumns({"entity_id": F.coalesce(found, fresh), "created": found.isNull(), "respelled": F.col("exact").isNull() & ~(known & F.col("typed").isNotNull()) & known & F.col("by_type_fold").isNotNull()})
    new = first_of(got.where("created"), ["entity_id"], [F.col("position"), F.col("mention_id")])
    name = F.coalesce("spelling", "name")
    return got.select("mention_id", "entity_id", "created", "respelled", "type"), new.select(F.col("entity_id").alias("id"), "type", name.alias("name"), canonical_name(name).alias("canonical_name"))


def with_spellings(entities: DataFrame, assigned: DataFrame) -> DataFrame:
    """``entities`` (id, spellings) with the type spellings that mentions used."""
    used = assigned.where("respelled").groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_set("type")).alias("_used"))
    return entities.join(used, "id", "left").withColumn("spellings", F.array_union(F.coalesce("spellings", F.array().cast("array<string>")), F.coalesce("_used", F.array().cast("array<string>")))).drop("_used")


def with_self(entities: DataFrame, name: str, entity_id: str) -> DataFrame:
    """With the user's own node, unless there is one."""
    own = entities.where("is_self").select(F.lit(1).alias("_one")).limit(1)
    me = entities.sparkSession.range(1).join(own, F.lit(True), "left_anti")
    values = {"id": F.lit(entity_id), "type": F.lit("person"), "name": F.lit(name), "canonical_name": F.lit(name.strip().lower()), "is_self": F.lit(True)}
    return entities.unionByName(me.select(*[values.get(c, F.lit(None)).cast(entities.schema[c].dataType).alias(c) for c in entities.columns]))


def uttered(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Links (fact_id, entity_id, relationship) to speakers: a named one to a person of that name, an unnamed user to the own node. None is made."""
    people = entities.where("type = 'person'").groupBy("canonical_name").agg(F.min("id").alias("entity_id"))
    named = facts.where("speaker is not null").select(F.col("id").alias("fact_id"), canonical_name(F.col("speaker")).alias("canonical_name")).join(people, "canonical_name").select("fact_id", "entity_id")
    me = entities.where("is_self").select(F.col("id").alias("entity_id")).limit(1)
    unnamed = facts.where("speaker is null and speaker_role = 'user'").select(F.col("id").alias("fact_id")).crossJoin(F.broadcast(me))
    return named.union(unnamed).select("fact_id", "entity_id", F.lit(S.UTTERED_BY).alias("relationship"))


def touched(rows: DataFrame, seen: DataFrame, key: str, count: str, clock: str, now: Column) -> DataFrame:
    """Access counts and times moved on for each row of ``seen`` (key)."""
    n = seen.groupBy(key).agg(F.count("*").alias("_n"))
    return rows.join(n, key, "left").withColumns({count: F.coalesce(count, F.lit(0)) + F.coalesce("_n", F.lit(0)), clock: F.when(F.col("_n").isNotNull(), now).otherwise(F.col(clock))}).drop("_n")


def inferences_to_add(hypotheses: DataFrame, evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """Hypotheses (id, hypothesis, entity_ids) that pass the gate: some evidence exists, and entities come in pairs or not at all."""
    real = evidence.join(facts.select(F.col("id").alias("fact_id")), "fact_id", "left_semi").groupBy(F.col("inference_id").alias("id")).agg(F.count_distinct("fact_id").alias("evidence"))
    pair = F.size(F.coalesce("entity_ids", F.array().cast("array<string>"))).isin(0, 2)
    return hypotheses.where(pair).join(real, "id").withColumn("status", F.lit("pending"))


def validated(inferences: DataFrame, verdicts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pending inferences with ``verdicts`` (id, confirmed): the new snapshot, facts and identity edges that follow.

    A verdict on one that isn't pending raises.
    """
    own = inferences.join(verdicts, "id", "left")
    bad = F.col("confirmed").isNotNull() & (F.col("status") != "pending")
    status = F.when(bad, F.raise_error("this inference was judged before").cast("string")).when(F.col("confirmed").isNull(), F.col("status")).when(F.col("confirmed"), "confirmed").otherwise("rejected")
    after = own.withColumns({"status": status, "validated_at": F.when(F.col("confirmed").isNotNull(), now).otherwise(F.col("validated_at"))}).select(*inferences.columns)
    yes = own.where("confirmed and status = 'pending'")
    facts = yes.select("id", F.col("hypothesis").alias("content"), F.lit(S.FALLBACK_DOMAIN).alias("domain"), F.lit(0.5).alias("confidence"), F.lit(None).cast("timestamp").alias("valid_from"))
    pairs = yes.where(F.size("entity_ids") == 2).select(F.least(F.get("entity_ids", F.lit(0)), F.get("entity_ids", F.lit(1))).alias("from_entity"), F.greatest(F.get("entity_ids", F.lit(0)), F.get("entity_ids", F.lit(1))).alias("to_entity"))
    return after, facts, pairs.distinct()
