"""Reads and writes of the fact tables. Writes are functions from snapshots to snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake import schemas as S
from mnemolake.functions import predicates as P


def structured(facts: DataFrame, now: Column, links: DataFrame | None = None, entity_id: str | None = None, domain: str | None = None, subdomain: str | None = None, at: Column | None = None, limit: int = S.DEFAULT_LIMIT) -> DataFrame:
    """Filtered reads: by entity before domain before the generic form; subdomain only with domain; newest first."""
    own = facts.where(P.in_force(now, at))
    if entity_id is not None and links is not None:
        return facts_of_entity(own, links, entity_id).limit(limit)
    if domain is not None:
        own = own.where(F.col("domain") == domain)
        if subdomain is not None:
            own = own.where(F.col("subdomain") == subdomain)
    return own.orderBy(F.desc("created_at"), "id").limit(limit)


def facts_of_entity(facts: DataFrame, links: DataFrame, entity_id: str) -> DataFrame:
    """Facts of an entity with is_subject: subjects first, then by importance and age."""
    own = links.where(F.col("entity_id") == entity_id).groupBy("fact_id").agg(F.bool_or(F.col("relationship") == S.SUBJECT_OF).alias("is_subject"))
    return facts.join(own, facts["id"] == own["fact_id"]).drop("fact_id").orderBy(F.desc("is_subject"), F.desc("importance"), F.desc("created_at"), "id")


def key_facts(facts: DataFrame, now: Column, limit: int = 200) -> DataFrame:
    return facts.where(P.current(now)).orderBy(F.desc("importance"), F.desc("created_at"), "id").limit(limit)


def missing_embeddings(facts: DataFrame, vectors: DataFrame, model: str, dimensions: int) -> DataFrame:
    """Active, latest facts without a vector: the embedding queue. Validity doesn't matter here."""
    have = vectors.where((F.col("model") == model) & (F.col("dimensions") == dimensions)).select(F.col("fact_id").alias("id"))
    return facts.where((F.col("status") == "active") & F.col("is_latest")).join(have, "id", "left_anti")


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: inserts that ignore what is there already."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``existing`` and those of ``new`` whose keys it lacks, the first of each key."""
    fresh = first_of(new, keys, order).join(existing.select(*keys).distinct(), keys, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def upsert_last(existing: DataFrame, new: DataFrame, keys: list[str], clock: str) -> DataFrame:
    """The last row of each key by ``clock``, of ``new`` where clocks tie."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.select(*existing.columns).withColumn("_new", F.lit(1)))
    return first_of(both, keys, [F.desc(clock), F.desc("_new")]).drop("_new")


def advance_watermarks(marks: DataFrame, new: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """Marks never move backwards."""
    added = new.groupBy(*keys).agg(F.max(mark).alias("_mark"))
    return marks.join(added, keys, "full").select(*keys, F.greatest(mark, "_mark").alias(mark))


def supersede(facts: DataFrame, pairs: DataFrame, at: Column, retire: bool = True) -> DataFrame:
    """``facts`` with the old ones of ``pairs`` (old_id, new_id) closed at ``at``; retiring sets their system time too."""
    own = facts.join(pairs.select(F.col("old_id").alias("id"), F.col("new_id").alias("_new")), "id", "left")
    hit = F.col("_new").isNotNull()
    changed = {"status": F.when(hit, "superseded").otherwise(F.col("status")), "is_latest": F.col("is_latest") & ~hit, "superseded_by": F.coalesce("_new", "superseded_by"), "valid_until": F.when(hit, at).otherwise(F.col("valid_until"))}
    if retire:
        changed["system_retired_at"] = F.when(hit, at).otherwise(F.col("system_retired_at"))
    return own.withColumns(changed).select(*facts.columns)


def enriched(facts: DataFrame, paraphrases: DataFrame) -> DataFrame:
    """Confidence raised by a step for each paraphrase (fact_id), up to 1."""
    n = paraphrases.groupBy(F.col("fact_id").alias("id")).agg(F.count("*").alias("_n"))
    return facts.join(n, "id", "left").withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + S.ENRICH_STEP * F.coalesce("_n", F.lit(0)))).drop("_n")


def with_defaults(facts: DataFrame, now: Column) -> DataFrame:
    """New facts with the defaults of an insert."""
    return facts.withColumns({"confidence": F.coalesce("confidence", F.lit(S.DEFAULT_CONFIDENCE)), "importance": F.coalesce("importance", F.lit(S.DEFAULT_IMPORTANCE)), "status": F.lit("active"), "is_latest": F.lit(True), "created_at": F.coalesce("created_at", now)})


def newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return first_of(rows, keys, order)


def relations_of(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """Decision rows that touch ``facts`` (id) at either end: two equi-joins instead of one with OR."""
    ids = facts.select("id").distinct()
    left = relations.join(ids.withColumnRenamed("id", "fact_id"), "fact_id", "left_semi").select(*relations.columns)
    right = relations.join(ids.withColumnRenamed("id", "related_fact_id"), "related_fact_id", "left_semi").select(*relations.columns)
    return left.union(right).distinct()


def facts_by_entity(facts: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """The first ``most`` facts of every entity (entity_id, id, is_subject, place): subjects first, then by importance and age."""
    own = links.groupBy("entity_id", "fact_id").agg(F.bool_or(F.col("relationship") == S.SUBJECT_OF).alias("is_subject"))
    both = own.join(facts.select(F.col("id").alias("fact_id"), "importance", "created_at"), "fact_id")
    w = Window.partitionBy("entity_id").orderBy(F.desc("is_subject"), F.desc("importance"), F.desc("created_at"), "fact_id")
    return both.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most).select("entity_id", F.col("fact_id").alias("id"), "is_subject", "place")


def backing_kinds(contents: DataFrame, staged: DataFrame, sources: DataFrame) -> DataFrame:
    """For each of ``contents`` (content) the kinds of backing (extraction_type) that staged facts with this text have, joined on its hash and text."""
    asked = contents.select("content").distinct().withColumn("_h", F.xxhash64("content"))
    held = staged.select(F.col("id").alias("session_fact_id"), F.col("content").alias("_c"), F.xxhash64("content").alias("_h"))
    own = asked.join(held, "_h").where("content = _c").select("content", "session_fact_id")
    return own.join(sources.select("session_fact_id", "extraction_type"), "session_fact_id").groupBy("content").agg(F.array_sort(F.collect_set("extraction_type")).alias("kinds"))


def provenance_chain(facts: DataFrame, sources: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """Events behind ``facts`` (id, source_id): by the source's record of the staged fact, its links, and the log. (fact_id, event_id, role)."""
    own = facts.select(F.col("id").alias("fact_id"), "source_id").join(sources.select(F.col("id").alias("source_id"), "metadata"), "source_id")
    staged = own.withColumn("session_fact_id", F.get_json_object("metadata", "$.session_fact_id").cast(links.schema["session_fact_id"].dataType))
    return staged.join(links.select("session_fact_id", "event_id"), "session_fact_id").join(events.select(F.col("id").alias("event_id"), "role"), "event_id").select("fact_id", "event_id", "role")


def decision_views(relations: DataFrame) -> DataFrame:
    """For each fact its decisions as a list of (kind, related_fact_id, basis, decided_by, reason), by related fact."""
    view = F.struct("related_fact_id", "kind", "basis", "decided_by", "reason")
    return relations.groupBy("fact_id").agg(F.array_sort(F.collect_list(view)).alias("decisions"))
