"""The entity graph: edges and their strength, identity families, one-hop context, degrees and ego networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake import schemas as S
from mnemolake.functions.text import fold
from mnemolake.scratch import written


def potentiated(n: Column, strength: Column | None = None) -> Column:
    """Strength after ``n`` more co-occurrences: each takes a fixed share of what is missing to 1."""
    rest = F.pow(F.lit(1 - S.EDGE_STEP), n)
    return 1 - (rest if strength is None else (1 - strength) * rest)


def co_occurrences(links: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """Pairs (a < b) of entities that share facts, and of how many (n); ``at`` (id): only pairs that one of these is in.

    Pairs are made within a fact, whose entities are few; a fact's pairs are not made across facts. Links need not be distinct.
    """
    if at is None:
        one = links.select("fact_id", "entity_id").distinct()
        other = one.select("fact_id", F.col("entity_id").alias("b"))
        return one.withColumnRenamed("entity_id", "a").join(other, "fact_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    # The links of ``at`` are a table, whose size Spark knows: where they are few, they go to the links, which aren't shuffled.
    own = written(links.join(at.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("fact_id", F.col("entity_id").alias("x")).distinct(), "links-at")
    pairs = own.join(links.select("fact_id", F.col("entity_id").alias("y")), "fact_id").where("x <> y")
    return pairs.select("fact_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().groupBy("a", "b").agg(F.count("*").alias("n"))


def upsert_edges(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """Edges (from_entity, to_entity, relationship, strength) with ``seen`` (the same and n) taken in."""
    keys = ["from_entity", "to_entity", "relationship"]
    added = seen.groupBy(*keys).agg(F.sum("n").alias("_n"))
    both = edges.join(added, keys, "full")
    return both.select(*keys, F.when(F.col("_n").isNull(), F.col("strength")).otherwise(potentiated(F.col("_n"), F.coalesce("strength", F.lit(0.0)))).alias("strength"))


def same_as_pairs(pairs: DataFrame) -> DataFrame:
    """Identity edges with the smaller id first, each once."""
    return pairs.where("from_entity <> to_entity").select(F.least("from_entity", "to_entity").alias("from_entity"), F.greatest("from_entity", "to_entity").alias("to_entity")).distinct()


def same_as_closure(seeds: DataFrame, edges: DataFrame, cap: int = S.FAMILY_CAP) -> DataFrame:
    """For each seed (seed) all members (member) of its identity family; beyond ``cap`` members the seed alone.

    Breadth first, at most ``cap`` rounds, and no family grows past one round beyond the cap.
    """
    both = edges.select(F.col("from_entity").alias("x"), F.col("to_entity").alias("y")).union(edges.select("to_entity", "from_entity")).distinct()
    both = written(both, "identity-edges")
    found = written(seeds.select("seed", F.col("seed").alias("member")).distinct(), "family")
    front = found
    for _ in range(cap):
        small = found.groupBy("seed").count().where(F.col("count") <= cap).select("seed")
        new = front.join(small, "seed").join(both, F.col("member") == F.col("x")).select("seed", F.col("y").alias("member")).distinct().join(found, ["seed", "member"], "left_anti")
        # Each round is a table of its own, so lineage is a few scans.
        front = written(new, "family")
        if front.isEmpty():
            break
        found = found.union(front)
    counts = found.groupBy("seed").agg(F.count("*").alias("_n"))
    return found.join(counts, "seed").where((F.col("_n") <= cap) | (F.col("member") == F.col("seed"))).select("seed", "member")


def resolve_names(names: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows (name, id) of entities that a name stands for: by canonical name, else by a fold of one canonical name.

    A fold that several canonical names share is ambiguous and gives nothing.
    """
    asked = names.select("name", F.lower(F.trim("name")).alias("canonical_name"), fold(F.col("name")).alias("fold")).distinct()
    exact = asked.join(entities.select("id", "canonical_name"), "canonical_name").select("name", "id")
    folded = entities.select("id", "canonical_name", fold(F.col("name")).alias("fold")).where("fold <> ''")
    clear = folded.groupBy("fold").agg(F.count_distinct("canonical_name").alias("n")).where("n = 1").select("fold")
    rest = asked.join(exact.select("name").distinct(), "name", "left_anti").join(folded.join(clear, "fold").select("fold", "id"), "fold").select("name", "id")
    return exact.union(rest)


def degrees(edges: DataFrame) -> DataFrame:
    """Edges at each entity."""
    ends = edges.select(F.explode(F.array("from_entity", "to_entity")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def neighbours(edges: DataFrame, centers: DataFrame, limit: int = 10) -> DataFrame:
    """The strongest ``limit`` neighbours of each center (id), identity edges and edges among centers left out."""
    own = edges.where(F.col("relationship") != S.SAME_AS)
    end = lambda center, neighbour: F.struct(F.col(center).alias("center"), F.col(neighbour).alias("neighbour"))
    ends = own.select(F.explode(F.array(end("from_entity", "to_entity"), end("to_entity", "from_entity"))).alias("e"), "strength").select("e.*", "strength")
    met = ends.join(centers.select(F.col("id").alias("center")), "center", "left_semi").join(centers.select(F.col("id").alias("neighbour")), "neighbour", "left_anti")
    # Dealt by center once, for the strongest edge of a pair and for the places.
    outside = met.repartition("center").groupBy("center", "neighbour").agg(F.max("strength").alias("strength"))
    w = Window.partitionBy("center").orderBy(F.desc("strength"), "neighbour")
    return outside.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= limit).select("center", "neighbour", "strength", "place")


def shared_facts(links: DataFrame, center: str) -> DataFrame:
    """Facts that other entities share with ``center``. Links need not be distinct."""
    # The center's facts are a table, whose size Spark knows: where they are few, they go to the links, which aren't shuffled.
    own = written(links.where(F.col("entity_id") == center).select("fact_id").distinct(), "facts-of-center")
    return links.join(own, "fact_id", "left_semi").where(F.col("entity_id") != center).groupBy("entity_id").agg(F.count_distinct("fact_id").alias("shared"))


def relatedness(edges: DataFrame, links: DataFrame, center: str) -> DataFrame:
    """Score of every entity related to ``center``: ten times its strongest edge, and shared facts."""
    out = edges.where(F.col("from_entity") == center).select(F.col("to_entity").alias("entity_id"), "strength").union(edges.where(F.col("to_entity") == center).select("from_entity", "strength"))
    best = out.groupBy("entity_id").agg(F.max(10 * F.col("strength")).alias("edge"))
    return best.join(shared_facts(links, center), "entity_id", "full").select("entity_id", (F.coalesce("edge", F.lit(0.0)) + F.coalesce("shared", F.lit(0))).alias("score"))


def ego_scores(edges: DataFrame, links: DataFrame, center: str) -> DataFrame:
    """Two-hop scores around ``center``, the second hop seen from first-hop scores as they were before it.

    A direct score sums ten times each edge and shared facts; a hop scores a quarter of its way plus three times its edge.
    """
    out = edges.where(F.col("from_entity") == center).select(F.col("to_entity").alias("entity_id"), "strength").union(edges.where(F.col("to_entity") == center).select("from_entity", "strength"))
    direct = out.groupBy("entity_id").agg(F.sum(10 * F.col("strength")).alias("edge")).join(shared_facts(links, center), "entity_id", "full").select("entity_id", (F.coalesce("edge", F.lit(0.0)) + F.coalesce("shared", F.lit(0))).alias("score"))
    both = edges.select("from_entity", "to_entity", "strength").union(edges.select("to_entity", "from_entity", "strength"))
    hops = both.join(direct, F.col("from_entity") == F.col("entity_id")).where(F.col("to_entity") != center).groupBy(F.col("to_entity").alias("entity_id")).agg(F.max(F.col("score") * 0.25 + 3 * F.col("strength")).alias("hop"))
    return direct.join(hops, "entity_id", "full").select("entity_id", F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("hop", F.lit(0.0))).alias("score"))


def visible(nodes: DataFrame, edges: DataFrame, cap: int, query: str = "") -> DataFrame:
    """The ``cap`` nodes of highest degree, then by name, and any that ``query`` names."""
    own = nodes.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    top = own.orderBy(F.desc("degree"), "name", "id").limit(cap)
    asked = query.strip().lower()
    named = own.where((F.lower("name") == asked) | (F.col("canonical_name") == asked)).orderBy("id").limit(1)
    return top.union(named).distinct() if asked else top


def named(names: DataFrame, entities: DataFrame, same: DataFrame) -> DataFrame:
    """Rows (name, entity_id) of the identity families that ``names`` (name) lead to; a name that leads nowhere has one with a null entity."""
    asked = written(names.select("name").where("name is not null").distinct(), "asked-names")
    found = written(resolve_names(asked, entities).select("name", F.col("id").alias("seed")), "named-seeds")
    family = same_as_closure(found.select("seed").distinct(), same)
    return asked.join(found.join(family, "seed").select("name", F.col("member").alias("entity_id")).distinct(), "name", "left")


def subject_facts(members: DataFrame, links: DataFrame, facts: DataFrame, most: int | None = None) -> DataFrame:
    """Rows (name, fact_id, is_subject, place): each name's facts once, those it is the subject of first, then by importance and id; ``most`` of
    each. A name without an entity has one row without a fact, for the caller to search."""
    own = members.join(links.select("entity_id", "fact_id", "relationship"), "entity_id").groupBy("name", "fact_id").agg(F.bool_or(F.col("relationship") == S.SUBJECT_OF).alias("is_subject"))
    live = own.join(facts.select(F.col("id").alias("fact_id"), "importance"), "fact_id")
    w = Window.partitionBy("name").orderBy(F.desc("is_subject"), F.desc("importance"), "fact_id")
    packed = live.withColumn("place", F.row_number().over(w).cast("long"))
    packed = packed if most is None else packed.where(F.col("place") <= most)
    lost = members.where("entity_id is null").select("name", F.lit(None).cast(facts.schema["id"].dataType).alias("fact_id"), F.lit(None).cast("boolean").alias("is_subject"), F.lit(None).cast("long").alias("place"))
    return packed.select("name", "fact_id", "is_subject", "place").union(lost)


def primary(members: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """Of each name's family the entity with the most facts, then the oldest, then the least id: (name, entity_id)."""
    counts = links.groupBy("entity_id").agg(F.count_distinct("fact_id").alias("_n"))
    own = members.where("entity_id is not null").join(entities.select(F.col("id").alias("entity_id"), "born"), "entity_id").join(counts, "entity_id", "left")
    w = Window.partitionBy("name").orderBy(F.desc(F.coalesce("_n", F.lit(0))), "born", "entity_id")
    return own.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("name", "entity_id")


def context(centers: DataFrame, edges: DataFrame, links: DataFrame, neighbours_: int = 10, facts: int = 5) -> DataFrame:
    """Rows (center, neighbour, fact_id): the newest facts of the strongest neighbours of each center (id)."""
    near = neighbours(edges, centers, neighbours_).select("center", "neighbour")
    near = written(near, "near")
    # Equal links have one rank, so they are made distinct after the limit, when few are left.
    w = Window.partitionBy("entity_id").orderBy(F.desc("fact_id"))
    asked = near.select(F.col("neighbour").alias("entity_id")).distinct()
    newest = links.select("entity_id", "fact_id").join(asked, "entity_id", "left_semi").withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= facts).select("entity_id", "fact_id").distinct()
    return near.join(newest.select(F.col("entity_id").alias("neighbour"), "fact_id"), "neighbour").select("center", "neighbour", "fact_id")
