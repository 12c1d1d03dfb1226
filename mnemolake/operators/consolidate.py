"""From staged facts to knowledge: classification, reconciliation, twins, supersession and what they write."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake import schemas as S
from mnemolake.functions import predicates as P
from mnemolake.functions.text import content_tokens, dedup_key, domain_name, has_negation, jaccard, project_relation
from mnemolake.scratch import written


@dataclass(frozen=True)
class Domain:
    """A routable domain: what it matches (case-insensitive), and how much its facts matter."""

    name: str
    patterns: tuple[str, ...] = ()
    importance: float | None = None


def classified(content: Column, hint: Column, vocabulary: list[Domain]) -> Column:
    """The hint, else the first domain that matches, else the fallback."""
    out = F.lit(S.FALLBACK_DOMAIN)
    for d in reversed([d for d in vocabulary if d.name != S.FALLBACK_DOMAIN and d.patterns]):
        out = F.when(content.rlike("(?i)" + "|".join(f"(?:{p})" for p in d.patterns)), F.lit(d.name)).otherwise(out)
    return F.when(hint.isNotNull(), domain_name(hint)).otherwise(out)


def compiled(vocabulary: list[Domain]) -> list[Domain]:
    """Without patterns that aren't regular expressions."""
    import re

    def ok(p: str) -> bool:
        try:
            re.compile(p)
            return True
        except re.error:
            return False

    return [Domain(d.name, tuple(p for p in d.patterns if ok(p)), d.importance) for d in vocabulary]


def importance(explicit: Column, signal: Column, domain: Column, vocabulary: list[Domain]) -> Column:
    known = [x for d in vocabulary if d.importance is not None for x in (F.lit(d.name), F.lit(d.importance))]
    own = F.element_at(F.create_map(*known), domain) if known else F.lit(None).cast("double")
    return F.coalesce(explicit, signal, own, F.lit(S.DEFAULT_IMPORTANCE))


def vocabulary_union(store: DataFrame, config: DataFrame) -> DataFrame:
    """Store and configured domains by name: configured importance wins, the store's subdomains win unless empty."""
    s = store.select(domain_name(F.col("name")).alias("name"), F.col("subdomains").alias("_own"), F.monotonically_increasing_id().alias("_at"))
    c = config.select(domain_name(F.col("name")).alias("name"), F.col("subdomains").alias("_set"), "importance")
    return s.join(c, "name", "full").select("name", F.when(F.size(F.coalesce("_own", F.array().cast("array<string>"))) > 0, F.col("_own")).otherwise(F.col("_set")).alias("subdomains"), "importance")


def twins(staged: DataFrame) -> DataFrame:
    """``staged`` (id, content, project, source_origin, created_at, hinted) with its fate within the batch.

    Of rows with one normalised text the winner is explicit before inferred, then earliest, then hinted ones first;
    the others are ``rejected`` if their project is the winner's or can't be compared, else ``corroborates``.
    """
    key = F.sha2(dedup_key(F.col("content")), 256)
    order = [F.when(F.col("source_origin") == "explicit", 0).otherwise(1), F.col("created_at"), F.col("id")]
    w = Window.partitionBy("_key").orderBy(*order)
    own = staged.withColumn("_key", key).withColumns({"_n": F.row_number().over(w), "winner": F.first("id").over(w), "_project": F.first(F.struct("project")).over(w)["project"]})
    fate = F.when(F.col("_n") == 1, "stays").when(project_relation(F.col("project"), F.col("_project")) == "different", "corroborates").otherwise("rejected")
    return own.withColumn("fate", fate).drop("_key", "_n", "_project")


def reconciled(staged: DataFrame, facts: DataFrame, now: Column) -> DataFrame:
    """``staged`` (id, content, domain) with action: noop where the domain's current facts say the same, else add.

    Facts of domains that nothing is staged for are left out as they are read; equal texts are found on hashes.
    """
    # A key that can't be null is worked out once, not also to test it for null.
    key = F.coalesce(F.sha2(dedup_key(F.col("content")), 256), F.lit(""))
    asked = written(staged.select("domain").distinct(), "staged-domains")
    held = facts.join(asked, "domain", "left_semi").where(P.current(now) & F.col("content").isNotNull()).select("domain", key.alias("_key"), F.col("id").alias("_held"))
    held = held.groupBy("domain", "_key").agg(F.min("_held").alias("existing_id"))
    own = staged.withColumn("_key", key).join(held, ["domain", "_key"], "left")
    return own.withColumn("action", F.when(F.col("existing_id").isNotNull(), "noop").otherwise("add")).drop("_key")


def overlapping(a: DataFrame, b: DataFrame, floor: float, keys: list[str]) -> DataFrame:
    """Pairs (a_id, b_id, similarity) of equal ``keys`` whose token sets have a Jaccard similarity of ``floor`` or more.

    ``a`` and ``b`` have (id, keys, tokens); tokens are distinct. A set's tokens are ordered from rare to frequent; sets so similar
    must share one of the first n - ceil(floor n) + 1. So frequent tokens make no pairs, and sizes rule out most of the rest.
    """
    a, b = written(a.select(F.col("id").alias("a_id"), *keys, "tokens"), "overlap-a"), written(b.select(F.col("id").alias("b_id"), *keys, "tokens"), "overlap-b")
    each = lambda df, i: df.select(i, *keys, F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    often = each(a, "a_id").select(*keys, "t").union(each(b, "b_id").select(*keys, "t")).groupBy(*keys, "t").agg(F.count("*").alias("_df"))
    often = written(often, "overlap-tokens")

    def prefix(df: DataFrame, i: str) -> DataFrame:
        w = Window.partitionBy(i, *keys).orderBy("_df", "t")
        kept = F.col("n") - F.ceil(floor * F.col("n") - F.lit(1e-9)) + 1
        return each(df, i).join(often, [*keys, "t"]).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= kept).select(i, *keys, "t", "n")

    near = F.least("n", "m") >= floor * F.greatest("n", "m") - F.lit(1e-9)
    met = prefix(a, "a_id").join(prefix(b, "b_id").withColumnRenamed("n", "m"), [*keys, "t"]).where(near).select("a_id", "b_id").distinct()
    pairs = met.join(a.select("a_id", F.col("tokens").alias("x")), "a_id").join(b.select("b_id", F.col("tokens").alias("y")), "b_id")
    return pairs.withColumn("similarity", jaccard(F.col("x"), F.col("y"))).where(F.col("similarity") >= floor).select("a_id", "b_id", "similarity")


def supersessions(new: DataFrame, facts: DataFrame, now: Column) -> DataFrame:
    """Pairs (new_id, old_id, similarity, verdict, accepted): what each new fact would replace, one claim for a target.

    ``new`` has (id, position, content, domain, project), ``facts`` (id, content, domain, project, created_at, ...).
    Candidates share the domain and tokens: no token, no overlap. Facts of other domains are left out as they are read.
    """
    a = new.where(has_negation(F.col("content"))).select(F.col("id").alias("new_id"), "position", "domain", F.col("content").alias("new_content"), F.col("project").alias("new_project"))
    asked = written(a.select("domain").distinct(), "new-domains")
    b = facts.join(asked, "domain", "left_semi").where(P.current(now)).select(F.col("id").alias("old_id"), "domain", F.col("content").alias("old_content"), F.col("project").alias("old_project"), "created_at")
    tokens = lambda df, i, c: df.select(F.col(i).alias("id"), "domain", content_tokens(F.col(c)).alias("tokens"))
    met = overlapping(tokens(a, "new_id", "new_content"), tokens(b, "old_id", "old_content"), S.SUPERSESSION_FLOOR, ["domain"]).withColumnsRenamed({"a_id": "new_id", "b_id": "old_id"})
    pairs = met.join(a, "new_id").join(b.drop("domain"), "old_id")
    pairs = pairs.where(F.lower("new_content") != F.lower("old_content")).withColumn("verdict", project_relation(F.col("new_project"), F.col("old_project")))
    rank = F.when(F.col("verdict") == "same", 0).when(F.col("verdict") == "not_comparable", 1).otherwise(2)
    best = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("new_id").orderBy(rank, F.desc("similarity"), F.desc("created_at"), "old_id"))).where("_n = 1")
    claim = F.row_number().over(Window.partitionBy("old_id").orderBy("position", "new_id"))
    return best.withColumn("accepted", claim == 1).select("new_id", "old_id", "similarity", "verdict", "accepted")


def acceptance(basis: Column, verdict: Column, content: Column) -> Column:
    """Whether a proposed supersession is accepted."""
    return F.when(basis.isin("coexists", "uncertain"), False).when(verdict != "different", True).when(basis == "update", True).otherwise(has_negation(content))


def consolidate(staged: DataFrame, facts: DataFrame, now: Column, vocabulary: list[Domain], run_id: str) -> dict[str, DataFrame]:
    """One integration run: tables ``facts`` (the new snapshot), ``relations``, ``decisions`` and ``counts``.

    ``staged`` has (id, content, project, domain_hint, source_origin, created_at). Nothing is changed in place.
    """
    own = staged.withColumn("hinted", F.col("domain_hint").isNotNull()).withColumn("domain", classified(F.col("content"), F.col("domain_hint"), vocabulary))
    judged = reconciled(twins(own), facts, now)
    action = F.when(F.col("fate") != "stays", F.col("fate")).otherwise(F.col("action"))
    # A table: all that a run gives comes from it.
    decisions = written(judged.withColumn("outcome", action), "decisions")
    add = decisions.where("outcome = 'add'").withColumn("position", F.struct(~F.col("hinted"), F.col("created_at"), F.col("id")))
    links = supersessions(add, facts, now)
    accepted = links.where("accepted").select("old_id", F.col("new_id"))
    closed = facts.join(accepted.select(F.col("old_id").alias("id"), F.col("new_id").cast(facts.schema["superseded_by"].dataType).alias("_by")), "id", "left")
    hit = F.col("_by").isNotNull()
    closed = closed.withColumns({"status": F.when(hit, "superseded").otherwise(F.col("status")), "is_latest": F.col("is_latest") & ~hit, "superseded_by": F.coalesce("_by", "superseded_by"), "valid_until": F.when(hit, now).otherwise(F.col("valid_until")), "system_retired_at": F.when(hit, now).otherwise(F.col("system_retired_at"))}).select(*facts.columns)
    values = {"status": F.lit("active"), "is_latest": F.lit(True), "confidence": F.lit(S.DEFAULT_CONFIDENCE), "importance": importance(F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("domain"), vocabulary), "created_at": now, "valid_from": now}
    rows = add.withColumns(values)
    new = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(facts.schema[c].dataType).alias(c) for c in facts.columns])
    relations = links.where("accepted").select(F.lit(run_id).alias("consolidation_id"), F.col("new_id").cast("string").alias("fact_id"), F.col("old_id").cast("string").alias("related_fact_id"), F.lit("superseded").alias("kind"), "verdict")
    relations = relations.union(decisions.where("outcome = 'corroborates'").select(F.lit(run_id), F.col("winner").cast("string"), F.col("id").cast("string"), F.lit("corroborated_by"), F.lit("different")))
    counts = decisions.agg(F.count("*").alias("facts_in"), F.count_if(F.col("outcome") == "add").alias("facts_integrated"), F.count_if(F.col("outcome") != "add").alias("facts_rejected"))
    return {"facts": closed.unionByName(new), "relations": relations, "decisions": decisions, "counts": counts}


ENTITY = "struct<name:string,type:string,relationship:string>"


def stated_entities(entities_json: Column) -> Column:
    """Entities that an extraction has stated as JSON: an array of ENTITY, null where the text isn't an array with something in it.

    The text is parsed as a variant, so a malformed one is null and a field of another type doesn't lose its neighbours; elements
    that are no objects or have no name drop out.
    """
    # A parser stops where its value ends: inside brackets of either kind nothing may follow the text.
    within = [F.try_parse_json(F.concat(F.lit(a), entities_json, F.lit(b))) for a, b in (("[", "]"), ('{"e":', "}"))]
    elements = F.when(within[0].isNotNull(), F.try_variant_get(within[1], "$.e", "array<variant>"))
    text = lambda e, field: F.nullif(F.trim(F.try_variant_get(e, f"$.{field}", "string")), F.lit(""))
    shaped = F.transform(elements, lambda e: F.struct(*[text(e, f).alias(f) for f in ("name", "type", "relationship")]))
    return F.when(F.size(elements) > 0, F.filter(shaped, lambda e: e["name"].isNotNull()))


def entities_of(staged: DataFrame, provider: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (fact_id, name, type, relationship, stated) of ``staged`` (id, content, entities_json): what was stated, else what ``provider`` makes of
    the facts without a usable statement (rows fact_id, name, type, relationship)."""
    read = staged.withColumn("_stated", stated_entities(F.col("entities_json")))
    own = read.where("_stated is not null").select(F.col("id").alias("fact_id"), F.explode("_stated").alias("e")).select("fact_id", "e.*", F.lit(True).alias("stated"))
    rest = provider(read.where("_stated is null").drop("_stated"))
    return own.unionByName(rest.select("fact_id", "name", "type", "relationship", F.lit(False).alias("stated")))


def capitalised(most: int = 3) -> Callable[[DataFrame], DataFrame]:
    """A provider of rules: the first ``most`` different capitalised words are mentioned."""

    def run(facts: DataFrame) -> DataFrame:
        names = F.slice(F.array_distinct(F.regexp_extract_all("content", F.lit("\\b[A-Z][a-z]+"), F.lit(0))), 1, most)
        return facts.select(F.col("id").alias("fact_id"), F.explode(names).alias("name")).select("fact_id", "name", F.lit("thing").alias("type"), F.lit("mentions").alias("relationship"))

    return run
