"""Queries about what names, facts and entities lead to, each over all names of its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.operators import consolidate as C
from mnemolake.operators import entities as N
from mnemolake.operators import facts as K
from mnemolake.operators import graph as G
from mnemolake.operators import search as R
from mnemolake.plans import adapters as A
from mnemolake.plans import relational as Q
from mnemolake.plans.catalog import query
from mnemolake.plans.scalar import NORM

T = A.table

#: Suppliers' names, each with the entities of its family: every fifth supplier and the one after it.
_MEMBERS = """m AS (SELECT s_name AS name, 'supplier:' || s_suppkey AS entity_id FROM supplier
      UNION SELECT s_name, 'supplier:' || (s_suppkey + 1) FROM supplier WHERE s_suppkey % 5 = 1
      UNION SELECT b.s_name, 'supplier:' || (b.s_suppkey - 1) FROM supplier b JOIN supplier a ON a.s_suppkey = b.s_suppkey - 1 WHERE b.s_suppkey % 5 = 2)"""
_SUBJECT = f""", {_MEMBERS}, u AS (SELECT name, x.fact_id, bool_or(x.relationship = 'subject_of') AS is_subject, any_value(f.importance) AS importance
      FROM m JOIN fact_entities x USING (entity_id) JOIN order_facts f ON f.id = x.fact_id WHERE f.is_latest GROUP BY name, x.fact_id)"""


def members(spark, sf):
    """Every supplier's name, and one that nobody has."""
    names = T(spark, sf, "supplier").select(F.col("s_name").alias("name")).union(spark.createDataFrame([("nobody at all",)], "name string"))
    return G.named(names, A.entities(spark, sf), A.supplier_same(spark, sf))


@query("se_find_entity", "SELECT ' ' || upper(c_name) || ' ' AS name, e.id FROM customer JOIN entities e ON e.canonical_name = lower(trim(c_name))", "entities")
def _(spark, sf):
    names = T(spark, sf, "customer").select(F.concat(F.lit(" "), F.upper("c_name"), F.lit(" ")).alias("name"))
    return G.resolve_names(names, A.entities(spark, sf))


@query("xs_named_nodes", "SELECT a.name, e.id FROM (SELECT DISTINCT n_name AS name FROM nation UNION SELECT r_name FROM region) a JOIN entities e ON e.canonical_name = lower(trim(a.name))", "entities")
def _(spark, sf):
    names = T(spark, sf, "nation").select(F.col("n_name").alias("name")).union(T(spark, sf, "region").select("r_name"))
    return G.resolve_names(names, A.entities(spark, sf))


@query("se_named", f"{_SUBJECT} SELECT name, fact_id, is_subject FROM u UNION ALL SELECT 'nobody at all', NULL, NULL".lstrip(), "fact_entities", "order_facts")
def _(spark, sf):
    """All current facts of every name; the name without an entity is left for a search."""
    facts = A.order_facts(spark, sf).where("is_latest")
    return G.subject_facts(members(spark, sf), A.mentions(spark, sf), facts).select("name", "fact_id", "is_subject")


@query("se_pack", f"{_SUBJECT} SELECT name, fact_id, is_subject, row_number() OVER (PARTITION BY name ORDER BY is_subject DESC, importance DESC, fact_id) AS place FROM u QUALIFY place <= 10".lstrip(), "fact_entities", "order_facts")
def _(spark, sf):
    facts = A.order_facts(spark, sf).where("is_latest")
    return G.subject_facts(members(spark, sf), A.mentions(spark, sf), facts, 10).where("fact_id is not null")


@query("se_entity", f""", {_MEMBERS}, q AS (SELECT s_suppkey AS k, s_name AS n0, (SELECT s_name FROM supplier o WHERE o.s_suppkey = s.s_suppkey % 7 + 1) AS n1 FROM supplier s),
    t AS (SELECT k, n0 AS name, 0 AS position FROM q UNION ALL SELECT k, n1, 2 FROM q)
    SELECT CAST(k AS VARCHAR) AS query_id, x.fact_id AS id, min(position)::INTEGER AS position FROM t JOIN m ON m.name = t.name JOIN fact_entities x USING (entity_id) GROUP BY ALL""".lstrip(), "fact_entities")  # fmt: skip
def _(spark, sf):
    """For every supplier a query of five terms and more, of which two name suppliers."""
    s = T(spark, sf, "supplier").select("s_suppkey", "s_name")
    other = s.select((F.col("s_suppkey")).alias("o"), F.col("s_name").alias("other"))
    text = F.concat_ws(" ", "s_name", F.lit("or perhaps"), "other", F.lit("of them"), "s_name")
    asked = s.join(other, F.col("s_suppkey") % 7 + 1 == F.col("o")).select(F.col("s_suppkey").cast("string").alias("query_id"), F.regexp_replace(text, " or ", " ").alias("query"))
    return R.entity_list(asked, A.entities(spark, sf), A.mentions(spark, sf), A.supplier_same(spark, sf))


@query("wn_primary_ent", f"""{_SUBJECT.split(', u AS')[0]}, n AS (SELECT entity_id, count(DISTINCT fact_id) AS n FROM fact_entities GROUP BY entity_id)
    SELECT m.name, m.entity_id FROM m JOIN entities e ON e.id = m.entity_id LEFT JOIN n ON n.entity_id = m.entity_id
    QUALIFY row_number() OVER (PARTITION BY m.name ORDER BY coalesce(n.n, 0) DESC, e.born, m.entity_id) = 1""".lstrip(), "fact_entities", "entities")  # fmt: skip
def _(spark, sf):
    return G.primary(members(spark, sf), A.mentions(spark, sf), A.entities(spark, sf))


@query("se_context", """, c AS (SELECT 'part:' || p_partkey AS id FROM part WHERE p_partkey % 10 = 7),
    ends AS (SELECT from_entity AS center, to_entity AS neighbour, strength FROM entity_edges WHERE from_entity IN (FROM c) UNION ALL SELECT to_entity, from_entity, strength FROM entity_edges WHERE to_entity IN (FROM c)),
    top AS (SELECT center, neighbour, max(strength) AS strength FROM ends WHERE neighbour NOT IN (FROM c) GROUP BY center, neighbour QUALIFY row_number() OVER (PARTITION BY center ORDER BY max(strength) DESC, neighbour) <= 10),
    f AS (SELECT DISTINCT entity_id, fact_id FROM fact_entities), r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY fact_id DESC) AS n FROM f)
    SELECT center, neighbour, fact_id FROM top JOIN r ON r.entity_id = neighbour WHERE n <= 5""".lstrip(), "entity_edges", "fact_entities")  # fmt: skip
def _(spark, sf):
    centers = T(spark, sf, "part").where("p_partkey % 10 = 7").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"))
    return G.context(centers, A.entity_edges(spark, sf, centers), A.mentions(spark, sf))


@query("jn_entity_facts", """, u AS (SELECT entity_id, f.id, bool_or(e.relationship = 'subject_of') AS is_subject, any_value(f.importance) AS importance, any_value(f.created_at) AS created_at FROM order_facts f JOIN fact_entities e ON e.fact_id = f.id WHERE f.is_latest GROUP BY entity_id, f.id)
    SELECT entity_id, id, is_subject, row_number() OVER (PARTITION BY entity_id ORDER BY is_subject DESC, importance DESC, created_at DESC, id) AS place FROM u QUALIFY place <= 5""".lstrip(), "order_facts", "fact_entities")  # fmt: skip
def _(spark, sf):
    return K.facts_by_entity(A.order_facts(spark, sf).where("is_latest"), A.mentions(spark, sf), 5)


#: The backing of staged facts, as a table expression after those that it needs.
_KINDS = Q._BACKING.replace("SELECT session_fact_id, event_id, 'corroborating'", "back AS (SELECT session_fact_id, event_id, 'corroborating'", 1).replace("j AS (", "j AS (", 1)
_KINDS = _KINDS.replace("JOIN p USING (session_fact_id))\n    back AS", "JOIN p USING (session_fact_id)),\n    back AS")


@query("jn_backing", _KINDS + " UNION ALL SELECT session_fact_id, pid, 'primary' FROM p) SELECT content, string_agg(DISTINCT extraction_type, ',' ORDER BY extraction_type) AS kinds FROM session_facts_c JOIN back ON session_fact_id = id GROUP BY content", "session_events")
def _(spark, sf):
    said = Q.events(spark, sf).where("role = 'user'").select(F.col("sequence").alias("id"), F.regexp_extract("content", "([^ ]+)$", 1).alias("content"))
    return K.backing_kinds(said.select("content"), said, Q._provenance(spark, sf)).withColumn("kinds", F.concat_ws(",", "kinds"))


@query("st_source", "SELECT s.id AS fact_id, e.id AS event_id, e.role FROM session_facts s JOIN fact_sources x ON x.session_fact_id = s.id JOIN session_events e ON e.id = x.event_id", "session_facts", "fact_sources", "session_events")
def _(spark, sf):
    s = A.session_facts(spark, sf)
    facts = s.select("id", F.concat(F.lit("src-"), F.col("id").cast("string")).alias("source_id"))
    sources = s.select(F.concat(F.lit("src-"), F.col("id").cast("string")).alias("id"), F.to_json(F.struct(F.col("id").alias("session_fact_id"))).alias("metadata"))
    return K.provenance_chain(facts, sources, A.fact_sources(spark, sf), Q.events(spark, sf))


@query("st_inference", "SELECT i.vec_id AS id, count(DISTINCT f.doc_id) AS evidence, 'pending' AS status FROM embeddings i JOIN documents f ON f.doc_id IN (i.vec_id, i.vec_id + 1, i.vec_id * 1000) WHERE i.vec_id % 3 <> 1 GROUP BY i.vec_id")
def _(spark, sf):
    """Hypotheses on one, two or no entities, with evidence that partly doesn't exist: those that pass the gate."""
    i = T(spark, sf, "embeddings").select("vec_id")
    pair = F.when(F.col("vec_id") % 3 == 2, F.array(F.lit("a"), F.lit("b"))).when(F.col("vec_id") % 3 == 1, F.array(F.lit("a")))
    hypotheses = i.select(F.col("vec_id").alias("id"), F.concat(F.lit("h"), F.col("vec_id").cast("string")).alias("hypothesis"), pair.alias("entity_ids"))
    evidence = i.select(F.col("vec_id").alias("inference_id"), F.explode(F.array(F.col("vec_id"), F.col("vec_id") + 1, F.col("vec_id") * 1000)).alias("fact_id"))
    facts = T(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return N.inferences_to_add(hypotheses, evidence, facts).select("id", "evidence", "status")


@query("xs_decisions", """SELECT superseded_by AS fact_id, string_agg(id || '/superseded/' || CASE WHEN id % 2 = 0 THEN 'update' ELSE 'contradicts' END || '/heuristic/' || domain, ' ' ORDER BY id) AS decisions
    FROM order_facts WHERE superseded_by IS NOT NULL GROUP BY 1""", "order_facts")  # fmt: skip
def _(spark, sf):
    rows = A.order_facts(spark, sf).where("superseded_by is not null").select(F.col("superseded_by").alias("fact_id"), F.col("id").alias("related_fact_id"), F.lit("superseded").alias("kind"), F.when(F.col("id") % 2 == 0, "update").otherwise("contradicts").alias("basis"), F.lit("heuristic").alias("decided_by"), F.col("domain").alias("reason"))
    text = lambda d: F.concat_ws("/", d["related_fact_id"].cast("string"), d["kind"], d["basis"], d["decided_by"], d["reason"])
    return K.decision_views(rows).select("fact_id", F.array_join(F.transform("decisions", text), " ").alias("decisions"))


@query("co_counts", f", k AS (SELECT DISTINCT {NORM.format('content')} AS key FROM session_facts WHERE consolidation_id IS NULL) SELECT (SELECT count(*) FROM session_facts WHERE consolidation_id IS NULL) AS facts_in, (SELECT count(*) FROM k) AS facts_integrated, (SELECT count(*) FROM session_facts WHERE consolidation_id IS NULL) - (SELECT count(*) FROM k) AS facts_rejected".lstrip(), "session_facts")
def _(spark, sf):
    s = A.session_facts(spark, sf).where("consolidation_id is null").withColumn("project", F.concat(F.lit("p"), F.col("session_id")))
    f = A.facts(spark, sf).withColumn("project", F.lit(None).cast("string"))
    return C.consolidate(s, f, A.now(), [], "run-2")["counts"].select("facts_in", "facts_integrated", "facts_rejected")


@query("xs_group_lookup", """WITH f AS (SELECT DISTINCT '/home/' || p_name AS cwd, '/r/%2Fhome%2F' || replace(replace(p_name, ' ', '%20'), '#', '%23') AS folder FROM part WHERE p_partkey % 2 = 0)
    FROM f UNION ALL SELECT DISTINCT '/home/' || p_name, '/r/long-' || p_partkey FROM part WHERE p_partkey % 2 = 1 AND '/home/' || p_name NOT IN (SELECT cwd FROM f)""")  # fmt: skip
def _(spark, sf):
    """Folders of working directories: half by their encoded names, half by what their records say."""
    from mnemolake.sources.transcripts import folders_of

    part = T(spark, sf, "part").select("p_partkey", F.concat(F.lit("/home/"), "p_name").alias("cwd"))
    name = F.replace(F.url_encode("cwd"), F.lit("+"), F.lit("%20"))
    odd = F.concat(F.lit("long-"), F.col("p_partkey").cast("string"))
    folder = F.concat(F.lit("/r/"), F.when(F.col("p_partkey") % 2 == 0, name).otherwise(odd))
    files = part.select(F.lit("/r").alias("root"), F.concat(folder, F.lit("/s/chat_history.jsonl")).alias("path"))
    recorded = part.where("p_partkey % 2 = 1").select(folder.alias("folder"), F.concat("cwd", F.lit("\n")).alias("text"))
    return folders_of(files, part.select(F.concat("cwd", F.lit("/")).alias("cwd")), recorded).select(F.regexp_replace("cwd", "/$", "").alias("cwd"), "folder")


@query("xs_mtime", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN TIMESTAMP '2024-03-04 05:06:07' ELSE TIMESTAMP '2024-01-01' + to_seconds(conv_id) END AS occurred_at FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''")
def _(spark, sf):
    """Lines with a clock keep it, the others have their file's."""
    from mnemolake.sources.transcripts import map_lines

    c = T(spark, sf, "conversations")
    said = F.struct(F.col("role").alias("type"), F.when(F.col("turn") % 2 == 0, "2024-03-04T05:06:07Z").alias("timestamp"), F.struct("role", F.col("text").alias("content")).alias("message"))
    mtime = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(secs=F.col("conv_id").cast("decimal(18,6)"))
    lines = c.select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line"), F.to_json(said).alias("value"), mtime.alias("mtime"))
    return map_lines(lines).select(F.col("path").cast("long").alias("conv_id"), F.col("line").alias("turn"), F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"))
