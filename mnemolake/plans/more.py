"""Queries of composed reads and further writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemolake.functions import text as X
from mnemolake.operators import consolidate as C
from mnemolake.operators import entities as N
from mnemolake.operators import facts as K
from mnemolake.operators import graph as G
from mnemolake.operators import log as L
from mnemolake.operators import search as R
from mnemolake.plans import adapters as A
from mnemolake.plans import relational as Q
from mnemolake.plans import retrieval as _retrieval  # noqa: F401
from mnemolake.plans.catalog import QUERIES, SQL, query
from mnemolake.plans.scalar import NOW

T = A.table


def same_as(name: str, other: str) -> None:
    """A second name of a query: two rows of the inventory that one operator covers."""
    QUERIES[name] = QUERIES[other]
    if other in SQL:
        SQL[name] = SQL[other]


def _(spark, sf):
    name = T(spark, sf, "customer").where("c_custkey = 7").select(F.col("c_name").alias("name"))
    family = G.resolve_names(name, A.entities(spark, sf)).select(F.col("id").alias("entity_id"))
    links = A.fact_entities(spark, sf).join(family, "entity_id", "left_semi")
    return links.join(A.order_facts(spark, sf).where("is_latest").select(F.col("id").alias("fact_id")), "fact_id", "left_semi").groupBy("fact_id").agg(F.bool_or(F.col("relationship") == "subject_of").alias("is_subject"))


def _(spark, sf):
    center = spark.createDataFrame([("part:7",)], "id string")
    near = G.neighbours(A.entity_edges(spark, sf), center).select(F.col("neighbour").alias("entity_id"))
    w = Window.partitionBy("entity_id").orderBy(F.desc("fact_id"))
    return A.fact_entities(spark, sf).join(near, "entity_id").withColumn("n", F.row_number().over(w)).where("n <= 5").select(F.col("entity_id").alias("neighbour"), "fact_id")


@query("in_graph", "SELECT entity_id, count(*) FILTER (WHERE relationship = 'subject_of') AS about, count(*) FILTER (WHERE relationship <> 'subject_of') AS mentions FROM fact_entities GROUP BY entity_id", "fact_entities")
def _(spark, sf):
    subject = F.col("relationship") == "subject_of"
    return A.fact_entities(spark, sf).groupBy("entity_id").agg(F.count_if(subject).alias("about"), F.count_if(~subject).alias("mentions"))


@query("in_pickd", "SELECT conversation, id FROM (SELECT conversation, id, row_number() OVER (PARTITION BY conversation ORDER BY CASE WHEN contains(lower(content), 'than') THEN 0 WHEN role = 'user' THEN 1 ELSE 2 END, sequence DESC) AS n FROM session_events) WHERE n <= 3", "session_events")
def _(spark, sf):
    order = F.when(F.contains(F.lower("content"), F.lit("than")), 0).when(F.col("role") == "user", 1).otherwise(2)
    w = Window.partitionBy("conversation").orderBy(order, F.desc("sequence"))
    return Q.events(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 3").select("conversation", "id")


@query("in_substr", "SELECT 'i' || b.item_id AS entity_id, CAST(count(*) AS BIGINT) AS total FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) GROUP BY b.item_id")
def _(spark, sf):
    names = T(spark, sf, "benchmark").select(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("name"))
    docs = T(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("sequence"), F.col("text").alias("content"))
    return L.names_in_text(names, docs, keep=1).select("entity_id", "total")


@query("co_uttered", ", p AS (SELECT lower(r) AS canonical_name, 'e' || r AS entity_id FROM (VALUES ('user'), ('system')) v(r)) SELECT e.id AS fact_id, p.entity_id FROM session_events e JOIN p ON p.canonical_name = e.role".lstrip(), "session_events")
def _(spark, sf):
    people = spark.createDataFrame([("euser", "person", "user", False), ("esystem", "person", "system", False)], "id string, type string, canonical_name string, is_self boolean")
    f = Q.events(spark, sf).select("id", F.col("role").alias("speaker"), F.col("role").alias("speaker_role"))
    return N.uttered(f, people).select("fact_id", "entity_id")


@query("co_persist", "SELECT session_id, content_hash, min(id) AS id FROM session_facts GROUP BY session_id, content_hash", "session_facts")
def _(spark, sf):
    s = A.session_facts(spark, sf)
    return K.first_of(s, ["session_id", "content_hash"], [F.col("id")]).select("session_id", "content_hash", "id")


@query("co_link", Q._BACKING.split("UNION ALL")[0], "session_events")
def _(spark, sf):
    return Q._provenance(spark, sf).where("extraction_type = 'corroborating'").select("session_fact_id", "event_id", "extraction_type")


_OVERLAP = Q._SUP.split("SELECT new_id, old_id, round")[0].replace("WHERE similarity >= 0.3)", "WHERE similarity >= 0.3 AND new_id % 3 <> old_id % 3)").replace("item_id AS old_id", "item_id + 1 AS old_id") + "SELECT new_id, old_id, round(similarity, 6) AS similarity FROM b WHERE k = 1"


@query("co_overlap", _OVERLAP)
def _(spark, sf):
    b = T(spark, sf, "benchmark")
    a = b.select(F.col("item_id").alias("new_id"), F.concat(F.lit("not "), F.col("text")).alias("c")).withColumn("w", X.content_tokens(F.col("c")))
    o = b.select((F.col("item_id") + 1).alias("old_id"), F.concat(F.col("text"), F.lit(" indeed")).alias("oc")).withColumn("v", X.content_tokens(F.col("oc")))
    tokens = lambda df, i, t: df.select(F.col(i).alias("id"), F.col(t).alias("tokens"), F.lit(0).alias("one"))
    met = C.overlapping(tokens(a, "new_id", "w"), tokens(o, "old_id", "v"), 0.3, ["one"]).withColumnsRenamed({"a_id": "new_id", "b_id": "old_id"})
    pairs = met.join(a, "new_id").join(o, "old_id").where("lower(c) <> lower(oc) and new_id % 3 <> old_id % 3")
    return K.first_of(pairs, ["new_id"], [F.desc("similarity"), F.col("old_id")]).select("new_id", "old_id", F.round("similarity", 6).alias("similarity"))


@query("st_find_or_create")
def _(spark, sf):
    p = T(spark, sf, "part")
    m = p.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("mention_id"), F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.concat(F.col("p_name"), F.lit(" x"))).alias("name"), F.lit("part").alias("type"), F.col("p_partkey").alias("position"))
    return N.find_or_create(m, A.entities(spark, sf))[0].select("mention_id", "entity_id", "created")


@query("st_claim", "SELECT id, coalesce(consolidation_id, 'run-2') AS consolidation_id FROM session_facts", "session_facts")
def _(spark, sf):
    return A.session_facts(spark, sf).select("id", F.coalesce("consolidation_id", F.lit("run-2")).alias("consolidation_id"))


@query("xs_access", "SELECT p_partkey AS id, CAST(count(l_orderkey) AS BIGINT) AS access_count FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def _(spark, sf):
    parts = T(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit(0).cast("long").alias("access_count"), F.lit(None).cast("timestamp").alias("last_accessed_at"))
    seen = T(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))
    return N.touched(parts, seen, "id", "access_count", "last_accessed_at", A.now()).select("id", "access_count")


@query("src_copy_all", "SELECT role, count(*) AS inserted FROM conversations WHERE turn > 1 GROUP BY role")
def _(spark, sf):
    from mnemolake.sources.transcripts import copy_new

    c = T(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line"), "role")
    return copy_new(c, c.where("line <= 1")).groupBy("role").agg(F.count("*").alias("inserted"))


@query("src_map_line", "SELECT conv_id, turn, role, 'message' AS event_type, sha256(text) AS hash FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''")
def _(spark, sf):
    from mnemolake.sources.transcripts import map_lines

    c = T(spark, sf, "conversations")
    lines = c.select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line"), F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")).alias("message"))).alias("value"))
    return map_lines(lines).select(F.col("path").cast("long").alias("conv_id"), F.col("line").alias("turn"), "role", "event_type", F.sha2("content", 256).alias("hash"))


@query("fn_interval_age", f"SELECT id, CAST(date_diff('day', CAST(created_at AS DATE), CAST({NOW} AS DATE)) AS BIGINT) AS days FROM facts", "facts")
def _(spark, sf):
    return A.facts(spark, sf).select("id", F.date_diff(F.to_date(A.now()), F.to_date("created_at")).cast("long").alias("days"))


@query("se_provider")
def _(spark, sf):
    """An embedder that fails leaves keyword search."""
    from mnemolake.providers import query_vector

    assert query_vector(None, "than") is None
    asked = spark.createDataFrame([("q", "than", None)], "query_id string, query string, domain string")
    return R.hybrid(A.facts(spark, sf), asked, A.now()).select("id", "rank0")


for _name, _other in (("wn_claim", "co_supersede"), ("jn_supersede", "co_supersede"), ("jn_related", "se_related"), ("in_layers", "tk_layers"), ("in_ego", "tk_ego"), ("co_backing", "wn_backing"), ("ss_extract_wm", "ag_unexamined")):
    same_as(_name, _other)
