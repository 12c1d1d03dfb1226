"""The driver's tables in the store's shapes, as Spark frames and, the same, as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp")


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """documents with labels; of equal texts the lowest id is active, the others are superseded by it.

    The winner of equal texts is found on hashes, so that texts aren't shuffled for it.
    """
    docs = table(spark, sf, "documents").withColumn("h", F.sha2("text", 256))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("winner"))
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    made = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    own = docs.join(first, "h").join(labels, "doc_id", "left")
    late = F.col("doc_id") > F.col("winner")
    return own.select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("domain"), F.col("source").alias("subdomain"),
        F.lit(0.7).cast("double").alias("confidence"), F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.2).otherwise(0.5).cast("double").alias("importance"),
        F.when(F.col("doc_id") % 4 == 0, "explicit").otherwise("inferred").alias("source_type"),
        F.when(late, "superseded").otherwise("active").alias("status"), (~late).alias("is_latest"), F.when(late, F.col("winner")).alias("superseded_by"),
        made.alias("created_at"), F.when(F.col("doc_id") % 3 != 0, made - F.make_dt_interval(days=(F.col("doc_id") % 10).cast("int"))).alias("valid_from"),
        F.when(F.col("doc_id") % 11 == 0, F.to_timestamp(F.lit("2024-01-15"))).alias("valid_until"),
        F.when(late, made + F.make_dt_interval(days=F.lit(1))).alias("system_retired_at"),
        F.concat(F.lit("s"), (F.col("doc_id") % 50).cast("string")).alias("session_id"),
        F.when(F.col("doc_id") % 2 == 0, "user").otherwise("assistant").alias("speaker_role"),
    )


def fact_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Of :func:`facts` what documents have alone: without the joins for which texts would be shuffled."""
    return table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("domain"), F.col("source").alias("subdomain"))


def session_events(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as a log. The sequence is unique, ascending within a conversation, and needs no global sort."""
    c = table(spark, sf, "conversations")
    seq = (F.col("conv_id") * 100 + F.col("turn")).cast("long")
    made = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(secs=seq.cast("decimal(18,6)"))
    return c.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.when(F.col("conv_id") % 5 != 0, F.col("conv_id").cast("string")).otherwise("").alias("client_session_id"),
        F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("m"), F.col("conv_id").cast("string"))).alias("mcp_session_id"),
        seq.alias("sequence"), F.lit("message").alias("event_type"), F.col("role"), F.col("text").alias("content"),
        F.lit(None).cast("string").alias("speaker"), made.alias("created_at"),
    )


def session_facts(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as staged facts."""
    c = table(spark, sf, "conversations").where("role = 'user'")
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).cast("long").alias("id"), F.col("conv_id").cast("string").alias("session_id"), F.col("text").alias("content"),
        F.sha2("text", 256).alias("content_hash"), F.when(F.col("turn") == 0, "explicit").otherwise("inferred").alias("source_origin"),
        F.when(F.col("conv_id") % 4 == 0, F.lit("Work Notes")).alias("domain_hint"),
        F.when(F.col("conv_id") % 3 == 0, F.lit("run-1")).alias("consolidation_id"),
        (F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(mins=(F.col("conv_id") * 10 + F.col("turn")).cast("int"))).alias("created_at"),
    )


def extract_watermarks(spark: SparkSession, sf: str) -> DataFrame:
    """Marks of two conversations in three: examined up to turn 2."""
    c = table(spark, sf, "conversations").select("conv_id").distinct().where("conv_id % 3 <> 0")
    keyed = F.col("conv_id") % 5 != 0
    return c.select(F.when(keyed, "client").otherwise("mcp").alias("kind"), F.when(keyed, F.col("conv_id").cast("string")).otherwise(F.concat(F.lit("m"), F.col("conv_id").cast("string"))).alias("conversation_id"), (F.col("conv_id") * 100 + 2).cast("long").alias("last_event_sequence"))


def fact_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh user turn backs a fact."""
    return table(spark, sf, "conversations").where("role = 'user' and (conv_id + turn) % 7 = 0").select((F.col("conv_id") * 100 + F.col("turn")).cast("long").alias("session_fact_id"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("event_id"))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("fact_id"), F.lit("m").alias("model"), F.size("embedding").alias("dimensions"), F.col("embedding").alias("vector"), F.col("label"))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Customers, suppliers, parts, nations and regions. A type's ids have a prefix."""
    parts = []
    for i, (name, key, title) in enumerate((("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"))):
        parts.append(table(spark, sf, name).select(F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("id"), F.lit(name).alias("type"), F.col(title).alias("name"), F.lower(F.trim(title)).alias("canonical_name"), (F.col(key).cast("long") * 10 + i).alias("born")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fact_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as facts: about their customer, concerning their parts, supplied by their suppliers."""
    return mentions(spark, sf, True)


def mentions(spark: SparkSession, sf: str, once: bool = False) -> DataFrame:
    """Links of :func:`fact_entities`, each as often as lines state it (``once``: once): for what makes them distinct itself, so that rows aren't
    held and shuffled twice for it."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    name = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("entity_id")
    each = lambda df: df.distinct() if once else df
    return (
        orders.select(F.col("o_orderkey").alias("fact_id"), name("customer", "o_custkey"), F.lit("subject_of").alias("relationship"))
        .union(each(lines.select("l_orderkey", name("part", "l_partkey"), F.lit("concerns"))))
        .union(each(lines.select("l_orderkey", name("supplier", "l_suppkey"), F.lit("supplied_by"))))
    )


def source_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of documents as entities."""
    name = F.col("source")
    return table(spark, sf, "documents").select("source").distinct().select(F.concat(F.lit("source:"), name).alias("id"), F.lit("source").alias("type"), name.alias("name"), F.lower(F.trim(name)).alias("canonical_name"), F.xxhash64(name).alias("born"))


def source_links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("fact_id"), F.concat(F.lit("source:"), "source").alias("entity_id"), F.lit("subject_of").alias("relationship"))


def source_same(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of two digits are the same as those of their last digit."""
    name = F.col("source")
    return table(spark, sf, "documents").select("source").distinct().where(name.rlike("^src1[0-9]$")).select(F.concat(F.lit("source:"), name).alias("from_entity"), F.concat(F.lit("source:src"), F.substring(name, 5, 1)).alias("to_entity"))


def supplier_same(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth supplier is the same as the one after it."""
    name = lambda c: F.concat(F.lit("supplier:"), c.cast("string"))
    return table(spark, sf, "supplier").where("s_suppkey % 5 = 1").select(name(F.col("s_suppkey")).alias("from_entity"), name(F.col("s_suppkey") + 1).alias("to_entity"))


_INDEXES: dict[tuple[str, str], str] = {}


def text_index(spark: SparkSession, sf: str):
    """An index of the facts' texts, made for an input path once in an application."""
    import uuid

    from mnemolake.operators.textindex import TextIndex
    from mnemolake.scratch import folder
    from mnemolake.store import Store

    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        root = f"{folder(spark)}/text-index-{uuid.uuid4().hex}"
        TextIndex(Store(spark, root)).add(fact_texts(spark, sf), "id", ["content", "domain", "subdomain"])
        _INDEXES[key] = root
    return TextIndex(Store(spark, _INDEXES[key]))


def order_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as facts of a customer, each superseded by the customer's next."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    following = F.lead("o_orderkey").over(w)
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("domain"), F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("importance"),
        F.when(following.isNull(), "active").otherwise("superseded").alias("status"), following.isNull().alias("is_latest"), following.alias("superseded_by"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), F.lead(F.col("o_orderdate").cast("timestamp")).over(w).alias("system_retired_at"), F.lit(None).cast("timestamp").alias("valid_until"),
    )


def entity_edges(spark: SparkSession, sf: str, at: DataFrame | None = None) -> DataFrame:
    """Parts that occur in one order, with the strength of so many co-occurrences; ``at`` (id): only edges at these entities."""
    from mnemolake.operators.graph import co_occurrences, potentiated

    links = mentions(spark, sf).where("relationship = 'concerns'")
    return co_occurrences(links, at).select(F.col("a").alias("from_entity"), F.col("b").alias("to_entity"), F.lit("co_mentioned").alias("relationship"), "n", potentiated(F.col("n")).alias("strength"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as metered model calls; no tokens are reported for one quantity in ten."""
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_shipdate").cast("timestamp").alias("created_at"),
        F.col("l_returnflag").alias("provider"), F.concat(F.lit("stage-"), F.col("l_linestatus")).alias("stage"),
        F.when(F.col("l_quantity").cast("int") % 10 != 0, F.col("l_quantity").cast("long")).alias("input_tokens"), F.col("l_linenumber").cast("long").alias("output_tokens"),
    )


#: The same in DuckDB, by name.
CTE: dict[str, str] = {
    "facts": """facts AS (
        SELECT d.doc_id AS id, d.text AS content, d.lang AS domain, d.source AS subdomain, CAST(0.7 AS DOUBLE) AS confidence,
          CAST(CASE l.quality WHEN 1 THEN 0.9 WHEN 0 THEN 0.2 ELSE 0.5 END AS DOUBLE) AS importance,
          CASE WHEN d.doc_id % 4 = 0 THEN 'explicit' ELSE 'inferred' END AS source_type,
          CASE WHEN d.doc_id > d.winner THEN 'superseded' ELSE 'active' END AS status, d.doc_id <= d.winner AS is_latest,
          CASE WHEN d.doc_id > d.winner THEN d.winner END AS superseded_by,
          TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS created_at,
          CASE WHEN d.doc_id % 3 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) - to_days(CAST(d.doc_id % 10 AS INTEGER)) END AS valid_from,
          CASE WHEN d.doc_id % 11 = 0 THEN TIMESTAMP '2024-01-15' END AS valid_until,
          CASE WHEN d.doc_id > d.winner THEN TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) + to_days(1) END AS system_retired_at,
          's' || CAST(d.doc_id % 50 AS VARCHAR) AS session_id, CASE WHEN d.doc_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS speaker_role
        FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS winner FROM documents) d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
    "session_events": """session_events AS (
        SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id, CASE WHEN conv_id % 5 <> 0 THEN CAST(conv_id AS VARCHAR) ELSE '' END AS client_session_id,
          CASE WHEN conv_id % 5 = 0 THEN 'm' || CAST(conv_id AS VARCHAR) END AS mcp_session_id, CAST(conv_id * 100 + turn AS BIGINT) AS sequence,
          'message' AS event_type, role, text AS content, CAST(NULL AS VARCHAR) AS speaker, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 100 + turn) AS created_at,
          CASE WHEN conv_id % 5 <> 0 THEN CAST(conv_id AS VARCHAR) ELSE 'm' || CAST(conv_id AS VARCHAR) END AS conversation,
          CASE WHEN conv_id % 5 <> 0 THEN 'client' ELSE 'mcp' END AS kind
        FROM conversations)""",
    "session_facts": """session_facts AS (
        SELECT CAST(conv_id * 100 + turn AS BIGINT) AS id, CAST(conv_id AS VARCHAR) AS session_id, text AS content, sha256(text) AS content_hash,
          CASE WHEN turn = 0 THEN 'explicit' ELSE 'inferred' END AS source_origin, CASE WHEN conv_id % 4 = 0 THEN 'Work Notes' END AS domain_hint,
          CASE WHEN conv_id % 3 = 0 THEN 'run-1' END AS consolidation_id, TIMESTAMP '2024-01-01' + to_minutes(conv_id * 10 + turn) AS created_at
        FROM conversations WHERE role = 'user')""",
    "extract_watermarks": """extract_watermarks AS (
        SELECT DISTINCT CASE WHEN conv_id % 5 <> 0 THEN 'client' ELSE 'mcp' END AS kind, CASE WHEN conv_id % 5 <> 0 THEN CAST(conv_id AS VARCHAR) ELSE 'm' || CAST(conv_id AS VARCHAR) END AS conversation_id,
          CAST(conv_id * 100 + 2 AS BIGINT) AS last_event_sequence FROM conversations WHERE conv_id % 3 <> 0)""",
    "fact_sources": """fact_sources AS (
        SELECT CAST(conv_id * 100 + turn AS BIGINT) AS session_fact_id, CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS event_id FROM conversations WHERE role = 'user' AND (conv_id + turn) % 7 = 0)""",
    "entities": """entities AS (
        SELECT 'customer:' || c_custkey AS id, 'customer' AS type, c_name AS name, lower(trim(c_name)) AS canonical_name, CAST(c_custkey AS BIGINT) * 10 AS born FROM customer
        UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, lower(trim(s_name)), CAST(s_suppkey AS BIGINT) * 10 + 1 FROM supplier
        UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, lower(trim(p_name)), CAST(p_partkey AS BIGINT) * 10 + 2 FROM part
        UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, lower(trim(n_name)), CAST(n_nationkey AS BIGINT) * 10 + 3 FROM nation
        UNION ALL SELECT 'region:' || r_regionkey, 'region', r_name, lower(trim(r_name)), CAST(r_regionkey AS BIGINT) * 10 + 4 FROM region)""",
    "fact_entities": """fact_entities AS (
        SELECT o_orderkey AS fact_id, 'customer:' || o_custkey AS entity_id, 'subject_of' AS relationship FROM orders
        UNION ALL SELECT DISTINCT l_orderkey, 'part:' || l_partkey, 'concerns' FROM lineitem
        UNION ALL SELECT DISTINCT l_orderkey, 'supplier:' || l_suppkey, 'supplied_by' FROM lineitem)""",
    "order_facts": """order_facts AS (
        SELECT o_orderkey AS id, o_custkey AS owner, o_orderstatus AS domain, least(1.0, o_totalprice / 500000) AS importance,
          CASE WHEN lead(o_orderkey) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS status, lead(o_orderkey) OVER w IS NULL AS is_latest,
          lead(o_orderkey) OVER w AS superseded_by, o_orderdate AS created_at, lead(o_orderdate) OVER w AS system_retired_at, CAST(NULL AS TIMESTAMP) AS valid_until
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))""",
    "entity_edges": """concerns AS (SELECT DISTINCT l_orderkey, 'part:' || l_partkey AS e FROM lineitem), entity_edges AS (
        SELECT x.e AS from_entity, y.e AS to_entity, 'co_mentioned' AS relationship, CAST(count(*) AS BIGINT) AS n, 1 - pow(0.7, count(*)) AS strength
        FROM concerns x JOIN concerns y ON x.l_orderkey = y.l_orderkey AND x.e < y.e GROUP BY x.e, y.e)""",
    "runs": """runs AS (
        SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id, l_shipdate AS created_at, l_returnflag AS provider, 'stage-' || l_linestatus AS stage,
          CASE WHEN CAST(l_quantity AS INTEGER) % 10 <> 0 THEN CAST(l_quantity AS BIGINT) END AS input_tokens, CAST(l_linenumber AS BIGINT) AS output_tokens FROM lineitem)""",
}
