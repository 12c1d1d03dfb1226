"""Queries of predicates, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake import schemas as S
from mnemolake.functions import predicates as P
from mnemolake.functions import text as X
from mnemolake.functions.vectors import cosine, dot, truncated
from mnemolake.operators import consolidate as C
from mnemolake.operators import facts as K
from mnemolake.operators import log as L
from mnemolake.plans import adapters as A
from mnemolake.plans.catalog import query

NOW = f"TIMESTAMP '{A.NOW}'"
CURRENT = f"status = 'active' AND is_latest AND (valid_until IS NULL OR valid_until > {NOW})"
AT = "2024-01-01 08:00:00"
NORM = r"regexp_replace(regexp_replace(trim(lower({0}), E' \t\n\r\f\x0b'), '[.,;:!?]+$', ''), '[ \t\n\r\f]+', ' ', 'g')"
VOCABULARY = [C.Domain("timing", ("than", "thre"), 0.9), C.Domain("reason", ("[aeiou]{3}",), 0.7), C.Domain("other", ("zzzz",), 0.4)]


@query("flt_current", f"SELECT id, domain, importance FROM facts WHERE {CURRENT}", "facts")
def _(spark, sf):
    return A.facts(spark, sf).where(P.current(A.now())).select("id", "domain", "importance")


@query("flt_asof", f"SELECT id, status FROM facts WHERE created_at <= TIMESTAMP '{AT}' AND (system_retired_at IS NULL OR system_retired_at > TIMESTAMP '{AT}')", "facts")
def _(spark, sf):
    return A.facts(spark, sf).where(P.as_of(F.lit(AT).cast("timestamp"))).select("id", "status")


@query("flt_asof_read", f"SELECT id FROM facts WHERE created_at <= TIMESTAMP '{AT}' AND (system_retired_at IS NULL OR system_retired_at > TIMESTAMP '{AT}') ORDER BY created_at DESC, id LIMIT 100", "facts")
def _(spark, sf):
    return A.facts(spark, sf).where(P.as_of(F.lit(AT).cast("timestamp"))).orderBy(F.desc("created_at"), "id").limit(100).select("id")


@query("flt_asof_chain", "SELECT id, owner FROM order_facts WHERE created_at <= TIMESTAMP '1998-01-01' AND (system_retired_at IS NULL OR system_retired_at > TIMESTAMP '1998-01-01')", "order_facts")
def _(spark, sf):
    return A.order_facts(spark, sf).where(P.as_of(F.lit("1998-01-01").cast("timestamp"))).select("id", "owner")


@query("flt_warn", "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'early' END AS warning FROM events")
def _(spark, sf):
    return A.table(spark, sf, "events").select("event_id", F.when(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"), "early").alias("warning"))


@query("flt_struct", f"SELECT id, domain, subdomain FROM facts WHERE {CURRENT} AND domain = 'en' AND subdomain = 'src1' ORDER BY created_at DESC, id LIMIT 20", "facts")
def _(spark, sf):
    return K.structured(A.facts(spark, sf), A.now(), domain="en", subdomain="src1").select("id", "domain", "subdomain")


@query("flt_domain", f"SELECT id, subdomain FROM facts WHERE {CURRENT} AND domain = 'de'", "facts")
def _(spark, sf):
    return A.facts(spark, sf).where(P.current(A.now()) & (F.col("domain") == "de")).select("id", "subdomain")


@query("flt_ids", f"SELECT id FROM facts WHERE {CURRENT} AND id IN (SELECT vec_id * 3 FROM embeddings WHERE label = 1)", "facts")
def _(spark, sf):
    ids = A.table(spark, sf, "embeddings").where("label = 1").select((F.col("vec_id") * 3).alias("id"))
    return A.facts(spark, sf).where(P.current(A.now())).join(ids, "id", "left_semi").select("id")


@query("flt_unclaimed", "SELECT id, session_id FROM session_facts WHERE consolidation_id IS NULL", "session_facts")
def _(spark, sf):
    return A.session_facts(spark, sf).where("consolidation_id is null").select("id", "session_id")


@query("flt_claimed", "SELECT id FROM session_facts WHERE consolidation_id = 'run-1'", "session_facts")
def _(spark, sf):
    return A.session_facts(spark, sf).where("consolidation_id = 'run-1'").select("id")


@query("flt_session_facts", "SELECT id, content_hash FROM session_facts WHERE session_id = '7' ORDER BY created_at, id", "session_facts")
def _(spark, sf):
    return A.session_facts(spark, sf).where("session_id = '7'").orderBy("created_at", "id").select("id", "content_hash")


@query("flt_events", "SELECT id, sequence FROM session_events WHERE (mcp_session_id = 'm5' OR client_session_id = '7') AND sequence > 501 ORDER BY sequence LIMIT 50", "session_events")
def _(spark, sf):
    return A.session_events(spark, sf).where("(mcp_session_id = 'm5' or client_session_id = '7') and sequence > 501").orderBy("sequence").limit(50).select("id", "sequence")


@query("flt_eligible", "SELECT id FROM session_events WHERE event_type IN ('message') AND role IN ('user', 'assistant', 'tool') AND length(coalesce(content, '')) >= 10", "session_events")
def _(spark, sf):
    return A.session_events(spark, sf).where(P.eligible()).select("id")


@query("flt_missing_emb", "SELECT f.id FROM facts f WHERE status = 'active' AND is_latest AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = f.id)", "facts")
def _(spark, sf):
    return K.missing_embeddings(A.facts(spark, sf), A.embeddings(spark, sf), "m", 64).select("id")


@query("flt_kw_operator", r"SELECT item_id, array_to_string(list_filter(string_split_regex(replace(text, '\"', ' '), '\s+'), lambda t: t <> ''), '|') AS terms FROM benchmark".replace(r"\"", '"'))
def _(spark, sf):
    terms = F.filter(F.split(F.replace("text", F.lit('"'), F.lit(" ")), "\\s+"), lambda t: t != "")
    return A.table(spark, sf, "benchmark").select("item_id", F.concat_ws("|", terms).alias("terms"))


@query("flt_noise", "SELECT doc_id FROM documents WHERE regexp_matches(text, '<task-notification>|<command-name>|<local-command')")
def _(spark, sf):
    return A.table(spark, sf, "documents").where(X.is_noise(F.col("text"))).select("doc_id")


@query("flt_about_user", r"SELECT id, regexp_matches(content, '(?i)^\s*(the\s+)?user\s+\S') AS about FROM session_events", "session_events")
def _(spark, sf):
    return A.session_events(spark, sf).select("id", X.about_user(F.col("content")).alias("about"))


@query("flt_assent", r"SELECT id, trim(regexp_replace(trim(lower(content)), '[.!]$', '')) IN ('yes', 'yeah', 'yep', 'ok', 'okay', 'correct', 'that''s right', 'that is right') AS assent FROM session_events", "session_events")
def _(spark, sf):
    return A.session_events(spark, sf).select("id", X.is_assent(F.col("content")).alias("assent"))


@query("flt_negation", r"SELECT doc_id, regexp_matches(text, '(?i)\b(not|no longer|don''t|doesn''t|stopped|quit|now prefer|instead)\b') AS negated FROM documents")
def _(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", X.has_negation(F.col("text")).alias("negated"))


@query("flt_since", "SELECT id FROM session_events WHERE coalesce(created_at, TIMESTAMP '9999-01-01') >= TIMESTAMP '2024-01-01 00:30:00'", "session_events")
def _(spark, sf):
    none = F.lit(None).cast("timestamp")
    said = P.said_at(none, none, F.col("created_at"))
    return A.session_events(spark, sf).where(F.coalesce(said >= F.lit("2024-01-01 00:30:00").cast("timestamp"), F.lit(True))).select("id")


@query("flt_fold_pair", r"""SELECT a.id AS a, b.id AS b FROM (SELECT id, canonical_name, trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[\s\-_]+', ' ', 'g'), '[^\p{L}\p{N} ]', ' ', 'g'), ' +', ' ', 'g')) AS f FROM entities) a
    JOIN (SELECT id, canonical_name, trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[\s\-_]+', ' ', 'g'), '[^\p{L}\p{N} ]', ' ', 'g'), ' +', ' ', 'g')) AS f FROM entities) b ON a.f = b.f AND a.id < b.id WHERE a.f <> '' AND a.canonical_name <> b.canonical_name""", "entities")
def _(spark, sf):
    e = A.entities(spark, sf).select("id", "canonical_name", X.fold(F.col("name")).alias("f")).where("f <> ''")
    b = e.select(F.col("id").alias("b"), F.col("canonical_name").alias("cb"), "f")
    return e.withColumnRenamed("id", "a").join(b, "f").where("a < b and canonical_name <> cb").select("a", "b")


@query("fn_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", X.content_hash(F.col("text")).alias("hash"))


@query("fn_norm_dedup", f"SELECT doc_id, sha256({NORM.format('text')}) AS hash FROM documents")
def _(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", F.sha2(X.dedup_key(F.col("text")), 256).alias("hash"))


@query("fn_canonical", "SELECT id, lower(trim(name)) AS canonical FROM entities", "entities")
def _(spark, sf):
    return A.entities(spark, sf).select("id", X.canonical_name(F.col("name")).alias("canonical"))


@query("fn_fold", r"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[\s\-_]+', ' ', 'g'), '[^\p{L}\p{N} ]', ' ', 'g'), ' +', ' ', 'g')) AS fold FROM entities", "entities")
def _(spark, sf):
    return A.entities(spark, sf).select("id", X.fold(F.col("name")).alias("fold"))


_STOP = ", ".join("'" + w + "'" for w in X.STOP_WORDS)


@query("fn_tokens", rf"SELECT item_id, CAST(len(list_distinct(list_filter(string_split_regex(lower(text), '[ \t\n\r\f]+'), lambda w: w <> '' AND NOT list_contains([{_STOP}], w)))) AS BIGINT) AS n FROM benchmark")
def _(spark, sf):
    return A.table(spark, sf, "benchmark").select("item_id", F.size(X.content_tokens(F.col("text"))).cast("long").alias("n"))


@query("fn_jaccard", rf"""WITH t AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[ \t\n\r\f]+'), lambda w: w <> '' AND NOT list_contains([{_STOP}], w))) AS w FROM benchmark)
    SELECT a.item_id AS a, round(len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE), 6) AS similarity FROM t a JOIN t b ON b.item_id = a.item_id + 1""")
def _(spark, sf):
    t = A.table(spark, sf, "benchmark").select("item_id", X.content_tokens(F.col("text")).alias("w"))
    b = t.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"))
    return t.join(b, "item_id").select(F.col("item_id").alias("a"), F.round(X.jaccard(F.col("w"), F.col("v")), 6).alias("similarity"))


@query("fn_cosine", "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 5) AS similarity FROM embeddings")
def _(spark, sf):
    e = A.table(spark, sf, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 5).alias("similarity"))


@query("fn_truncate_vec", "SELECT vec_id, round(list_inner_product(CAST(embedding[1:16] AS DOUBLE[]), CAST(embedding[1:16] AS DOUBLE[])) / greatest(list_inner_product(CAST(embedding[1:16] AS DOUBLE[]), CAST(embedding[1:16] AS DOUBLE[])), 1e-300), 5) AS length FROM embeddings")
def _(spark, sf):
    v = truncated(F.col("embedding"), 16)
    return A.table(spark, sf, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(dot(F.col("v"), F.col("v")), 5).alias("length"))


_DAYS = f"greatest(0.0, (epoch_us({NOW}) - epoch_us(coalesce(valid_from, created_at))) / 86400000000.0)"
_TEMPORAL = f"1 / (1 + {_DAYS} / (30.0 * greatest(importance, 0.1)))"


@query("fn_temporal", f"SELECT id, round({_TEMPORAL}, 6) AS score FROM facts", "facts")
def _(spark, sf):
    return A.facts(spark, sf).select("id", F.round(P.temporal_score(A.now()), 6).alias("score"))


@query("fn_interlocutor", "SELECT id, CASE speaker_role WHEN 'user' THEN 1.5 ELSE 1.0 END AS weight FROM facts", "facts")
def _(spark, sf):
    f = A.facts(spark, sf).withColumn("speaker", F.lit(None).cast("string"))
    return f.select("id", P.interlocutor_prior({"user": 1.5}, {"someone": 2.0}).alias("weight"))


@query("fn_domain_norm", r"SELECT p_partkey, CASE WHEN trim(lower(p_type)) = '' OR p_type IS NULL THEN 'general' ELSE regexp_replace(trim(lower(p_type)), '\s+', '_', 'g') END AS domain FROM part")
def _(spark, sf):
    return A.table(spark, sf, "part").select("p_partkey", X.domain_name(F.col("p_type")).alias("domain"))


@query("fn_classify", "SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'a_hint' WHEN regexp_matches(text, '(?i)(?:than)|(?:thre)') THEN 'timing' WHEN regexp_matches(text, '(?i)[aeiou]{3}') THEN 'reason' WHEN regexp_matches(text, '(?i)zzzz') THEN 'other' ELSE 'general' END AS domain FROM benchmark")
def _(spark, sf):
    hint = F.when(F.col("item_id") % 5 == 0, F.lit(" A hint "))
    return A.table(spark, sf, "benchmark").select("item_id", C.classified(F.col("text"), hint, VOCABULARY).alias("domain"))


@query("fn_resolve_imp", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.25 WHEN doc_id % 3 = 1 THEN 0.75 WHEN doc_id % 2 = 0 THEN 0.9 ELSE 0.5 END AS importance FROM documents")
def _(spark, sf):
    explicit, signal = F.when(F.col("doc_id") % 3 == 0, 0.25), F.when(F.col("doc_id") % 3 == 1, 0.75)
    domain = F.when(F.col("doc_id") % 2 == 0, "timing").otherwise("none")
    return A.table(spark, sf, "documents").select("doc_id", C.importance(explicit, signal, domain, VOCABULARY).alias("importance"))


@query("fn_importance", "SELECT item_id, CASE WHEN regexp_matches(text, '(?i)(?:than)|(?:thre)') THEN 0.9 WHEN regexp_matches(text, '(?i)[aeiou]{3}') THEN 0.7 ELSE 0.5 END AS importance FROM benchmark")
def _(spark, sf):
    none = F.lit(None).cast("double")
    b = A.table(spark, sf, "benchmark").withColumn("domain", C.classified(F.col("text"), F.lit(None).cast("string"), VOCABULARY))
    return b.select("item_id", C.importance(none, none, F.col("domain"), VOCABULARY).alias("importance"))


_SLUG = r"regexp_replace(regexp_replace(lower(regexp_replace({0}, '[\\/]+$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("src_group_enc", rf"SELECT page_id, regexp_replace(regexp_replace(url, '[\\/]+$', ''), '[^a-zA-Z0-9]', '-', 'g') AS plain, {_SLUG.format('url')} AS slug FROM pages")
def _(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", X.group_dir_plain(F.col("url")).alias("plain"), X.group_dir_slug(F.col("url")).alias("slug"))


@query("fn_project_key", rf"SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE {_SLUG.format('url')} END AS key FROM pages")
def _(spark, sf):
    raw = F.when(F.col("page_id") % 4 == 0, F.col("page_id").cast("string")).otherwise(F.col("url"))
    return A.table(spark, sf, "pages").select("page_id", X.project_key(raw).alias("key"))


@query("fn_project_rel", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN a.n_name = b.n_name OR starts_with(a.n_name, b.n_name || '-') OR starts_with(b.n_name, a.n_name || '-') THEN 'same' ELSE 'different' END AS relation FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def _(spark, sf):
    n = A.table(spark, sf, "nation")
    b = n.select(F.col("n_nationkey").alias("b"), "n_regionkey", F.col("n_name").alias("other"))
    return n.join(b, "n_regionkey").select(F.col("n_nationkey").alias("a"), "b", X.project_relation(F.col("n_name"), F.col("other")).alias("relation"))


@query("fn_conv_key", "SELECT id, conversation, kind FROM session_events", "session_events")
def _(spark, sf):
    return L.keyed(A.session_events(spark, sf)).select("id", "conversation", "kind")


@query("fn_role", "SELECT id, CASE WHEN role IN ('user', 'assistant', 'system', 'tool') THEN role END AS role_, nullif(trim(role), '') AS name FROM session_events", "session_events")
def _(spark, sf):
    return A.session_events(spark, sf).select("id", X.speaker_role(F.col("role")).alias("role_"), X.speaker_name(F.col("role")).alias("name"))


@query("fn_clip", r"SELECT item_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) ELSE text END AS clipped, sha256(CASE WHEN length(s) > 240 THEN substr(s, 1, 239) || '…' ELSE s END) AS short FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM benchmark)")
def _(spark, sf):
    return A.table(spark, sf, "benchmark").select("item_id", X.clip(F.col("text"), 100).alias("clipped"), F.sha2(X.clip(X.squeezed(F.col("text")), 240, "…"), 256).alias("short"))


@query("fn_tool_name", """SELECT event_id, nullif(regexp_extract('{"name": "' || event_type || '", "input": ' || props || '}', '"name"\\s*:\\s*"([^"]*)"', 1), '') AS tool FROM events""".replace("\\\\", "\\"))
def _(spark, sf):
    raw = F.concat(F.lit('{"name": "'), F.col("event_type"), F.lit('", "input": '), F.col("props"), F.lit("}"))
    return A.table(spark, sf, "events").select("event_id", X.tool_name(raw).alias("tool"))


@query("src_user_query", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(text) ELSE text END AS spoken FROM conversations")
def _(spark, sf):
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("x <user_query> "), F.col("text"), F.lit(" </user_query> y"))).otherwise(F.col("text"))
    return A.table(spark, sf, "conversations").select("conv_id", "turn", X.spoken_text(raw).alias("spoken"))


@query("src_looks_json", "SELECT event_id, event_id % 2 = 0 AS json FROM events")
def _(spark, sf):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("  "), F.col("props"))).otherwise(F.concat(F.lit("x"), F.col("props")))
    return A.table(spark, sf, "events").select("event_id", X.looks_json(raw).alias("json"))


@query("src_parse_ts", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN date_trunc('second', ts) END AS at FROM events")
def _(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("yesterday")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return A.table(spark, sf, "events").select("event_id", X.iso_timestamp(raw).cast("timestamp_ntz").alias("at"))


@query("fn_iso_guard", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def _(spark, sf):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("2024-13-45"))
    return A.table(spark, sf, "orders").select("o_orderkey", X.iso_timestamp(raw).cast("date").cast("string").alias("day"))


@query("src_record", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'said ' || event_type END AS content FROM events""")
def _(spark, sf):
    payload = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("event_type").alias("prompt")))).otherwise(F.to_json(F.struct(F.concat(F.lit("said "), F.col("event_type")).alias("last_assistant_message"))))
    return A.table(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object(payload, "$.prompt"), F.get_json_object(payload, "$.last_assistant_message")).alias("content"))


@query("fn_disk", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) * 1073741824 AS bytes FROM lineitem")
def _(spark, sf):
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.size_bytes(F.concat(F.col("l_linenumber").cast("string"), F.lit("GB"))).alias("bytes"))


@query("fn_tokens_cnt", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS BIGINT) * 1000000 ELSE -1 END AS tokens FROM lineitem")
def _(spark, sf):
    unit = F.when(F.col("l_linenumber") % 2 == 0, "M").otherwise("MB")
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(X.token_count(F.concat(F.col("l_linenumber").cast("string"), unit)), F.lit(-1)).alias("tokens"))


@query("fn_stage_alias", "SELECT id, CASE WHEN stage = 'stage-O' THEN 'O' ELSE 'F' END AS stage FROM runs", "runs")
def _(spark, sf):
    return A.runs(spark, sf).select("id", X.stage_name(F.col("stage")).alias("stage"))


@query("fn_add_opt", "SELECT provider, stage, CAST(sum(input_tokens) AS BIGINT) AS tokens FROM runs GROUP BY provider, stage", "runs")
def _(spark, sf):
    return A.runs(spark, sf).groupBy("provider", "stage").agg(F.sum("input_tokens").alias("tokens"))


@query("fn_day", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month FROM events")
def _(spark, sf):
    t = F.col("ts").cast("timestamp")
    return A.table(spark, sf, "events").select("event_id", F.to_date(t).cast("string").alias("day"), F.to_date(F.date_trunc("week", t)).cast("string").alias("week"), F.to_date(F.date_trunc("month", t)).cast("string").alias("month"))


@query("fn_eta", "SELECT event_id, CASE WHEN count(value) OVER w >= 3 THEN round(avg(value) OVER w, 5) END AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)")
def _(spark, sf):
    from mnemolake.operators.usage import mean_of_last

    return mean_of_last(A.table(spark, sf, "events"), ["user_id"], "event_id", "value").select("event_id", F.round("mean", 5).alias("mean"))


@query("fn_pack_cost", "SELECT id, CAST(least(length(coalesce(content, '')), 2000) + 64 AS BIGINT) AS cost FROM session_events", "session_events")
def _(spark, sf):
    return A.session_events(spark, sf).select("id", (F.least(F.length(F.coalesce("content", F.lit(""))), F.lit(2000)) + 64).cast("long").alias("cost"))


@query("fn_vocab_merge", "SELECT replace(s.n, ' ', '_') AS name, CASE WHEN s.k < 3 THEN s.n ELSE c.sub END AS subdomain, c.imp AS importance FROM (SELECT lower(r_name) AS n, r_regionkey AS k FROM region) s LEFT JOIN (SELECT lower(r_name) AS n, 'set' AS sub, 0.25 * r_regionkey AS imp FROM region WHERE r_regionkey % 2 = 0) c ON s.n = c.n")
def _(spark, sf):
    r = A.table(spark, sf, "region")
    store = r.select(F.col("r_name").alias("name"), F.when(F.col("r_regionkey") < 3, F.array(F.lower("r_name"))).otherwise(F.array().cast("array<string>")).alias("subdomains"))
    config = r.where("r_regionkey % 2 = 0").select(F.col("r_name").alias("name"), F.array(F.lit("set")).alias("subdomains"), (0.25 * F.col("r_regionkey")).cast("double").alias("importance"))
    got = C.vocabulary_union(store, config)
    return got.select("name", F.get("subdomains", F.lit(0)).alias("subdomain"), "importance")


@query("xs_vocab", "SELECT replace(lower(r_name), ' ', '_') AS name FROM region WHERE lower(r_name) <> 'general'")
def _(spark, sf):
    return A.table(spark, sf, "region").select(X.domain_name(F.col("r_name")).alias("name")).where(F.col("name") != S.FALLBACK_DOMAIN)


@query("xs_fp_parse", "SELECT doc_id, 'p' || doc_id AS prefix, 's' || doc_id AS suffix, n_chars AS size FROM documents")
def _(spark, sf):
    made = F.concat_ws(":", F.concat(F.lit("p"), F.col("doc_id").cast("string")), F.concat(F.lit("s"), F.col("doc_id").cast("string")), F.col("n_chars").cast("string"))
    parts = F.split(made, ":")
    return A.table(spark, sf, "documents").select("doc_id", F.get(parts, F.lit(0)).alias("prefix"), F.get(parts, F.lit(1)).alias("suffix"), F.get(parts, F.lit(2)).cast("long").alias("size"))


@query("xs_path_parts", r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS leaf FROM pages")
def _(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"), F.regexp_extract("url", "([^/?#]*)(?:[?#].*)?$", 1).alias("leaf"))


@query("xs_payload", """SELECT id, role, length(content)::BIGINT AS characters, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS said_at FROM session_events""", "session_events")
def _(spark, sf):
    return A.session_events(spark, sf).select("id", "role", F.length("content").cast("long").alias("characters"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("said_at"))


@query("snk_json", """SELECT r_regionkey, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS json FROM region""")
def _(spark, sf):
    return A.table(spark, sf, "region").select("r_regionkey", F.to_json(F.struct("r_regionkey", "r_name")).alias("json"))
