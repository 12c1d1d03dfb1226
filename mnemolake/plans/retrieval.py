"""Queries of search and ranking."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mnemolake.functions import predicates as P
from mnemolake.operators import graph as G
from mnemolake.operators import log as L
from mnemolake.operators import search as R
from mnemolake.plans import adapters as A
from mnemolake.plans.catalog import query
from mnemolake.plans.scalar import _TEMPORAL, CURRENT

ASKED = [("a", "than", "en"), ("b", "THER thre", "de"), ("c", "zqzq", None), ("d", "of-the", "fr"), ("e", "than SRC3", None)]
#: Vectors that stand for the queries' own.
VECTORS = {"a": 7, "b": 12, "d": 23, "e": 31}
_ACCENTS = "translate(lower({0}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
_TOKENS = "list_filter(string_split_regex(" + _ACCENTS + r", '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def queries(spark):
    return spark.createDataFrame(ASKED, "query_id string, query string, domain string")


#: BM25 of the asked phrases: a is one token, b two, d a phrase of two.
_BM25 = f"""idx AS (SELECT @id@ AS id, {_TOKENS.format('content')} AS c, @rest@ AS r FROM @corpus@), len_ AS (SELECT id, c, r, len(c) + len(r) AS n, ' ' || array_to_string(c, ' ') || ' | ' || array_to_string(r, ' | ') || ' ' AS line FROM idx),
    st AS (SELECT CAST(count(*) AS DOUBLE) AS rows_, avg(n) AS mean FROM len_), ph AS (SELECT * FROM (VALUES ('a', 'than'), ('b', 'ther'), ('b', 'thre'), ('c', 'zqzq'), ('d', 'of the'), ('e', 'than'), ('e', 'src3')) v(query_id, phrase)),
    f AS (SELECT ph.query_id, ph.phrase, l.id, l.n, (length(replace(l.line, ' ', '  ')) - length(replace(replace(l.line, ' ', '  '), ' ' || replace(ph.phrase, ' ', '  ') || ' ', ''))) / (length(replace(ph.phrase, ' ', '  ')) + 2) AS f FROM ph, len_ l),
    hit AS (SELECT * FROM f WHERE f > 0), df AS (SELECT phrase, count(DISTINCT id) AS n FROM hit GROUP BY phrase), w AS (SELECT phrase, CASE WHEN ln((rows_ - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((rows_ - n + 0.5) / (n + 0.5)) END AS idf, mean FROM df, st),
    bm AS (SELECT h.query_id, h.id, sum(w.idf * h.f * 2.2 / (h.f + 1.2 * (0.25 + 0.75 * h.n / w.mean))) AS score FROM hit h JOIN w ON w.phrase = h.phrase GROUP BY h.query_id, h.id HAVING count(*) = (SELECT count(*) FROM ph WHERE ph.query_id = h.query_id))"""
_FACTS_BM = _BM25.replace("@id@", "id").replace("@rest@", f"list_concat({_TOKENS.format('domain')}, {_TOKENS.format('subdomain')})").replace("@corpus@", "facts")
_EVENTS_BM = _BM25.replace("@id@", "id").replace("@rest@", "[]::VARCHAR[]").replace("@corpus@", "session_events")
_PENDING_BM = _BM25.replace("@id@", "id").replace("@rest@", "[]::VARCHAR[]").replace("@corpus@", "pending")
_KW = f"kw AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank0 FROM bm WHERE id IN (SELECT id FROM facts WHERE {CURRENT}) QUALIFY rank0 < 100)"
_DOM = f"dom AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, id) - 1 AS rank0 FROM (VALUES ('a', 'en'), ('b', 'de'), ('d', 'fr')) q(query_id, dm) JOIN facts ON facts.domain = dm WHERE {CURRENT} QUALIFY rank0 < 100)"
_RRF = "u AS (SELECT query_id, id, rank0 FROM kw UNION ALL SELECT query_id, id, rank0 FROM dom), rrf AS (SELECT query_id, id, sum(1 / (60.0 + rank0)) AS rrf, count(*) AS lists FROM u GROUP BY query_id, id)"


@query("se_bm25", f", {_FACTS_BM}, {_KW} SELECT query_id, id, round(score, 5) AS score FROM kw".lstrip(), "facts")
def _(spark, sf):
    got = R.keyword_list(A.facts(spark, sf), queries(spark), A.now(), 100, index=A.text_index(spark, sf))
    return got.select("query_id", "id", F.round("score", 5).alias("score"))


@query("jn_fts", f", {_FACTS_BM} SELECT query_id, bm.id, facts.domain FROM bm JOIN facts ON facts.id = bm.id".lstrip(), "facts")
def _(spark, sf):
    """An index that was filled in two steps, lost a third of the facts and got them again."""
    from mnemolake.operators.textindex import TextIndex
    from mnemolake.scratch import folder
    from mnemolake.store import Store

    f, columns, third = A.fact_texts(spark, sf), ["content", "domain", "subdomain"], F.col("id") % 3 == 1
    index = TextIndex(Store(spark, f"{folder(spark)}/jn-fts-{uuid.uuid4().hex}"))
    for part in (F.col("id") % 2 == 0, F.col("id") % 2 == 1):
        index.add(f.where(part), "id", columns)
    index.remove(f.where(third), "id")
    index.add(f.where(third), "id", columns)
    hits = index.search(queries(spark)).select("query_id", F.col("id").cast("long").alias("id"))
    return hits.join(f.select("id", "domain"), "id").select("query_id", "id", "domain")


@query("tk_hits", f", {_FACTS_BM} SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM bm) WHERE n <= 8".lstrip(), "facts")
def _(spark, sf):
    got = A.text_index(spark, sf).search(queries(spark)).withColumn("id", F.col("id").cast("long"))
    return R.ranked(got, [F.desc("score"), F.col("id")], 8).select("query_id", "id")


@query("se_pending", f", pending AS (SELECT id, content FROM session_facts WHERE consolidation_id IS NULL), {_PENDING_BM} SELECT query_id, id, round(score, 5) AS score FROM bm".lstrip(), "session_facts")
def _(spark, sf):
    pending = A.session_facts(spark, sf).where("consolidation_id is null")
    return R.bm25(R.indexed(pending, "id", ["content"]), queries(spark)).withColumn("score", F.round("score", 5))


_EP = f""", {_EVENTS_BM}, h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank0 FROM bm QUALIFY rank0 < 8), p AS (SELECT h.*, e.conversation, e.sequence FROM h JOIN session_events e ON e.id = h.id),
    g AS (SELECT query_id, conversation, min(rank0) AS first, greatest(1, min(sequence) - 2) AS low, max(sequence) + 2 AS high FROM p GROUP BY 1, 2), s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS slice FROM g QUALIFY slice <= 3),
    x AS (SELECT s.query_id, s.slice, e.*, row_number() OVER (PARTITION BY s.query_id, s.conversation ORDER BY e.sequence) AS place FROM s JOIN session_events e ON e.conversation = s.conversation AND e.sequence BETWEEN s.low AND s.high QUALIFY place <= 8)
    SELECT x.query_id, x.slice, x.id, x.id IN (SELECT id FROM h WHERE h.query_id = x.query_id) AS matched FROM x"""


@query("se_episodes", _EP.lstrip(), "session_events")
def _(spark, sf):
    return R.episodes(L.keyed(A.session_events(spark, sf)), queries(spark)).select("query_id", "slice", "id", "matched")


@query("ss_episode", "SELECT h.id AS hit, e.id FROM session_events h JOIN session_events e ON e.conversation = h.conversation AND e.sequence BETWEEN greatest(1, h.sequence - 2) AND h.sequence + 2 WHERE h.role = 'system'", "session_events")
def _(spark, sf):
    e = L.keyed(A.session_events(spark, sf))
    h = e.where("role = 'system'").select("conversation", F.col("id").alias("hit"), F.col("sequence").alias("at"))
    return e.join(h, "conversation").where(F.col("sequence").between(F.greatest(F.lit(1), F.col("at") - 2), F.col("at") + 2)).select("hit", "id")


@query("se_domain", f", {_DOM} SELECT query_id, id, rank0 FROM dom".lstrip(), "facts")
def _(spark, sf):
    return R.domain_list(A.facts(spark, sf), queries(spark), A.now(), 100)


@query("wn_rrf_rank", f", {_FACTS_BM}, {_KW} SELECT query_id, id, rank0 FROM kw".lstrip(), "facts")
def _(spark, sf):
    return R.keyword_list(A.facts(spark, sf), queries(spark), A.now(), 100, index=A.text_index(spark, sf)).select("query_id", "id", "rank0")


@query("st_union_lists", f", {_FACTS_BM}, {_KW}, {_DOM} SELECT 'keyword' AS list, query_id, id FROM kw UNION ALL SELECT 'domain', query_id, id FROM dom".lstrip(), "facts")
def _(spark, sf):
    f, q = A.facts(spark, sf), queries(spark)
    kw = R.keyword_list(f, q, A.now(), 100, index=A.text_index(spark, sf)).select(F.lit("keyword").alias("list"), "query_id", "id")
    return kw.unionByName(R.domain_list(f, q, A.now(), 100).select(F.lit("domain").alias("list"), "query_id", "id"))


@query("se_rrf", f", {_FACTS_BM}, {_KW}, {_DOM}, {_RRF} SELECT query_id, id, round(rrf, 8) AS rrf, lists FROM rrf".lstrip(), "facts")
def _(spark, sf):
    f, q = A.facts(spark, sf), queries(spark)
    return R.rrf([R.keyword_list(f, q, A.now(), 100, index=A.text_index(spark, sf)), R.domain_list(f, q, A.now(), 100)]).withColumn("rrf", F.round("rrf", 8))


#: The other two lists: facts of the sources that a query names, with the sources that are the same; vectors near the query's.
_ENT = f"""fam AS (SELECT DISTINCT source AS name, regexp_replace(source, '^src1([0-9])$', 'src\\1') AS head FROM documents),
    tq(query_id, name, position) AS (VALUES ('a', 'than', 0), ('b', 'ther', 0), ('b', 'thre', 1), ('c', 'zqzq', 0), ('d', 'of-the', 0), ('e', 'than', 0), ('e', 'src3', 1)),
    eh AS (SELECT tq.query_id, f.id, min(position) AS position FROM tq JOIN fam x ON x.name = tq.name JOIN fam y ON y.head = x.head JOIN facts f ON f.subdomain = y.name WHERE {CURRENT} GROUP BY ALL),
    ent AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY position, id) - 1 AS rank0 FROM eh QUALIFY rank0 < 100)"""
_VL = f"""vq AS (SELECT * FROM (VALUES {", ".join(f"('{q}', {v})" for q, v in VECTORS.items())}) v(query_id, vec)),
    vs AS (SELECT vq.query_id, e.vec_id AS id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity FROM vq JOIN embeddings q ON q.vec_id = vq.vec, embeddings e),
    vb AS (SELECT query_id, max(similarity) AS best FROM vs GROUP BY query_id),
    vr AS (SELECT vs.query_id, vs.id, row_number() OVER (PARTITION BY vs.query_id ORDER BY similarity DESC, vs.id) - 1 AS rank0 FROM vs JOIN vb ON vb.query_id = vs.query_id AND best > 0 AND similarity >= 0.1 AND similarity >= best * 0.85 QUALIFY rank0 < 100),
    vec AS (SELECT * FROM vr WHERE id IN (SELECT id FROM facts WHERE {CURRENT}))"""
_FOUR = "u AS (SELECT query_id, id, rank0 FROM kw UNION ALL SELECT query_id, id, rank0 FROM dom UNION ALL SELECT query_id, id, rank0 FROM ent UNION ALL SELECT query_id, id, rank0 FROM vec), rrf AS (SELECT query_id, id, sum(1 / (60.0 + rank0)) AS rrf, count(*) AS lists FROM u GROUP BY query_id, id)"
_HYBRID = f", {_FACTS_BM}, {_KW}, {_DOM}, {_ENT}, {_VL}, {_FOUR}, hy AS (SELECT query_id, facts.id, rrf * (1 + 0.3 * {_TEMPORAL}) AS score FROM rrf JOIN facts ON facts.id = rrf.id), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank0 FROM hy QUALIFY rank0 < 20)"


def _hybrid(spark, sf):
    """All four lists: keywords by the index, domain, entities, vectors."""
    q, e = queries(spark), A.embeddings(spark, sf)
    named = spark.createDataFrame(list(VECTORS.items()), "query_id string, fact_id long")
    vectors = e.join(F.broadcast(named), "fact_id").select("query_id", F.col("vector").alias("query_vector"), "model", "dimensions")
    hits = R.entity_list(q, A.source_entities(spark, sf), A.source_links(spark, sf), A.source_same(spark, sf))
    return R.hybrid(A.facts(spark, sf), q, A.now(), vectors=e, query_vectors=vectors, entity_hits=hits, floor=0.1, index=A.text_index(spark, sf))


@query("se_hybrid", f"{_HYBRID} SELECT query_id, id, rank0, round(score, 4) AS score FROM top".lstrip(), "facts")
def _(spark, sf):
    return _hybrid(spark, sf).select("query_id", "id", "rank0", F.round("score", 4).alias("score"))


@query("fn_quality", f"{_HYBRID}, q AS (SELECT query_id, count(*) AS n, max(CASE WHEN rank0 = 0 THEN score END) AS s0, max(CASE WHEN rank0 = 1 THEN score END) AS s1 FROM top GROUP BY query_id), r AS (SELECT query_id, CASE WHEN n >= 20 THEN 0.5 ELSE 0.7 END AS coverage_estimate, CASE WHEN n = 1 THEN 0.7 WHEN (s0 - s1) / s0 > 0.5 THEN 0.9 WHEN (s0 - s1) / s0 > 0.2 THEN 0.7 ELSE 0.5 END AS result_confidence FROM q) SELECT *, result_confidence <= 0.5 AS refine FROM r".lstrip(), "facts")
def _(spark, sf):
    return R.quality(_hybrid(spark, sf), 20)


_VEC = f"v AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, e.vec_id AS id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q), b AS (SELECT query_id, max(similarity) AS best FROM v GROUP BY query_id), n AS (SELECT v.*, row_number() OVER (PARTITION BY v.query_id ORDER BY similarity DESC, id) - 1 AS rank0 FROM v JOIN b ON b.query_id = v.query_id AND best > 0 AND similarity >= 0.1 AND similarity >= best * 0.5 QUALIFY rank0 < 20)"


def _vector_queries(spark, sf):
    e = A.embeddings(spark, sf).where("fact_id % 20 = 0")
    return e.select(F.col("fact_id").cast("string").alias("query_id"), F.col("vector").alias("query_vector"), "model", "dimensions")


@query("se_vector", f", {_VEC} SELECT query_id, id, round(similarity, 4) AS similarity FROM n WHERE id IN (SELECT id FROM facts WHERE {CURRENT})".lstrip(), "facts")
def _(spark, sf):
    live = A.facts(spark, sf).where(P.current(A.now()))
    return R.vector_list(A.embeddings(spark, sf), _vector_queries(spark, sf), live, 20, 0.1, 0.5).select("query_id", "id", F.round("similarity", 4).alias("similarity"))


@query("se_hnsw")
def _(spark, sf):
    from mnemolake.operators import neighbourgraph as N

    return N.search(N.build(A.embeddings(spark, sf)), _vector_queries(spark, sf), 10).select("query_id", "id", F.round("similarity", 4).alias("similarity"))


@query("se_hnsw_recall", "SELECT count(*) AS queries, TRUE AS enough FROM embeddings WHERE vec_id % 20 = 0")
def _(spark, sf):
    """Whether the graph finds at least nine tenths of the ten nearest vectors of all queries."""
    from mnemolake.operators import neighbourgraph as N

    vectors, asked = A.embeddings(spark, sf), _vector_queries(spark, sf)
    exact = R.ranked(R.nearest(vectors, asked, -1.0, 10), [F.desc("similarity"), F.col("id")], 10)
    return N.recall(N.search(N.build(vectors), asked, 10), exact).select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query("se_ann_gate", f", {_VEC} SELECT query_id, count(*) AS n FROM n WHERE id IN (SELECT id FROM facts WHERE {CURRENT}) GROUP BY query_id".lstrip(), "facts")
def _(spark, sf):
    """The gate's choice for so many vectors of so many bytes: exact search below the limit, the graph above."""
    live = A.facts(spark, sf).where(P.current(A.now()))
    return R.vector_recall(A.embeddings(spark, sf), _vector_queries(spark, sf), live, 20, 0.1, 0.5).groupBy("query_id").agg(F.count("*").alias("n"))


def _(spark, sf):
    return A.entities(spark, sf).where("canonical_name = 'nation_7' or canonical_name = lower(trim(' CUSTOMER#000000007 '))").orderBy("born").select("id")


@query("se_family", r"""WITH asked AS (SELECT name, lower(trim(name)) AS canon, trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[\s\-_]+', ' ', 'g'), '[^\p{L}\p{N} ]', ' ', 'g'), ' +', ' ', 'g')) AS fold FROM (SELECT DISTINCT replace(p_name, ' ', '-') AS name FROM part UNION SELECT p_name FROM part)),
    e AS (SELECT 'part:' || p_partkey AS id, lower(trim(p_name)) AS canon, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[\s\-_]+', ' ', 'g'), '[^\p{L}\p{N} ]', ' ', 'g'), ' +', ' ', 'g')) AS fold FROM part),
    x AS (SELECT a.name, e.id FROM asked a JOIN e ON e.canon = a.canon), clear AS (SELECT fold FROM e WHERE fold <> '' GROUP BY fold HAVING count(DISTINCT canon) = 1)
    SELECT name, id FROM x UNION ALL SELECT a.name, e.id FROM asked a JOIN e ON e.fold = a.fold JOIN clear ON clear.fold = a.fold WHERE a.name NOT IN (SELECT name FROM x)""")
def _(spark, sf):
    p = A.table(spark, sf, "part")
    names = p.select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("name")).union(p.select("p_name")).distinct()
    return G.resolve_names(names, A.entities(spark, sf).where("type = 'part'"))


_SAME = "same AS (SELECT 'part:' || p_partkey AS a, 'part:' || (p_partkey + 1) AS b FROM part WHERE p_partkey % 5 IN (1, 2))"


@query("se_closure", f"WITH RECURSIVE {_SAME}, both_ AS (SELECT a, b FROM same UNION SELECT b, a FROM same), c(seed, member) AS (SELECT 'part:' || p_partkey, 'part:' || p_partkey FROM part UNION SELECT c.seed, both_.b FROM c JOIN both_ ON both_.a = c.member) SELECT seed, member FROM c")
def _(spark, sf):
    part = A.table(spark, sf, "part")
    name = lambda c: F.concat(F.lit("part:"), c.cast("string"))
    same = part.where("p_partkey % 5 in (1, 2)").select(name(F.col("p_partkey")).alias("from_entity"), name(F.col("p_partkey") + 1).alias("to_entity"))
    return G.same_as_closure(part.select(name(F.col("p_partkey")).alias("seed")), same)


def _(spark, sf):
    three = A.table(spark, sf, "supplier").where("s_suppkey = 3").select(F.lit("q").alias("query_id"), F.col("s_name").alias("name"), F.lit(1).alias("position"))
    terms = three.union(spark.createDataFrame([("q", "NATION_7", 0)], three.schema))
    found = G.resolve_names(terms.select("name"), A.entities(spark, sf)).join(terms, "name")
    links = A.fact_entities(spark, sf).select(F.col("entity_id").alias("_e"), F.col("fact_id"))
    return found.join(links, F.col("id") == F.col("_e")).groupBy("query_id", F.col("fact_id").alias("id")).agg(F.min("position").alias("position"))


def _(spark, sf):
    return A.fact_entities(spark, sf).where(F.col("entity_id").isin("part:7", "customer:7")).groupBy("fact_id").agg(F.bool_or(F.col("relationship") == "subject_of").alias("is_subject"))


@query("se_related")
def _(spark, sf):
    e = A.session_events(spark, sf).where("client_session_id = '7'")
    return R.related(e, A.facts(spark, sf), A.now()).select("id", F.round("score", 5).alias("score"))


@query("se_attach", f"{_HYBRID} SELECT t.query_id, t.id, coalesce(l.quality, -1) AS quality FROM top t LEFT JOIN labels l ON l.doc_id = t.id".lstrip(), "facts")
def _(spark, sf):
    labels = A.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    return _hybrid(spark, sf).select("query_id", "id").join(labels, "id", "left").withColumn("quality", F.coalesce("quality", F.lit(-1)))


@query("se_asof", f", {_FACTS_BM} SELECT query_id, bm.id, round(score, 5) AS score FROM bm JOIN facts f ON f.id = bm.id WHERE f.created_at <= TIMESTAMP '2024-01-01 08:00:00' AND (f.system_retired_at IS NULL OR f.system_retired_at > TIMESTAMP '2024-01-01 08:00:00')".lstrip(), "facts")
def _(spark, sf):
    at = F.lit("2024-01-01 08:00:00").cast("timestamp")
    return R.keyword_list(A.facts(spark, sf), queries(spark), A.now(), 1 << 40, at).select("query_id", "id", F.round("score", 5).alias("score"))
