"""The memory engine's entry points over a store."""

from __future__ import annotations

import json
import time
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake import schemas as S
from mnemolake.functions import predicates as P
from mnemolake.functions.text import content_hash, domain_name
from mnemolake.operators import consolidate as C
from mnemolake.operators import entities as N
from mnemolake.operators import facts as K
from mnemolake.operators import graph as G
from mnemolake.operators import log as L
from mnemolake.operators import search as R
from mnemolake.providers import EmbeddingProvider, Heuristic, embed_missing, query_vector
from mnemolake.scratch import written
from mnemolake.store import Conflict, Store, Version
from mnemolake.streaming.sink import shaped


class Memory:
    """Search, lookups, statistics, capture, consolidation and upkeep. ``now`` is always given."""

    def __init__(self, store: Store, provider: Heuristic | None = None, embedder: EmbeddingProvider | None = None):
        self.store, self.provider, self.embedder = store, provider or Heuristic(), embedder

    def _now(self, now: datetime):
        return F.lit(now).cast("timestamp")

    def search_knowledge(self, query: str, now: datetime, domain: str | None = None, as_of_system_time: str | None = None, limit: int = S.DEFAULT_LIMIT) -> DataFrame:
        """Hybrid search; a domain ranks, it doesn't gate; as-of reads look at system time alone."""
        at = F.lit(P.parse_system_time(as_of_system_time)).cast("timestamp") if as_of_system_time else None
        spark, facts = self.store.spark, self.store.table("facts")
        queries = spark.createDataFrame([("q", query, domain)], "query_id string, query string, domain string")
        vectors = asked = None
        if (v := query_vector(self.embedder, query)) is not None:
            vectors = self.store.table("fact_embeddings")
            asked = spark.createDataFrame([("q", v, self.embedder.model, self.embedder.dimensions)], "query_id string, query_vector array<float>, model string, dimensions int")
        return R.hybrid(facts, queries, self._now(now), limit, at, vectors, asked, self._entity_hits(query))

    def _entity_hits(self, query: str) -> DataFrame:
        """Facts of the families of the entities that the query names."""
        asked = self.store.spark.createDataFrame([("q", query)], "query_id string, query string")
        same = self.store.table("entity_edges").where(F.col("relationship") == S.SAME_AS)
        return R.entity_list(asked, self.store.table("entities"), self.store.table("fact_entities"), same)

    def get_entity(self, name: str, now: datetime) -> DataFrame:
        """Facts of the entity's family, subjects first."""
        asked = self.store.spark.createDataFrame([(name,)], "name string")
        edges = self.store.table("entity_edges").where(F.col("relationship") == S.SAME_AS)
        family = G.same_as_closure(G.resolve_names(asked, self.store.table("entities")).select(F.col("id").alias("seed")), edges)
        links = self.store.table("fact_entities").join(family.select(F.col("member").alias("entity_id")).distinct(), "entity_id", "left_semi")
        own = links.groupBy("fact_id").agg(F.bool_or(F.col("relationship") == S.SUBJECT_OF).alias("is_subject"))
        live = self.store.table("facts").where(P.current(self._now(now)))
        return live.join(own, live["id"] == own["fact_id"]).orderBy(F.desc("is_subject"), F.desc("importance"), F.desc("created_at"), "id")

    def get_context(self, topic: str, now: datetime, limit: int = 10) -> dict[str, DataFrame]:
        """Keyword search (no vectors) and the strongest neighbours of what the topic names."""
        asked = self.store.spark.createDataFrame([(topic,)], "name string")
        centers = G.resolve_names(asked, self.store.table("entities")).select("id")
        queries = self.store.spark.createDataFrame([("q", topic)], "query_id string, query string")
        return {"results": R.hybrid(self.store.table("facts"), queries, self._now(now)), "neighbours": G.neighbours(self.store.table("entity_edges"), centers, limit)}

    def get_schemas(self) -> DataFrame:
        return self.store.table("domains").orderBy("name")

    def get_stats(self, now: datetime) -> DataFrame:
        f = self.store.table("facts")
        return f.agg(F.count("*").alias("facts"), F.count_if(P.current(self._now(now))).alias("current"), F.count_distinct("domain").alias("domains"))

    def get_events(self, session: str, after: int = 0, limit: int = 50) -> DataFrame:
        own = (F.col("mcp_session_id") == session) | (F.col("client_session_id") == session)
        return self.store.table("session_events").where(own & (F.col("sequence") > after)).orderBy("sequence").limit(limit)

    def capture_fact(self, fact_id: str, session: str, content: str, now: datetime, domain_hint: str | None = None, entities: list[dict] | None = None) -> None:
        """Stage one explicit fact, with the entities (name, type, relationship) that it is known to name; the same text in a session is taken once. Nothing that is staged is read or rewritten."""
        row = self.store.spark.createDataFrame([(fact_id, session, content, domain_hint, json.dumps(entities) if entities else None)], "id string, session_id string, content string, domain_hint string, entities_json string")
        held = S.schema("session_facts")
        new = row.withColumns({"content_hash": content_hash(F.col("content")), "source_origin": F.lit("explicit"), "created_at": self._now(now), "domain_hint": F.when(F.col("domain_hint").isNotNull(), domain_name(F.col("domain_hint")))})
        full = new.select(*[(F.col(c) if c in new.columns else F.lit(None)).cast(held[c].dataType).alias(c) for c in held.names])
        self.store.append("session_facts", full)

    def consolidate(self, run_id: str, now: datetime) -> DataFrame:
        """Integrate what is staged; returns the run's counts. All tables change in one commit, under the lease.

        Facts, claims on staged facts, decisions, the run's record, its uses and the vectors of new facts are written.
        """
        store = self.store
        if not store.take(run_id, time.time()):
            raise Conflict("another run holds the lease")
        try:
            with store.beating(run_id):
                return self._consolidate(run_id, now)
        finally:
            store.release(run_id)

    def _consolidate(self, run_id: str, now: datetime) -> DataFrame:
        # The version before the first read: what is captured after it stays staged.
        store, base = self.store, self.store.head()
        staged, facts = store.table("session_facts", base), store.table("facts", base)
        projects = store.table("sessions", base).select(F.col("id").alias("session_id"), "project")
        open_ = staged.where("consolidation_id is null").join(projects, "session_id", "left")
        out = C.consolidate(open_, facts.join(projects, "session_id", "left"), self._now(now), self.provider.vocabulary, run_id)
        counts = store.spark.createDataFrame(out["counts"].collect(), out["counts"].schema)
        known = facts.select("id")
        integrated = out["facts"].select(*facts.columns).join(known.select("id", F.lit(True).alias("_known")), "id", "left")
        integrated = written(integrated.withColumn("source_id", F.when(F.col("_known"), F.col("source_id")).otherwise(F.concat(F.lit("src:"), "id"))).select(*facts.columns), "integrated")
        new = integrated.join(known, "id", "left_anti")
        tables = {"facts": integrated, "session_facts": staged.withColumn("consolidation_id", F.coalesce("consolidation_id", F.lit(run_id))).select(*staged.columns)}
        relations = out["relations"].withColumnRenamed("verdict", "context_verdict").withColumns({"id": F.concat_ws(":", "consolidation_id", "kind", "fact_id", "related_fact_id"), "created_at": self._now(now), "session_fact_id": F.when(F.col("kind") == "corroborated_by", F.col("related_fact_id"))})
        record = counts.withColumns({"id": F.lit(run_id), "created_at": self._now(now)})
        run = store.spark.createDataFrame([(run_id, json.dumps(self.provider.usage))], "consolidation_id string, usage string").withColumns({"id": F.concat(F.lit("run:"), "consolidation_id"), "kind": F.lit("consolidate"), "created_at": self._now(now)})
        sources = new.select(F.col("source_id").alias("id"), F.lit("session_fact").alias("type"), F.col("source_tool").alias("tool_id"), F.col("created_at").alias("timestamp"), F.col("content").alias("raw_content"), F.to_json(F.struct(F.col("id").alias("session_fact_id"))).alias("metadata"))
        domains = new.select(F.col("domain").alias("name")).distinct().join(store.table("domains", base).select("name"), "name", "left_anti").withColumn("created_at", self._now(now))
        tables["entity_edges"], added = self._graph(new, open_, now, base)
        added |= {"fact_relations": relations, "consolidations": record, "intelligence_runs": run, "sources": sources, "domains": domains}
        store.commit(tables, holder=run_id, base=base, adds={name: shaped(rows, name) for name, rows in added.items()})
        self.embed(now)
        return counts

    def _graph(self, new: DataFrame, staged: DataFrame, now: datetime, base: Version) -> tuple[DataFrame, dict[str, DataFrame]]:
        """What integrated facts add to the graph: all edges, and new entities and links."""
        store, at = self.store, self._now(now)
        held = store.table("entities", base)
        rows = staged.select("id", "content", "entities_json", "created_at").join(new.select("id"), "id", "left_semi")
        named = C.entities_of(rows, self.provider.entities).join(rows.select(F.col("id").alias("fact_id"), "created_at"), "fact_id")
        kind, role = F.coalesce("type", F.lit("thing")), F.coalesce("relationship", F.lit("mentions"))
        mentions = written(named.select("fact_id", "name", kind.alias("type"), role.alias("relationship"), F.struct("created_at", "fact_id", "name").alias("position")).withColumn("mention_id", F.sha2(F.concat_ws("\u0001", "fact_id", "name", "type", "relationship"), 256)).dropDuplicates(["mention_id"]), "mentions")
        assigned, created = N.find_or_create(mentions, held)
        links = assigned.join(mentions.select("mention_id", "fact_id", "relationship"), "mention_id").select("fact_id", "entity_id", "relationship")
        links = written(links.union(N.uttered(new, held).select("fact_id", "entity_id", "relationship")).distinct(), "links")
        seen = G.co_occurrences(links).select(F.col("a").alias("from_entity"), F.col("b").alias("to_entity"), F.lit(S.CO_MENTIONED).alias("relationship"), "n")
        edges, keys = store.table("entity_edges", base), ["from_entity", "to_entity", "relationship"]
        after = G.upsert_edges(edges, seen).join(edges.select(*keys, "metadata", "created_at", "last_accessed_at"), keys, "left")
        fresh = created.withColumns({"created_at": at, "access_count": F.lit(0), "is_self": F.lit(False)})
        return after.withColumn("created_at", F.coalesce("created_at", at)).select(*edges.columns), {"entities": fresh, "fact_entities": links}

    def embed(self, now: datetime, batch: int = 10_000) -> int:
        """Vectors for the facts that lack one, ``batch`` of them a commit; returns how many commits. A provider that fails leaves the rest for
        the next call, and what was committed stays."""
        done = 0
        while self.embedder is not None:
            vectors = self.store.table("fact_embeddings")
            todo = K.missing_embeddings(self.store.table("facts"), vectors, self.embedder.model, self.embedder.dimensions).orderBy("created_at", "id").limit(batch)
            try:
                made = written(embed_missing(todo, self.embedder).withColumn("created_at", self._now(now)), "vectors")
            except Exception:
                return done
            if made.isEmpty():
                return done
            self.store.append("fact_embeddings", shaped(made, "fact_embeddings"))
            done += 1
        return done

    def prune(self, spare: int = 20, apply: bool = False) -> int:
        """How many events nothing reaches; with ``apply`` they go."""
        base = self.store.head()
        events = L.keyed(self.store.table("session_events", base))
        marks, sources = self.store.table("extract_watermarks", base), self.store.table("session_fact_sources", base)
        n = L.prunable(events, marks, sources, spare).count()
        if apply and n:
            self.store.commit({"session_events": L.pruned(events, marks, sources, spare).select(*self.store.table("session_events", base).columns)}, base=base)
        return n
