"""Tables of the memory store, their schemas, and reserved values."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec) if hasattr(T, "_parse_datatype_string") else T.StructType.fromDDL(spec)


#: Column lists in DDL, by table. Instants are UTC.
TABLES: dict[str, str] = {
    "sessions": "id string, source_tool string, project string, started_at timestamp, last_activity_at timestamp",
    "session_events": "id string, mcp_session_id string, client_session_id string, sequence long, event_type string, role string, content_type string, content string, content_ref string, metadata string, created_at timestamp, occurred_at timestamp, speaker string",
    "session_facts": "id string, session_id string, content string, content_hash string, source_origin string, source_event_id string, domain_hint string, subdomain_hint string, confidence double, importance double, confidence_signal double, importance_signal double, valid_from_hint timestamp, valid_until_hint timestamp, entities_json string, source_quality string, source_tool string, capture_context string, consolidation_id string, created_at timestamp, speaker_role string, speaker string",
    "session_fact_sources": "session_fact_id string, event_id string, relevance double, extraction_type string",
    "domains": "name string, subdomains array<string>, created_at timestamp",
    "facts": "id string, content string, domain string, subdomain string, confidence double, importance double, source_type string, source_tool string, source_id string, status string, superseded_by string, is_latest boolean, created_at timestamp, valid_from timestamp, valid_until timestamp, system_retired_at timestamp, session_id string, capture_context string, access_count long, source_quality string, speaker_role string, speaker string",
    "entities": "id string, type string, name string, canonical_name string, metadata string, created_at timestamp, access_count long, last_accessed_at timestamp, is_self boolean",
    "fact_entities": "fact_id string, entity_id string, relationship string",
    "entity_edges": "from_entity string, to_entity string, relationship string, strength double, metadata string, created_at timestamp, last_accessed_at timestamp",
    "sources": "id string, type string, tool_id string, timestamp timestamp, raw_content string, metadata string",
    "consolidations": "id string, session_id string, facts_in long, facts_integrated long, facts_rejected long, summary string, created_at timestamp, last_event_sequence long, now string, now_referents string, segments string",
    "fact_embeddings": "fact_id string, model string, dimensions int, vector array<float>, created_at timestamp",
    "source_watermarks": "path string, byte_offset long, line_number long, fingerprint string, updated_at timestamp",
    "extract_watermarks": "kind string, conversation_id string, last_event_sequence long, updated_at timestamp",
    "inferences": "id string, hypothesis string, status string, reason string, fact_id string, metadata string, created_at timestamp, validated_at timestamp",
    "inference_evidence": "inference_id string, fact_id string",
    "intelligence_runs": "id string, kind string, consolidation_id string, created_at timestamp, usage string, trigger string, source_tool string, project string",
    "fts_postings": "token string, id string, length int, places array<int>, added long, bucket int",
    "fts_lengths": "id string, length int, added long",
    "fts_removed": "id string, removed long",
    "fts_stats": "documents long, words long",
    "fact_relations": "id string, consolidation_id string, fact_id string, related_fact_id string, session_fact_id string, kind string, context_verdict string, fact_project string, candidate_project string, basis string, reason string, decided_by string, created_at timestamp",
}


#: Unique keys of tables that are appended to, and which row counts: the first by these columns (``-``: descending).
UNIQUE: dict[str, tuple[list[str], list[str]]] = {
    "session_facts": (["session_id", "content_hash"], ["created_at", "id"]),
    "sessions": (["id"], ["started_at"]),
    "source_watermarks": (["path"], ["-updated_at", "-byte_offset"]),
    "extract_watermarks": (["kind", "conversation_id"], ["-last_event_sequence"]),
    "domains": (["name"], ["created_at"]),
    "entities": (["id"], ["created_at"]),
    "fact_entities": (["fact_id", "entity_id", "relationship"], ["fact_id"]),
    "fact_embeddings": (["fact_id", "model", "dimensions"], ["-created_at"]),
}

#: Tables in folders by a column.
FOLDERS: dict[str, str] = {"fts_postings": "bucket"}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


# Fixed values of the data model.
SUBJECT_OF, SAME_AS, UTTERED_BY, CO_MENTIONED = "subject_of", "same_as", "uttered_by", "co_mentioned"
FALLBACK_DOMAIN = "general"
FAMILY_CAP = 32
EDGE_STEP = 0.3
RRF_K = 60
DECAY_DAYS, DECAY_FLOOR, DECAY_WEIGHT = 30.0, 0.1, 0.3
DEFAULT_LIMIT, LEAST_POOL = 20, 50
SIMILARITY_RATIO = 0.85
ANN_BYTES = 32 << 20
EPISODE_RADIUS, EPISODE_SLICES, EPISODE_HITS, EPISODE_EVENTS, EPISODE_CLIP = 2, 3, 8, 8, 500
SUPERSESSION_FLOOR = 0.3
DEFAULT_CONFIDENCE, DEFAULT_IMPORTANCE, ENRICH_STEP = 0.7, 0.5, 0.1
EXTRACT_CAP = 50
EXTRACT_TYPES, EXTRACT_ROLES, EXTRACT_LEAST = ("message",), ("user", "assistant", "tool"), 10
BM25_K1, BM25_B, BM25_LEAST_IDF = 1.2, 0.75, 1e-6
