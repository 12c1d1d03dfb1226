"""Where models plug in: protocols, the deterministic heuristic, and a hashing embedder for tests."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame

from mnemolake.operators import consolidate as C


class IntelligenceProvider(Protocol):
    """Stages of consolidation as functions of frames."""

    def classify(self, content: Column, hint: Column) -> Column: ...
    def extract(self, events: DataFrame) -> DataFrame: ...
    def entities(self, facts: DataFrame) -> DataFrame: ...
    def reconcile(self, staged: DataFrame, facts: DataFrame, now: Column) -> DataFrame: ...
    def supersede(self, new: DataFrame, facts: DataFrame, now: Column) -> DataFrame: ...
    def summarise(self, counts: Sequence[tuple[str, int]], previews: Sequence[str], prior: str) -> str: ...


class EmbeddingProvider(Protocol):
    model: str
    dimensions: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Heuristic:
    """Rules only: nothing is extracted, the rest is column expressions. ``usage`` is what a run has spent, here nothing."""

    usage = {"input_tokens": 0, "output_tokens": 0}

    def __init__(self, vocabulary: Sequence[C.Domain] = ()):
        self.vocabulary = C.compiled(list(vocabulary))

    def classify(self, content: Column, hint: Column) -> Column:
        return C.classified(content, hint, self.vocabulary)

    def extract(self, events: DataFrame) -> DataFrame:
        return events.sparkSession.createDataFrame([], "session_id string, content string, event_id string")

    def entities(self, facts: DataFrame) -> DataFrame:
        """No rule names entities; what extractions have stated is used."""
        return facts.sparkSession.createDataFrame([], "fact_id string, name string, type string, relationship string")

    def reconcile(self, staged: DataFrame, facts: DataFrame, now: Column) -> DataFrame:
        return C.reconciled(staged, facts, now)

    def supersede(self, new: DataFrame, facts: DataFrame, now: Column) -> DataFrame:
        return C.supersessions(new, facts, now)

    def summarise(self, counts: Sequence[tuple[str, int]], previews: Sequence[str], prior: str = "") -> str:
        """Counts by domain in the order first seen and up to three previews of 60 characters, after ``prior``."""
        if not counts:
            return prior
        said = "Integrated " + ", ".join(f"{n} {d}" for d, n in counts) + "."
        short = "; ".join(p[:60] for p in previews[:3])
        return "\n".join(x for x in (prior, said + (f" {short}" if short else "")) if x)


class HashingEmbedder:
    """Token hashes as a unit vector: the same text always has the same vector."""

    def __init__(self, dimensions: int = 64):
        self.model, self.dimensions = "hashing", dimensions

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for token in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            length = math.sqrt(sum(x * x for x in v))
            out.append([x / length for x in v] if length else v)
        return out


def embed_missing(facts: DataFrame, provider: EmbeddingProvider, batch: int = 128) -> DataFrame:
    """Vectors (fact_id, model, dimensions, vector) for ``facts`` (id, content), in batches on the executors."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            vectors = [v for i in range(0, len(texts), batch) for v in provider.embed(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.string()), pa.array([provider.model] * len(texts)), pa.array([provider.dimensions] * len(texts), pa.int32()), pa.array(vectors, pa.list_(pa.float32()))], names=["fact_id", "model", "dimensions", "vector"])

    return facts.select("id", "content").mapInArrow(run, "fact_id string, model string, dimensions int, vector array<float>")


def query_vector(provider: EmbeddingProvider | None, query: str) -> list[float] | None:
    """A query's vector, or null: a provider that fails degrades the search to keywords."""
    if provider is None:
        return None
    try:
        return provider.embed([query])[0]
    except Exception:
        return None
