"""Approximate nearest vectors by graphs of near neighbours, one for each shard, built and searched in Arrow groups.

Vectors are dealt into shards of bounded size by a hash of their ids. In a shard every vector is linked to its DEGREE nearest, to as
many of those that have it among theirs, and to a few at random, so that every part of a shard can be reached.

A search starts in each shard at the ENTRIES nearest of its first PIVOTS vectors (their order is a hash, so they are a sample), and
a round opens what the OPENED nearest unopened of the BEAM nearest so far are linked to, until all of these have been opened. A task
has one shard and one block of queries; a query has at most ``cap`` rows from each shard.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.operators.search import ranked
from mnemolake.scratch import written

DEGREE, RANDOM, SHARD_ROWS = 16, 3, 4096
BEAM, ENTRIES, PIVOTS, OPENED = 96, 8, 256, 8
#: Queries that meet a shard in one task, and those of them that walk side by side; partitions that groups are dealt to at most.
QUERY_ROWS, SIDE, PARTITIONS = 8192, 256, 1000
SHARD = ("model", "dimensions", "shard")


@dataclass(frozen=True)
class Graph:
    """``nodes``: (model, dimensions, shard, place, id, unit, near), where ``near`` has the places that a node is linked to."""

    nodes: DataFrame

    @property
    def links(self) -> DataFrame:
        """(model, dimensions, shard, id, to): ``to`` is a place in the shard."""
        return self.nodes.select(*SHARD, "id", F.explode("near").alias("to"))


def _unit(vectors: DataFrame, column: str, name: str) -> DataFrame:
    """With ``name``, the vector at length 1 in doubles; zero vectors stay zero, and null or empty ones have no row."""
    v = F.col(column).cast("array<double>")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    own = vectors.where(F.size(F.coalesce(column, F.array().cast("array<float>"))) > 0).withColumn("_size", size)
    return own.withColumn(name, F.when(F.col("_size") > 0, F.transform(v, lambda x: x / F.col("_size"))).otherwise(v)).drop("_size")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    if len(set(values.value_lengths().to_pylist())) > 1:
        raise ValueError("vectors differ in length")
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _linked(v: np.ndarray, degree: int) -> list[np.ndarray]:
    """For each vector the places of its links."""
    n = len(v)
    k = min(degree, n - 1)
    near = np.empty((n, k), np.int32)
    for a in range(0, n, SIDE):
        got = v[a : a + SIDE] @ v.T
        got[np.arange(len(got)), np.arange(a, a + len(got))] = -np.inf
        near[a : a + SIDE] = np.argsort(-got, 1, kind="stable")[:, :k]
    source, target, rank = np.repeat(np.arange(n, dtype=np.int32), k), near.ravel(), np.tile(np.arange(k), n)
    order = np.lexsort((rank, target))
    source, target = source[order], target[order]
    starts = np.searchsorted(target, np.arange(n))
    first = np.arange(len(target)) - starts[target] < degree
    source, target = source[first], target[first]
    ends = np.searchsorted(target, np.arange(n + 1))
    far = np.random.default_rng(n).integers(0, n, (n, RANDOM), dtype=np.int32)
    return [np.setdiff1d(np.concatenate((near[i], source[ends[i] : ends[i + 1]], far[i])), i) for i in range(n)]


def build(vectors: DataFrame, degree: int = DEGREE, shard_rows: int = SHARD_ROWS) -> Graph:
    """Graphs of ``vectors`` (fact_id, model, dimensions, vector); one fact has one vector of a model and length."""
    rows = _unit(vectors.select(F.col("fact_id").alias("id"), "model", "dimensions", "vector"), "vector", "unit").drop("vector")
    sizes = written(rows.groupBy("model", "dimensions").agg(F.ceil(F.count("*") / shard_rows).alias("_shards")), "graph-sizes")
    shards = sizes.agg(F.coalesce(F.sum("_shards"), F.lit(0))).first()[0]
    dealt = rows.join(F.broadcast(sizes), ["model", "dimensions"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("_shards")).cast("int"))
    ordered = dealt.select(*SHARD, "id", "unit", F.xxhash64("id", F.lit(1)).alias("order")).repartition(min(PARTITIONS, max(1, int(shards))), *SHARD)
    kinds = {f: dealt.schema[f].dataType.simpleString() for f in ("model", "dimensions", "id")}

    def one(shard: pa.Table) -> pa.Table:
        own = shard.sort_by([("order", "ascending"), ("id", "ascending")])
        near = _linked(_matrix(own.column("unit")).astype(np.float32), degree)
        ends = np.concatenate(([0], np.cumsum([len(x) for x in near]))).astype(np.int32)
        links = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(near) if near else [], pa.int32()))
        places = pa.array(np.arange(len(own), dtype=np.int32))
        return pa.table([own.column("model"), own.column("dimensions"), own.column("shard"), places, own.column("id"), own.column("unit"), links], names=[*SHARD, "place", "id", "unit", "near"])

    made = ordered.groupBy(*SHARD).applyInArrow(one, f"model {kinds['model']}, dimensions {kinds['dimensions']}, shard int, place int, id {kinds['id']}, unit array<double>, near array<int>")
    return Graph(written(made, "graph-nodes"))


def _walk(v: np.ndarray, links: np.ndarray, q: np.ndarray, beam: int) -> np.ndarray:
    """For each of ``q`` the places of about the ``beam`` nearest; -1 where there are fewer."""
    n, every = len(v), np.arange(len(q))[:, None]
    some = min(ENTRIES, n)
    got = q @ v[:PIVOTS].T
    start = np.argpartition(-got, some - 1, 1)[:, :some]
    width = max(beam, some, OPENED)
    place, near, opened = np.full((len(q), width), -1, np.int32), np.full((len(q), width), -np.inf, np.float32), np.ones((len(q), width), bool)
    place[:, :some], near[:, :some], opened[:, :some] = start, np.take_along_axis(got, start, 1), False
    seen = np.zeros((len(q), n), bool)
    seen[every, start] = True
    live = every[:, 0]
    while True:
        waits = np.where(opened[live], -np.inf, near[live])
        top = np.argpartition(-waits, OPENED - 1, 1)[:, :OPENED]
        good = np.take_along_axis(waits, top, 1) > -np.inf
        some = good.any(1)
        live, top, good = live[some], top[some], good[some]
        if not len(live):
            return place
        opened[live[:, None], top] = True
        at = np.take_along_axis(place[live], top, 1)
        ahead = np.where(good[:, :, None], links[at], -1).reshape(len(live), -1)
        ahead.sort(1)
        fresh = (ahead >= 0) & ~seen[live[:, None], ahead]
        fresh[:, 1:] &= ahead[:, 1:] != ahead[:, :-1]
        r, c = np.nonzero(fresh)
        to = ahead[r, c]
        seen[live[r], to] = True
        found = np.full(ahead.shape, -np.inf, np.float32)
        found[r, c] = np.einsum("ij,ij->i", q[live[r]], v[to])
        both, where, done = np.hstack((near[live], found)), np.hstack((place[live], np.where(fresh, ahead, -1))), np.hstack((opened[live], ~fresh))
        kept = np.argpartition(-both, width - 1, 1)[:, :width]
        near[live], place[live], opened[live] = (np.take_along_axis(x, kept, 1) for x in (both, where, done))


def search(graph: Graph, queries: DataFrame, cap: int, beam: int = BEAM) -> DataFrame:
    """Rows (query_id, id, rank0, similarity): about the ``cap`` nearest of each query (query_id, query_vector, model, dimensions)."""
    beam, block = max(beam, cap), [*SHARD, "block"]
    asked = _unit(queries.select("query_id", "model", "dimensions", "query_vector"), "query_vector", "a").drop("query_vector")
    asked = written(asked, "graph-asked")
    # Each shard meets each block of its model's queries, by keys alone.
    sizes = asked.groupBy("model", "dimensions").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("_blocks"))
    shards = graph.nodes.groupBy("model", "dimensions").agg((F.max("shard") + 1).alias("_shards"))
    grid = written(sizes.join(shards, ["model", "dimensions"]), "graph-grid")
    groups = int(grid.agg(F.coalesce(F.sum(F.col("_blocks") * F.col("_shards")), F.lit(0))).first()[0])
    parts = min(PARTITIONS, max(1, groups))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = graph.nodes.join(F.broadcast(grid), ["model", "dimensions"]).select(*SHARD, upto("_blocks").alias("block"), "place", "id", "unit", "near")
    right = asked.join(F.broadcast(grid), ["model", "dimensions"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("_blocks")).cast("int")).select("model", "dimensions", upto("_shards").alias("shard"), "block", "query_id", "a")
    kinds = {"query_id": asked.schema["query_id"].dataType.simpleString(), "id": graph.nodes.schema["id"].dataType.simpleString()}

    def one(shard: pa.Table, those: pa.Table) -> pa.Table:
        names, ids, sims = [], [], []
        if len(shard) and len(those):
            own = shard.sort_by("place")
            v, q = _matrix(own.column("unit")), _matrix(those.column("a"))
            if v.shape[1] != q.shape[1]:
                raise ValueError("vectors differ in length")
            near = own.column("near").combine_chunks()
            counts = near.value_lengths().to_numpy(zero_copy_only=False)
            links = np.full((len(own), max(1, counts.max())), -1, np.int32)
            links[np.arange(links.shape[1]) < counts[:, None]] = near.flatten().to_numpy(zero_copy_only=False)
            small_v, small_q = v.astype(np.float32), q.astype(np.float32)
            for a in range(0, len(q), SIDE):
                place = _walk(small_v, links, small_q[a : a + SIDE], beam)
                # What is kept is compared in doubles.
                exact = np.where(place >= 0, np.einsum("qd,qbd->qb", q[a : a + SIDE], v[place]), -np.inf)
                best = np.argsort(-exact, 1, kind="stable")[:, :cap]
                place, exact = np.take_along_axis(place, best, 1), np.take_along_axis(exact, best, 1)
                r, c = np.nonzero(place >= 0)
                names.append(r + a), ids.append(place[r, c]), sims.append(exact[r, c])
        at = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table([those.column("query_id").take(at(names, pa.int64())), (own if ids else shard).column("id").take(at(ids, pa.int32())), at(sims, pa.float64())], names=["query_id", "id", "similarity"])

    met = left.repartition(parts, *block).groupBy(*block).cogroup(right.repartition(parts, *block).groupBy(*block))
    found = met.applyInArrow(one, f"query_id {kinds['query_id']}, id {kinds['id']}, similarity double")
    return ranked(found, [F.desc("similarity"), F.col("id")], cap).select("query_id", "id", "rank0", "similarity")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (queries, recall): the share of ``exact`` (query_id, id) that is among ``found``."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))
