"""Retrieval: postings and BM25, recall lists, reciprocal rank fusion, decay, vectors, episodes.

Everything carries ``query_id``, so one plan serves many queries.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake import schemas as S
from mnemolake.functions import predicates as P
from mnemolake.functions.text import clip, search_tokens
from mnemolake.functions.vectors import cosine
from mnemolake.scratch import written

if TYPE_CHECKING:
    from mnemolake.operators.textindex import TextIndex


#: Query vectors that are sent out together.
QUERY_BLOCK = 1024
#: Vectors that are multiplied by them at once, and rows of a batch that is given back.
PORTION, MOST_ROWS = 1024, 1 << 16
#: Numbers of the pairs that are multiplied by themselves at once, and what a product of matrices is off by at most.
PAIR_VALUES, SLACK = 1 << 22, 1e-9


def indexed(corpus: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Rows (id, tokens): the tokens of all ``columns``, with a gap between columns so that phrases don't cross them."""
    parts: list[Column] = []
    for c in columns:
        parts += [search_tokens(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.array(F.lit(""))]
    return corpus.select(F.col(id_col).alias("id"), F.concat(*parts[:-1]).alias("tokens"))


def query_phrases(queries: DataFrame) -> DataFrame:
    """Rows (query_id, position, phrase): each white-space term, quotes dropped, as its tokens; terms without any drop out."""
    terms = queries.select("query_id", F.posexplode(F.split(F.replace("query", F.lit('"'), F.lit(" ")), "\\s+")).alias("position", "term"))
    return terms.select("query_id", "position", search_tokens(F.col("term")).alias("phrase")).where(F.size("phrase") > 0)


def _occurrences(tokens: Column, phrase: Column) -> Column:
    """How often ``phrase`` stands in ``tokens`` in adjacent places."""
    places = F.sequence(F.lit(1), F.size(tokens) - F.size(phrase) + 1)
    fits = F.filter(places, lambda i: F.slice(tokens, i, F.size(phrase)) == phrase)
    one = F.size(F.filter(tokens, lambda t: t == F.get(phrase, F.lit(0))))
    many = F.when(F.size(tokens) >= F.size(phrase), F.size(fits)).otherwise(0)
    return F.when(F.size(phrase) == 1, one).otherwise(many)


def bm25(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Scores (query_id, id, score) of rows that hold every phrase of a query.

    Statistics are over the whole index. Single-token phrases go through postings (token, id, count), made for the
    tokens that are asked only; longer ones are counted on the rows that their first token finds.
    """
    phrases = query_phrases(queries)
    asked = phrases.select(F.get("phrase", F.lit(0)).alias("token"), "phrase").distinct()
    # One row with the phrases of the query set. A document keeps its counts of those whose first token it has. Texts
    # are read and cut into tokens once: the counts are written, as statistics, rarity and scores all need them.
    whole = asked.agg(F.collect_set("token").alias("tokens_asked"), F.collect_set(F.struct("token", "phrase")).alias("asked"))
    own = index.crossJoin(F.broadcast(whole)).withColumn("have", F.array_intersect("tokens", "tokens_asked"))
    counted = F.transform(F.filter("asked", lambda a: F.array_contains("have", a["token"])), lambda a: F.struct(a["phrase"].alias("phrase"), _occurrences(F.col("tokens"), a["phrase"]).alias("f")))
    made = own.select("id", F.size(F.filter("tokens", lambda t: t != "")).alias("length"), F.filter(counted, lambda x: x["f"] > 0).alias("found"))
    made = written(made, "postings")
    stats = made.agg(F.count("*").cast("double").alias("rows"), F.avg("length").alias("mean"))
    return weighted(made.select("id", "length", F.explode("found").alias("x")).select("id", "length", "x.phrase", "x.f"), stats, phrases)


def weighted(postings: DataFrame, stats: DataFrame, phrases: DataFrame) -> DataFrame:
    """BM25 of ``postings`` (id, length, phrase, f) with one row of ``stats`` (rows, mean), for ``phrases`` (query_id, phrase)."""
    df = postings.groupBy("phrase").agg(F.count("*").alias("n"))
    idf = F.log((F.col("rows") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    # One row of statistics: the only cross join, of 1 row.
    weights = df.crossJoin(F.broadcast(stats)).select("phrase", "mean", F.when(idf <= 0, F.lit(S.BM25_LEAST_IDF)).otherwise(idf).alias("idf"))
    part = F.col("idf") * F.col("f") * (S.BM25_K1 + 1) / (F.col("f") + S.BM25_K1 * (1 - S.BM25_B + S.BM25_B * F.col("length") / F.col("mean")))
    scored = postings.join(weights, "phrase").select("phrase", "id", part.alias("part"))
    needed = phrases.groupBy("query_id").agg(F.count("*").alias("needed"))
    hits = phrases.join(scored, "phrase").groupBy("query_id", "id").agg(F.sum("part").alias("score"), F.count("*").alias("found"))
    return hits.join(needed, "query_id").where("found = needed").select("query_id", "id", "score")


def ranked(scored: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """``scored`` with rank0, the zero-based place within its query, cut at ``cap``."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("rank0", (F.row_number().over(w) - 1).cast("long")).where(F.col("rank0") < cap)


def keyword_list(facts: DataFrame, queries: DataFrame, now: Column, cap: int, at: Column | None = None, columns: tuple[str, ...] = ("content", "domain", "subdomain"), index: TextIndex | None = None) -> DataFrame:
    """Recall by BM25: matched and scored over all facts, then those in force, then the best ``cap``. With an ``index`` of the facts only
    the asked tokens' postings are read."""
    if index is None:
        hits = bm25(indexed(facts, "id", list(columns)), queries)
    else:
        hits = index.search(queries).withColumn("id", F.col("id").cast(facts.schema["id"].dataType))
    live = facts.where(P.in_force(now, at)).select("id")
    return ranked(hits.join(live, "id", "left_semi"), [F.desc("score"), F.col("id")], cap).select("query_id", "id", "rank0", "score")


def domain_list(facts: DataFrame, queries: DataFrame, now: Column, cap: int, at: Column | None = None) -> DataFrame:
    """Recall by a query's domain, newest first."""
    live = facts.where(P.in_force(now, at)).select("id", "domain", "created_at")
    return ranked(queries.select("query_id", "domain").where("domain is not null").join(live, "domain"), [F.desc("created_at"), F.col("id")], cap).select("query_id", "id", "rank0")


def vector_list(vectors: DataFrame, queries: DataFrame, live: DataFrame, cap: int, floor: float = 0.0, ratio: float = S.SIMILARITY_RATIO) -> DataFrame:
    """Exact similarity recall: the floor first, then ``ratio`` of the best, then ``cap``, then what is in force.

    ``queries`` has (query_id, query_vector, model, dimensions); a best of 0 or less finds nothing. Query vectors
    are a stated set: every vector meets each once.
    """
    top = ranked(nearest(vectors, queries, floor, cap), [F.desc("similarity"), F.col("id")], cap)
    best = F.max("similarity").over(Window.partitionBy("query_id"))
    near = top.withColumn("best", best).where((F.col("best") > 0) & (F.col("similarity") >= F.col("best") * min(max(ratio, 0.0), 1.0)))
    return near.join(live.select("id"), "id", "left_semi").select("query_id", "id", "rank0", "similarity")


def nearest(vectors: DataFrame, queries: DataFrame, floor: float, most: int) -> DataFrame:
    """As :func:`similarities`, but of a task's vectors only the ``most`` nearest of each query, by similarity and id: no others can be among
    the ``most`` nearest of all. A task holds these and one portion of similarities."""
    return similarities(vectors, queries, floor, most)


def similarities(vectors: DataFrame, queries: DataFrame, floor: float, most: int | None = None) -> DataFrame:
    """Cosine similarities (query_id, id, similarity) from ``floor`` on; 0 where a vector is zero.

    The query vectors, a stated set, go out in blocks of bounded size. Each block is a matrix by which a batch of
    vectors is multiplied, so every vector meets every query of its model and length once.
    """
    import numpy as np
    import pyarrow as pa

    spark, kind = vectors.sparkSession, vectors.schema["fact_id"].dataType.simpleString()
    rows = vectors.select("fact_id", "model", "dimensions", "vector")

    def unit(m: np.ndarray) -> np.ndarray:
        n = np.sqrt((m * m).sum(1, keepdims=True))
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def block(asked: list) -> DataFrame:
        groups: dict[tuple, list] = {}
        for r in asked:
            groups.setdefault((r["model"], r["dimensions"]), []).append(r)
        sent = spark.sparkContext.broadcast({k: ([r["query_id"] for r in g], unit(np.array([r["query_vector"] for r in g], np.float64))) for k, g in groups.items()})

        def scored(batches):
            """(key, query, id, similarity) of portions of a batch, as arrays."""
            for batch in batches:
                keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
                for key in set(keys) & set(sent.value):
                    every = np.array([i for i, k in enumerate(keys) if k == key])
                    for own in (every[i : i + PORTION] for i in range(0, len(every), PORTION)):
                        matrix = sent.value[key][1]
                        part = batch.column(3).take(pa.array(own))
                        if set(part.value_lengths().to_pylist()) - {matrix.shape[1]}:
                            raise ValueError("vectors differ in length")
                        units = unit(part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1))
                        low = np.broadcast_to(np.maximum(floor, least.get(key, -np.inf)), len(matrix))
                        v, q = np.nonzero(units @ matrix.T >= low - SLACK)
                        # The last bits of a product of matrices differ by place: pairs are multiplied by themselves, so that equal vectors tie.
                        some = max(1, PAIR_VALUES // matrix.shape[1])
                        got = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", units[v[i : i + some]], matrix[q[i : i + some]]) for i in range(0, len(v), some))])
                        kept = got >= low[q]
                        yield key, q[kept], batch.column(0).take(pa.array(own[v[kept]])), got[kept]

        least: dict[tuple, np.ndarray] = {}

        def rows_of(key, q, ids, found):
            names = pa.array(sent.value[key][0], pa.string())
            for i in range(0, len(q), MOST_ROWS):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q[i : i + MOST_ROWS])), ids[i : i + MOST_ROWS], pa.array(found[i : i + MOST_ROWS])], names=["query_id", "id", "similarity"])

        def run(batches):
            held: dict[tuple, tuple] = {}
            least.clear()
            for key, q, ids, found in scored(batches):
                if most is None:
                    yield from rows_of(key, q, ids, found)
                    continue
                if key in held:
                    q, ids, found = np.concatenate((held[key][0], q)), pa.concat_arrays((held[key][1], ids)), np.concatenate((held[key][2], found))
                order = np.lexsort((ids.to_numpy(zero_copy_only=False), -found, q))
                place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
                kept = order[place < most]
                held[key] = q[kept], ids.take(pa.array(kept)), found[kept]
                # What is below a query's last place can't get in.
                low = np.full(len(sent.value[key][0]), -np.inf)
                last = order[place == most - 1]
                low[q[last]] = found[last]
                least[key] = low
            for key, (q, ids, found) in held.items():
                yield from rows_of(key, q, ids, found)

        return rows.mapInArrow(run, f"query_id string, id {kind}, similarity double")

    out, held = None, []
    for r in queries.select("query_id", "model", "dimensions", "query_vector").where("query_vector is not null").toLocalIterator():
        held.append(r)
        if len(held) == QUERY_BLOCK:
            out, held = block(held) if out is None else out.union(block(held)), []
    return out if out is not None and not held else block(held) if out is None else out.union(block(held))


def entity_list(queries: DataFrame, entities: DataFrame, links: DataFrame, same: DataFrame, terms: int = 5, least: int = 3) -> DataFrame:
    """Rows (query_id, id, position): facts of the families of the entities that a query's first ``terms`` terms of ``least`` characters or
    more name; the first term that leads to a fact counts."""
    from mnemolake.operators import graph as G

    words = F.filter(F.split(F.replace("query", F.lit('"'), F.lit(" ")), "\\s+"), lambda t: F.length(t) >= least)
    asked = queries.select("query_id", F.posexplode(F.slice(words, 1, terms)).alias("position", "name"))
    found = written(G.resolve_names(asked.select("name").distinct(), entities).select("name", F.col("id").alias("seed")), "named")
    family = G.same_as_closure(found.select("seed").distinct(), same)
    members = asked.join(found, "name").join(family, "seed").groupBy("query_id", F.col("member").alias("entity_id")).agg(F.min("position").alias("position"))
    return members.join(links.select("entity_id", "fact_id"), "entity_id").groupBy("query_id", F.col("fact_id").alias("id")).agg(F.min("position").alias("position"))


def rrf(lists: list[DataFrame]) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, rank0): the first place gives 1/60."""
    union = lists[0].select("query_id", "id", "rank0")
    for x in lists[1:]:
        union = union.unionByName(x.select("query_id", "id", "rank0"))
    return union.groupBy("query_id", "id").agg(F.sum(1 / (S.RRF_K + F.col("rank0"))).alias("rrf"), F.count("*").alias("lists"))


def fused(facts: DataFrame, merged: DataFrame, now: Column, limit: int, prior: Column | None = None) -> DataFrame:
    """The best ``limit`` of each query: fusion, raised by recency, times the prior."""
    own = merged.join(facts, "id")
    score = F.col("rrf") * (1 + S.DECAY_WEIGHT * P.temporal_score(now)) * (prior if prior is not None else F.lit(1.0))
    return ranked(own.withColumn("score", score), [F.desc("score"), F.col("id")], limit)


def pool(limit: int) -> int:
    return max(5 * limit, S.LEAST_POOL)


def hybrid(facts: DataFrame, queries: DataFrame, now: Column, limit: int = S.DEFAULT_LIMIT, at: Column | None = None, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, entity_hits: DataFrame | None = None, prior: Column | None = None, floor: float = 0.0, index: TextIndex | None = None, ann: bool | None = False) -> DataFrame:
    """Keyword, domain, entity and vector recall, fused. A domain ranks, it never gates.

    Vectors are searched exactly, however many there are, unless ``ann`` asks for a graph, which may miss some (None: above a size).
    """
    cap = pool(limit)
    lists = [keyword_list(facts, queries, now, cap, at, index=index)]
    if "domain" in queries.columns:
        lists.append(domain_list(facts, queries, now, cap, at))
    if entity_hits is not None:
        live = facts.where(P.in_force(now, at)).select("id")
        lists.append(ranked(entity_hits.join(live, "id", "left_semi"), [F.col("position"), F.col("id")], cap))
    if vectors is not None and query_vectors is not None:
        lists.append(vector_recall(vectors, query_vectors, facts.where(P.in_force(now, at)), cap, floor, ann=ann))
    return fused(facts, rrf(lists), now, limit, prior)


def quality(results: DataFrame, limit: int) -> DataFrame:
    """Signals of each query's results (query_id, rank0, score): coverage, confidence, and whether to refine."""
    got = results.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("rank0") == 0, F.col("score"))).alias("first"), F.max(F.when(F.col("rank0") == 1, F.col("score"))).alias("second"))
    gap = (F.col("first") - F.col("second")) / F.col("first")
    sure = F.when(F.col("n") == 1, 0.7).when(gap > 0.5, 0.9).when(gap > 0.2, 0.7).otherwise(0.5)
    return got.select("query_id", F.when(F.col("n") >= limit, 0.5).otherwise(0.7).alias("coverage_estimate"), sure.alias("result_confidence"), (sure <= 0.5).alias("refine"))


def episodes(events: DataFrame, queries: DataFrame, hits: int = S.EPISODE_HITS, slices: int = S.EPISODE_SLICES, radius: int = S.EPISODE_RADIUS, most: int = S.EPISODE_EVENTS) -> DataFrame:
    """Log windows around the best hits: conversations in hit order, their events between the outer hits plus ``radius``.

    ``events`` has (id, conversation, sequence, role, content). The range join is an equi-join on the conversation.
    """
    found = ranked(bm25(indexed(events, "id", ["content"]), queries), [F.desc("score"), F.col("id")], hits)
    placed = found.join(events.select("id", "conversation", "sequence"), "id")
    groups = placed.groupBy("query_id", "conversation").agg(F.min("rank0").alias("first"), (F.greatest(F.lit(1), F.min("sequence") - radius)).alias("low"), (F.max("sequence") + radius).alias("high"), F.collect_set("id").alias("ids"))
    w = Window.partitionBy("query_id").orderBy("first")
    top = groups.withColumn("slice", F.row_number().over(w).cast("long")).where(F.col("slice") <= slices)
    near = top.join(events, "conversation").where(F.col("sequence").between(F.col("low"), F.col("high")))
    w = Window.partitionBy("query_id", "conversation").orderBy("sequence")
    kept = near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return kept.select("query_id", "slice", "conversation", "id", "sequence", "role", clip(F.col("content"), S.EPISODE_CLIP).alias("content"), F.array_contains("ids", F.col("id")).alias("matched"))


def related(events: DataFrame, facts: DataFrame, now: Column, cap: int = 8, tokens: int = 8) -> DataFrame:
    """Facts for a batch of events: its distinct tokens of four characters or more are queries of their own; the best score of a fact counts."""
    words = events.select(F.explode(F.filter(F.split(F.lower("content"), "[^a-z0-9]+"), lambda t: F.length(t) >= 4)).alias("query"), "sequence").groupBy("query").agg(F.min("sequence").alias("first"))
    asked = words.orderBy("first", "query").limit(tokens).select(F.col("query").alias("query_id"), "query")
    got = keyword_list(facts, asked, now, S.LEAST_POOL)
    return got.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(cap)


def should_use_ann(setting: bool | None, engine: bool, rows: int, dimensions: int) -> bool:
    """Whether approximate search is in order: never if switched off or missing, always if on, else by size."""
    if setting is False or not engine:
        return False
    return bool(setting) or rows * dimensions * 4 > S.ANN_BYTES


def vector_recall(vectors: DataFrame, queries: DataFrame, live: DataFrame, cap: int, floor: float = 0.0, ratio: float = S.SIMILARITY_RATIO, ann: bool | None = None) -> DataFrame:
    """Vector recall, by a graph of neighbours where :func:`should_use_ann` says so, else exact. What the graph finds goes through the
    same floor, share of the best and cap."""
    from mnemolake.operators import neighbourgraph as N

    rows, dimensions = vectors.agg(F.count("*"), F.coalesce(F.max("dimensions"), F.lit(0))).first()
    if not should_use_ann(ann, True, rows, dimensions):
        return vector_list(vectors, queries, live, cap, floor, ratio)
    near = N.search(N.build(vectors), queries, cap).where(F.col("similarity") >= floor)
    best = near.where("rank0 = 0 and similarity > 0").select("query_id", F.col("similarity").alias("best"))
    kept = near.join(best, "query_id").where(F.col("similarity") >= F.col("best") * min(max(ratio, 0.0), 1.0))
    return kept.join(live.select("id"), "id", "left_semi").select("query_id", "id", "rank0", "similarity")
