"""Ranked lexical search over a tiered index: high-impact postings first, with residual bounds for each term.

The impact of a term in a document doesn't depend on the query, so every term's postings are cut by impact into tiers;
a term's residual bound of a tier is the largest impact below it. A segment of the index is one row: some documents, and
a group of columns for each tier, so that a search of the upper tiers reads their columns alone.

A search sums what the upper tiers have. That is a document's lower bound; the residual bounds of the item's terms it
wasn't seen with make its upper bound. The item is proven at a tier if its k-th best lower bound is above the sum of all
its residual bounds: then no unseen document can enter, and of the seen ones only those whose upper bound reaches
the k-th best are scored on all tiers. An item that lacks the proof falls through to the next tier; the last one has no
residual, so its sums are exact.

Items are taken in blocks of bounded size against all documents. Scores are integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import ALNUM_WORDS, Splitter, scratch_path, trim, written

TOP = 50
#: Of a term's postings, in order of impact, these shares are in the first tiers (and FEWEST at least); the rest is in the last.
SHARES, FEWEST = (0.02, 0.2), 400
TIERS = len(SHARES) + 1
#: Width of the ranges of impacts (below 1,000,000) between which tiers are cut.
WIDTH = 2048
#: Items, and different terms on average, of a block. A block is what the driver and each task hold of the query set.
BLOCK_ITEMS, BLOCK_TERMS = 256, 1 << 16
#: Documents of a segment, segments that are sent to a task at a time, contributions that are added up at a time.
SEGMENT, SEGMENTS, AT_ONCE = 256, 16, 1 << 20


def _columns(tier: int) -> list[str]:
    return [f"term{tier}", f"doc{tier}", f"impact{tier}"]


def impact(tf: Column, n: Column, documents: int, words: int) -> Column:
    """What a term of weight 1 adds: tf occurrences in a document of n words, of so many documents and words."""
    m = F.lit(50) + F.call_function("div", 50 * n * F.lit(documents), F.lit(words))
    return F.call_function("div", F.lit(1_000_000_000) * tf.cast("long"), 1000 * tf.cast("long") + 20 * m)


@contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    """Rows that are whole segments are sent a few at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(SEGMENTS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different terms of every item."""
    split = Splitter(ALNUM_WORDS)
    for batch in batches:
        terms = [sorted({w for words in split.pieces((t.as_py() or "").encode("utf-8", "surrogatepass")) for w in words}) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("item_id"), pa.array(terms, pa.list_(pa.binary())), pa.array(map(len, terms), pa.int64())], ["row", "item_id", "terms", "n"])


def _counted(ids: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words of every document, and how often the asked terms are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, asked = Splitter(ALNUM_WORDS), ids.keys()
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column("text"):
                of: Counter[bytes] = Counter()
                n = 0
                for words in split.pieces((text.as_py() or "").encode("utf-8", "surrogatepass")):
                    n += len(words)
                    of.update(words)
                found = of.keys() & asked
                sizes.append(n)
                terms.append([ids[t] for t in found])
                counts.append([of[t] for t in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "counts"])
        trim()

    return run


def _lists(values: np.ndarray, sizes: list[int], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))


def _inverted(cuts: np.ndarray, documents: int, words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Segments of at most SEGMENT documents; a posting is in as low a tier as cuts of its term are above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        for whole in batches:
            for at in range(0, whole.num_rows, SEGMENT):
                batch = whole.slice(at, SEGMENT)
                of = batch.column("terms")
                terms, tf = of.flatten().to_numpy(zero_copy_only=False), batch.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                place = np.repeat(np.arange(batch.num_rows), of.value_lengths().to_numpy(zero_copy_only=False))
                m = 50 + 50 * batch.column("n").to_numpy(zero_copy_only=False) * documents // max(words, 1)
                value = 1_000_000_000 * tf // (1000 * tf + 20 * m[place])
                tier = (value[:, None] // WIDTH < cuts[terms]).sum(axis=1)
                columns = [pa.array([number], pa.int64()), _lists(np.zeros(0), [0], pa.int64()) if not batch.num_rows else pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id"))]
                order = np.argsort(terms, kind="stable")
                for k in range(TIERS):
                    own = order[tier[order] == k]
                    columns += [_lists(x[own], [len(own)], pa.int32()) for x in (terms, place, value)]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "docs", *(c for k in range(TIERS) for c in _columns(k))])
                number += 1
        trim()

    return run


_INDEX = "segment long, docs array<long>, " + ", ".join(f"{c} array<int>" for k in range(TIERS) for c in _columns(k))


@dataclass(frozen=True)
class Terms:
    """For each asked term its weight, the least range of impacts in each tier but the last, the largest impact below each tier."""

    weight: np.ndarray
    cuts: np.ndarray
    residual: np.ndarray


@dataclass(frozen=True)
class Block:
    """Some items: their rows, and their terms as (term, item) pairs grouped by term."""

    rows: np.ndarray
    start: np.ndarray
    item: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, list[int]]], terms: int) -> Block:
        term = np.array([t for _, own in items for t in own], np.int64)
        item = np.repeat(np.arange(len(items)), [len(own) for _, own in items])
        order = np.argsort(term, kind="stable")
        return cls(np.array([row for row, _ in items], np.int64), np.searchsorted(term[order], np.arange(terms + 1)), item[order])


def build(docs: DataFrame, ids: dict[bytes, int]) -> tuple[DataFrame, Terms]:
    """The index of ``docs`` (doc_id, text) for the terms ``ids``, and what is known of the terms. Texts are read once."""
    spark = docs.sparkSession
    forward = written(docs.mapInArrow(_counted(ids), "doc_id long, n long, terms array<int>, counts array<int>"), "ranked-forward")
    documents, words = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    each = forward.select("n", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), impact(F.col("t.counts"), F.col("n"), documents, max(words, 1)).alias("value"))
    ranges = each.groupBy("term", F.call_function("div", F.col("value"), F.lit(WIDTH)).alias("range")).agg(F.count("*").alias("c"), F.max("value").alias("top"))
    down = Window.partitionBy("term").orderBy(F.desc("range"))
    ranges = ranges.withColumns({"above": F.coalesce(F.sum("c").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "df": F.sum("c").over(Window.partitionBy("term"))})
    tier = reduce(lambda low, s: F.when(F.col("above") < F.greatest(F.lit(FEWEST), F.col("df") * s[1]), s[0]).otherwise(low), reversed(list(enumerate(SHARES))), F.lit(TIERS - 1))
    marked = ranges.withColumn("tier", tier)
    known = marked.groupBy("term").agg(F.max("df").alias("df"), *[F.min(F.when(F.col("tier") <= k, F.col("range"))).alias(f"cut{k}") for k in range(TIERS - 1)], *[F.coalesce(F.max(F.when(F.col("tier") > k, F.col("top"))), F.lit(0)).alias(f"below{k}") for k in range(TIERS - 1)])
    weight, cuts, residual = np.zeros(len(ids), np.int64), np.zeros((len(ids), TIERS - 1), np.int64), np.zeros((len(ids), TIERS), np.int64)
    for r in known.collect():  # a row for each term of the block
        weight[r.term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1)))
        cuts[r.term] = [r[f"cut{k}"] for k in range(TIERS - 1)]
        residual[r.term, : TIERS - 1] = [r[f"below{k}"] for k in range(TIERS - 1)]
    path = scratch_path(spark, "ranked-index")
    # Small row groups: a reader holds some of them, whole.
    forward.where(F.size("terms") > 0).mapInArrow(_inverted(cuts, documents, words), _INDEX).write.option("parquet.block.size", 8 << 20).parquet(path)
    return spark.read.schema(_INDEX).parquet(path), Terms(weight, cuts, residual)


def _summed(segment: dict, tiers: int, block: Block, value: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], wide: int, only: np.ndarray | None = None) -> list[np.ndarray]:
    """For each of the ``wide`` arrays of ``value`` (term, impact) its sums by (document, item), over the upper tiers and the documents ``only``."""
    items = len(block.rows)
    sums = [np.zeros(len(segment["docs"]) * items, np.int64) for _ in range(wide)]
    for k in range(tiers):
        term, place, amount = (segment[c].astype(np.int64) for c in _columns(k))
        keep = block.start[term + 1] > block.start[term]
        if only is not None:
            keep &= only[place]
        term, place, amount = term[keep], place[keep], amount[keep]
        each = block.start[term + 1] - block.start[term]
        ends = np.cumsum(each)
        at = 0
        while at < len(term):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            n = each[at:end]
            first = np.repeat(block.start[term[at:end]] - (np.cumsum(n) - n), n)
            flat = np.repeat(place[at:end] * items, n) + block.item[first + np.arange(len(first))]
            for to, x in zip(sums, value(term[at:end], amount[at:end])):
                np.add.at(to, flat, np.repeat(x, n))
            at = end
    return [x.reshape(len(segment["docs"]), items) for x in sums]


class _Best:
    """The best documents of each item so far, ties by ascending id (nulls last)."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.held = [np.zeros(0, np.int64) for _ in range(4)]

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        rows = [np.concatenate(x) for x in zip(self.held, (item, score, doc, null))]
        order = np.lexsort((rows[2], rows[3], -rows[1], rows[0]))
        rows = [x[order] for x in rows]
        first = np.searchsorted(rows[0], rows[0])
        keep = np.arange(len(order)) - first < self.top
        self.held = [x[keep] for x in rows]
        last = np.arange(len(order)) - first == self.top - 1
        self.least[rows[0][last]] = rows[1][last]


def _searched(tiers: int, block: Block, terms: Terms, top: int, floor: np.ndarray | None, rest: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each task's best ``top`` documents of every item by the sum of the upper ``tiers``.

    With ``floor``, only documents whose upper bound reaches it count, by their sums over all tiers; ``rest`` is
    the sum of the item's residual bounds.
    """
    residual = terms.residual[:, tiers - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(block.rows), top)
        for batch in batches:
            for i in range(batch.num_rows):
                segment = {c: batch.column(c)[i].values for c in batch.schema.names if c != "segment"}
                docs = segment["docs"]
                segment = {c: x.to_numpy(zero_copy_only=False) if c != "docs" else x for c, x in segment.items()}
                if floor is None:
                    (score,) = _summed(segment, tiers, block, lambda t, v: [terms.weight[t] * v], 1)
                    place, item = np.nonzero(score >= best.least)
                else:
                    (above,) = _summed(segment, tiers, block, lambda t, v: [terms.weight[t] * (v - residual[t])], 1)
                    near = rest + above >= floor
                    if not near.any():
                        continue
                    (score,) = _summed(segment, TIERS, block, lambda t, v: [terms.weight[t] * v], 1, near.any(axis=1))
                    place, item = np.nonzero(near & (score >= best.least))
                null = docs.is_null().to_numpy(zero_copy_only=False)
                best.add(item, score[place, item], docs.fill_null(0).to_numpy(zero_copy_only=False)[place], null[place].astype(np.int64))
        item, score, doc, null = best.held
        yield pa.RecordBatch.from_arrays([pa.array(block.rows[item], pa.int64()), pa.array(score, pa.int64()), pa.array(doc, pa.int64(), mask=null.astype(bool))], ["row", "score", "doc_id"])
        trim()

    return run


_FOUND = "row long, score long, doc_id long"


def _ranked(found: DataFrame, top: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= top)


def _block(docs: DataFrame, items: list, top: int) -> list[DataFrame]:
    """Results of one block of items, tier by tier."""
    spark = docs.sparkSession
    ids = {t: i for i, t in enumerate(sorted({bytes(t) for r in items for t in r.terms}))}
    index, terms = build(docs, ids)
    left = [(r.row, [i for t in r.terms if terms.weight[i := ids[bytes(t)]] > 0]) for r in items]
    out = []
    with _few_rows(spark):
        for k in range(1, TIERS):
            if not left:
                break
            block = Block.of(left, len(ids))
            upper = index.select("docs", *(c for j in range(k) for c in _columns(j)))
            kth = _ranked(upper.mapInArrow(_searched(k, block, terms, top, None, None), _FOUND), top).where(F.col("rank") == top).select("row", "score").collect()  # a row for each item of the block
            floor, rest = dict((r.row, r.score) for r in kth), {row: int((terms.weight[own] * terms.residual[own, k - 1]).sum()) for row, own in left}
            proven = [x for x in left if x[0] in floor and rest[x[0]] < floor[x[0]]]
            if proven:
                block = Block.of(proven, len(ids))
                reach = _searched(k, block, terms, top, np.array([floor[r] for r in block.rows]), np.array([rest[r] for r in block.rows]))
                out.append(written(index.mapInArrow(reach, _FOUND), "ranked-found").withColumn("tier", F.lit(k - 1)))
                left = [x for x in left if x[0] not in set(block.rows.tolist())]
        if left:
            out.append(written(index.mapInArrow(_searched(TIERS, Block.of(left, len(ids)), terms, top, None, None), _FOUND), "ranked-found").withColumn("tier", F.lit(TIERS - 1)))
    return out


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Rows (item_id, rank, doc_id, score, tier): each item's ``top`` highest-scoring documents with a score above 0, equal
    scores by ascending doc_id (null last); ``tier`` is where the item was proven, TIERS - 1 where all postings were summed.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are not read. Null texts have no terms. A row is
    a document or an item of its own, also where ids repeat or are null, so of equal rows each has its rank. Empty
    tables, items without terms and items whose terms no document has give no rows.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").alias("item_id"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    asked = written(rows.mapInArrow(_asked, f"row long, item_id {kind}, terms array<binary>, n long").where("n > 0"), "ranked-items")
    count, total = asked.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, math.ceil(count / BLOCK_ITEMS), math.ceil(total / BLOCK_TERMS))
    dealt = written(asked.repartition(blocks).withColumn("block", F.spark_partition_id()), "ranked-blocks") if blocks > 1 else asked.withColumn("block", F.lit(0))
    found = [spark.createDataFrame([], f"{_FOUND}, tier int")]
    for b in range(blocks if count else 0):
        found += _block(own, dealt.where(F.col("block") == b).select("row", "terms").collect(), top)
    all_found = _ranked(reduce(DataFrame.unionByName, found), top)
    return all_found.join(asked.select("row", "item_id"), "row").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score", "tier")
