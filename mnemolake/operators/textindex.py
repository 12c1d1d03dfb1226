"""An inverted index on disk that is kept up to date: segments of postings, in folders by a hash of the token.

A search opens the folders of the tokens that are asked and nothing else of the corpus: postings carry the document's length,
and the number of documents and of words are sums over a row for each change. Documents that go are noted; what was
added before that no longer counts, and is dropped when its segment is merged. Segments of like size are merged when there
are several, so there are few of them however many changes there were.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.operators.search import indexed, query_phrases, weighted
from mnemolake.scratch import written
from mnemolake.store import Store

#: Folders of a segment, and files of one at most (a very frequent token is written by so many tasks).
BUCKETS, SALT = 64, 8
#: Words of a change from which tasks have a bucket each, and of a task at most: its sort takes about a hundred bytes for each.
LEAST_WORDS, TASK_WORDS = 1 << 21, 11_000_000
#: Documents that are cut into postings at once, and rows of a batch of postings.
DOCUMENTS, ROWS = 512, 1 << 15
#: So many segments of one size class are merged; a class is up to SIZES times as large as the one below.
FEW, SIZES = 4, 4


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _postings(rows: DataFrame) -> DataFrame:
    """Postings (token, id, length, places) of ``rows`` (id, tokens). All of a document's are made where it is read, so only they are shuffled."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(at, DOCUMENTS)
                ids, held = part.column(0), part.column(1)
                counts = held.value_lengths().to_numpy(zero_copy_only=False)
                coded = held.flatten().dictionary_encode()
                code, document = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(counts)), counts)
                place = np.arange(len(code)) - np.repeat(np.cumsum(counts) - counts, counts)
                word = np.array([t != "" for t in coded.dictionary.to_pylist()], bool)[code] if len(code) else np.zeros(0, bool)
                code, document, place = code[word], document[word], place[word]
                length = np.bincount(document, minlength=len(counts)).astype(np.int32)
                # By document and token; places stay in order.
                order = np.lexsort((code, document))
                code, document, place = code[order], document[order], place[order]
                first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (document[1:] != document[:-1])))) if len(code) else np.zeros(0, np.int64)
                for a in range(0, len(first), ROWS):
                    some = first[a : a + ROWS]
                    ends = np.append(some, first[a + ROWS] if a + ROWS < len(first) else len(code))
                    places = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(place[ends[0] : ends[-1]], pa.int32()))
                    yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[some])), ids.take(pa.array(document[some])), pa.array(length[document[some]]), places], names=["token", "id", "length", "places"])

    return rows.mapInArrow(run, "token string, id string, length int, places array<int>")


class TextIndex:
    """Text of (id, columns) under a store's ``fts_*`` tables. Ids are strings."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    def add(self, rows: DataFrame, id_col: str, columns: list[str]) -> None:
        """Index ``rows``, whose ids aren't in the index (or were removed). Null columns are empty; nothing that is there is read."""
        at = self.store.reserve("fts", 1) + 1
        tokens = indexed(rows, id_col, columns).select(F.col("id").cast("string").alias("id"), "tokens")
        own = tokens.select("id", F.size(F.filter("tokens", lambda t: t != "")).alias("length"))
        own = written(own, "fts-lengths")
        postings = _postings(tokens)
        stats = own.agg(F.count("*").alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("words"))
        words = stats.first()["words"]
        self.store.commit({"fts_postings": self._dealt(postings, words, at), "fts_lengths": own.select("id", "length", F.lit(at).cast("long").alias("added")), "fts_stats": stats}, add=True)
        self._merge()

    def remove(self, ids: DataFrame, id_col: str) -> None:
        """Take documents out; ids that aren't in the index change nothing."""
        at = self.store.reserve("fts", 1) + 1
        head = self.store.head()
        gone = ids.select(F.col(id_col).cast("string").alias("id")).distinct()
        live = written(self._live(self.store.table("fts_lengths", head), head).join(gone, "id", "left_semi"), "fts-removed")
        stats = live.agg((-F.count("*")).alias("documents"), (-F.coalesce(F.sum("length"), F.lit(0))).cast("long").alias("words"))
        self.store.commit({"fts_removed": live.select("id", F.lit(at).cast("long").alias("removed")), "fts_stats": stats}, add=True)

    def search(self, queries: DataFrame) -> DataFrame:
        """Scores (query_id, id, score) as :func:`mnemolake.operators.search.bm25` gives them."""
        head = self.store.head()
        phrases = query_phrases(queries)
        asked = phrases.select("phrase").distinct().select("phrase", F.size("phrase").alias("k"), F.posexplode("phrase").alias("i", "token"))
        asked = written(asked.withColumn("bucket", bucket(F.col("token"))), "fts-asked")
        folders = sorted(r.bucket for r in asked.select("bucket").distinct().collect())  # BUCKETS at most
        # The asked tokens are a query set: other postings of their folders end where they are read.
        found = self._live(self.store.table("fts_postings", head).where(F.col("bucket").isin(folders)).join(F.broadcast(asked.select("phrase", "k", "i", "token")), "token"), head)
        one = found.where("k = 1").select("phrase", "id", "length", F.size("places").alias("f"))
        starts = found.where("k > 1").select("phrase", "k", "id", "length", "i", F.explode("places").alias("place")).withColumn("start", F.col("place") - F.col("i"))
        whole = starts.groupBy("phrase", "k", "id", "length", "start").agg(F.count("*").alias("n")).where("n = k")
        postings = one.union(whole.groupBy("phrase", "id", "length").agg(F.count("*").cast("int").alias("f")))
        stats = self.store.table("fts_stats", head).agg(F.coalesce(F.sum("documents"), F.lit(0)).cast("double").alias("rows"), (F.sum("words") / F.sum("documents")).alias("mean"))
        return weighted(written(postings, "fts-postings"), stats, phrases)

    def _live(self, rows: DataFrame, head) -> DataFrame:
        if not head.tables.get("fts_removed"):
            return rows
        # Not an anti join: Spark would move that below the join with the asked tokens, and shuffle all postings of their folders.
        gone = self.store.table("fts_removed", head).select(F.col("id").alias("_id"), "removed")
        return rows.join(gone, (F.col("id") == F.col("_id")) & (F.col("removed") > F.col("added")), "left").where("_id is null").drop("_id", "removed")

    def _dealt(self, postings: DataFrame, words: int, at: int | None = None) -> DataFrame:
        """In order for the folders, ``added`` at ``at``. What follows from the rest of a row isn't shuffled with it."""
        if words < LEAST_WORDS:
            met = postings.repartition(bucket(F.col("token")), F.pmod(F.xxhash64("id"), F.lit(SALT)))
        else:
            # As many tasks as their sorts fit into memory; a token's postings go to each of a bucket's.
            salts = -(-words // (BUCKETS * TASK_WORDS))
            met = postings.repartitionById(BUCKETS * salts, (bucket(F.col("token")) * salts + F.pmod(F.xxhash64("id"), F.lit(salts))).cast("int"))
        own = met.withColumns({"bucket": bucket(F.col("token"))} | ({} if at is None else {"added": F.lit(at).cast("long")}))
        return own.sortWithinPartitions("bucket", "token").select("token", "id", "length", "places", "added", "bucket")

    def _merge(self) -> None:
        """Segments of one size class, if there are FEW, become one without what was removed since; then the next class."""
        while True:
            head = self.store.head()
            classes: dict[int, list[str]] = {}
            for part in head.tables.get("fts_postings", []):
                classes.setdefault(int(math.log(max(self.store.part_size(part), 1 << 16), SIZES)), []).append(part)
            full = next((parts for _, parts in sorted(classes.items()) if len(parts) >= FEW), None)
            if full is None:
                return
            rows = self._live(reduce(DataFrame.unionByName, [self.store.part("fts_postings", p) for p in full]), head)
            words = self.store.table("fts_stats", head).where("words > 0").agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()["words"]
            self.store.commit({"fts_postings": self._dealt(rows, words)}, base=head, replaces={"fts_postings": full})
