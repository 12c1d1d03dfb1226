"""The index on disk against scoring all texts, after inserts, removals and merges; what a search reads."""

import random

from pyspark.sql import functions as F

from mnemolake.operators import search as R
from mnemolake.operators import textindex as X
from mnemolake.store import Store

WORDS = ["than", "thé", "of", "the", "tea", "work", "x1", "Über", "b", "b"]
ASKED = [("a", "than"), ("b", "TEA work"), ("c", "zqzq"), ("d", "of-the"), ("e", "b-b-b tea"), ("f", "the of-the"), ("g", '"" - ')]


def corpus(spark, rng, ids):
    line = lambda: " ".join(rng.choices(WORDS, k=rng.randrange(12)))
    return spark.createDataFrame([(f"i{i}", line() if i % 9 else None, rng.choice(["tea", None, "of"])) for i in ids], "id string, content string, domain string")


def shown(rows):
    return sorted((r.query_id, r.id, round(r.score, 9)) for r in rows.collect())


def test_equals_scoring_all_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "FEW", 3)
    rng = random.Random(6)
    index = X.TextIndex(Store(spark, f"file://{tmp_path}/s"))
    asked = spark.createDataFrame(ASKED, "query_id string, query string")
    assert shown(index.search(asked)) == []
    live = None
    for step in range(5):
        new = corpus(spark, rng, range(40 * step, 40 * step + 40))
        index.add(new, "id", ["content", "domain"])
        live = new if live is None else live.union(new)
        if step in (1, 3):
            gone = live.where(F.abs(F.xxhash64("id")) % 3 == 0).select("id").union(spark.createDataFrame([("unknown",)], "id string"))
            index.remove(gone, "id")
            live = live.join(gone, "id", "left_anti")
        if step == 3:
            # A document that comes back with another text.
            back = spark.createDataFrame([("i1", "than than tea work of the", "b")], "id string, content string, domain string")
            index.remove(back, "id")
            index.add(back, "id", ["content", "domain"])
            live = live.where("id <> 'i1'").union(back)
        assert shown(index.search(asked)) == shown(R.bm25(R.indexed(live, "id", ["content", "domain"]), asked)), step
    assert len(index.store.head().tables["fts_postings"]) < 5
    # A removal of everything leaves nothing to find.
    index.remove(live, "id")
    assert shown(index.search(asked)) == []


def test_a_search_reads_the_asked_folders_alone(spark, tmp_path):
    rng = random.Random(7)
    index = X.TextIndex(Store(spark, f"file://{tmp_path}/s"))
    index.add(corpus(spark, rng, range(60)), "id", ["content", "domain"])
    want = spark.createDataFrame([("tea",)], "t string").select(X.bucket(F.col("t"))).first()[0]
    rows = index.store.table("fts_postings").where(F.col("bucket").isin([want]))
    files = {f.split("bucket=")[1].split("/")[0] for f in rows.inputFiles()}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    read = [r[0] for r in rows.select(F.input_file_name()).distinct().collect()]
    assert read and all(f"bucket={want}/" in f for f in read) and len(files) > 1


def test_other_postings_of_a_folder_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Postings are dealt by a stated number of tasks from so many words on, and none that isn't asked goes through an exchange."""
    monkeypatch.setattr(X, "LEAST_WORDS", 1)
    monkeypatch.setattr(X, "TASK_WORDS", 2)
    rng = random.Random(8)
    index = X.TextIndex(Store(spark, f"file://{tmp_path}/s"))
    new = corpus(spark, rng, range(90))
    index.add(new, "id", ["content", "domain"])
    parts = index.store.head().tables["fts_postings"]
    files = index.store.part("fts_postings", parts[0]).inputFiles()
    assert len(files) > len({f.split("bucket=")[1].split("/")[0] for f in files})
    asked = spark.createDataFrame(ASKED, "query_id string, query string")
    assert shown(index.search(asked)) == shown(R.bm25(R.indexed(new, "id", ["content", "domain"]), asked))
    plan = X._postings(R.indexed(new, "id", ["content"])).select("token")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
