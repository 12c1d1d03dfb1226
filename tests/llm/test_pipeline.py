"""The pipeline's stages take effect, and pass on whole rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    words = ["the", "and", "with", "that", "there", "where", "other", "mother", "weather", "letter", "better", "water", "never", "ever", "paper", "tower", "river", "summer", "winter", "number"]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passage = prose(40)
    rows = [(i, prose(60), "en", "s") for i in range(20)]
    rows += [(20, rows[3][1], "en", "s"), (21, rows[4][1] + " end", "en", "s"), (22, "12345 !!!", "en", "s"), (23, None, "en", "s"), (24, prose(5) + " " + passage, "en", "s"), (25, prose(30) + " mail a@b.example", "en", "s")]
    sf = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(os.path.join(sf, "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(os.path.join(sf, "benchmark.parquet"))
    now, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        kept[name] = {r.doc_id for r in now.select("doc_id").collect()}
        if name != "packing":
            assert now.columns == docs.columns
    everything = set(range(26))
    assert kept["language_id"] == everything - {22, 23}
    assert kept["near_duplicates"] == everything - {20, 21, 22, 23}
    assert kept["decontamination"] == everything - {20, 21, 22, 23, 24}
    assert kept["personal_data"] == kept["packing"] == kept["decontamination"]
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == 21


def odd_documents(spark, rng):
    words = ["the", "and", "with", "that", "there", "where", "other", "mother", "weather", "letter", "better", "water"]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, prose(60), "en", "s") for i in range(30)]
    rows += [rows[2], rows[2], (2, rows[3][1], "en", "s"), (None, prose(50), "en", None), (None, rows[5][1], "en", "s"), (None, None, None, None), (40, None, "en", "s"), (41, "", "en", "s"), (42, prose(150_000), None, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.length("text").cast("long"), "lang_pred": F.lit(1), "kept": F.lit("x"), "node": F.lit(None).cast("int"), "sha": F.lit(2), "piece": F.lit(3)})


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, other columns; then an empty table and an empty benchmark."""
    docs, sf = odd_documents(spark, random.Random(3)), str(tmp_path)
    bench = spark.createDataFrame([(None, None), (1, "zz " * 13)], "item_id long, text string")
    bench.write.parquet(os.path.join(sf, "benchmark.parquet"))
    texts = lambda df: sorted((r.doc_id is None, r.doc_id or 0, len(r.text or "")) for r in df.select("doc_id", "text").collect())
    count, now = docs.count(), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == corpus_pipeline.COLUMNS
        if name == "language_id":
            assert texts(got) == [t for t in texts(docs) if t[2]]
        elif name == "near_duplicates":
            # One of id 2 (of two texts the one that no other group has), one without an id, and all texts without words.
            ids = [r.doc_id for r in got.select("doc_id").collect()]
            assert sorted(i for i in ids if i is not None and i not in (2, 3)) == [i for i in range(30) if i not in (2, 3)] + [40, 41, 42]
            assert ids.count(None) == 2 and ids.count(2) in (1, 2)
        else:
            assert got.count() == count
        now = stage(spark, now, sf)
    pieces = corpus_pipeline.packing(spark, docs, sf)
    assert pieces.where("start = 0 and piece = 0").count() == count and pieces.where("length > 2048").count() == 0
    assert now.count() > 25
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    spark.createDataFrame([], "item_id long, text string").write.parquet(os.path.join(sf, "none", "benchmark.parquet"))
    assert corpus_pipeline.decontamination(spark, docs, os.path.join(sf, "none")).count() == count


def test_gibberish_and_foreign_languages_go(spark):
    """sf0.1 has labelled documents in four languages; Latin gibberish, Polish and Italian are none of them."""
    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    rng = random.Random(2)
    noise = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(n))
    polish = "wszyscy ludzie rodzą się wolni i równi w swojej godności i prawach są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa"
    italian = "tutti gli esseri umani nascono liberi ed eguali in dignità e diritti essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza"
    labelled = spark.read.parquet(path).select(*corpus_pipeline.COLUMNS)
    added = spark.createDataFrame([(-i, t, None, "s") for i, t in enumerate([noise(20), noise(200), noise(2000), polish, italian], 1)], "doc_id long, text string, lang string, source string")
    docs = labelled.unionByName(added.withColumn("n_chars", F.length("text").cast(labelled.schema["n_chars"].dataType)))
    gone = docs.select("doc_id", "text").exceptAll(corpus_pipeline.language_id(spark, docs, "").select("doc_id", "text")).collect()
    assert {r.doc_id for r in gone if any(c.isalpha() for c in r.text or "")} == {-1, -2, -3, -4, -5}
