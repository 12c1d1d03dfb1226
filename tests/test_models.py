"""Entities as they are found or made, inferences, and the pieces around models."""

import pytest
from pyspark.sql import functions as F

from mnemolake.operators import digest as D
from mnemolake.operators import entities as N


def store(spark):
    rows = [("1", "person", "Ann Lee", "ann lee", False), ("2", "Work Place", "Red Hall", "red hall", False), ("3", "city", "U_lm", "u_lm", False), ("4", "city", "U-lm", "u-lm", False)]
    return spark.createDataFrame(rows, "id string, type string, name string, canonical_name string, is_self boolean")


def test_find_or_create(spark):
    rows = [("a", "ANN LEE ", "person", 1), ("b", "ann-lee", "person", 2), ("c", "red_hall", "work-place", 3), ("d", "Ann_Lee", "author", 4), ("e", "New One", "thing", 6), ("f", "new-one", "thing", 5), ("g", "u lm", "city", 7)]
    mentions = spark.createDataFrame(rows, "mention_id string, name string, type string, position int")
    got, new = N.find_or_create(mentions, store(spark))
    by = {r.mention_id: r for r in got.collect()}
    assert by["a"].entity_id == by["b"].entity_id == "1" and by["c"].entity_id == "2" and by["c"].respelled
    assert by["e"].entity_id == by["f"].entity_id and by["e"].created and by["g"].created
    assert {(r.type, r.name) for r in new.collect()} == {("author", "Ann Lee"), ("thing", "new-one"), ("city", "u lm")}
    spelled = N.with_spellings(store(spark).withColumn("spellings", F.lit(None).cast("array<string>")), got)
    assert {r.id: r.spellings for r in spelled.collect()}["2"] == ["work-place"]


def test_self_and_speakers(spark):
    e = N.with_self(store(spark), "Me", "0")
    assert e.where("is_self").count() == 1 and N.with_self(e, "Other", "9").where("is_self").first().id == "0"
    facts = spark.createDataFrame([("f", "Ann Lee", "user"), ("g", None, "user"), ("h", "Nobody", "user"), ("i", None, "assistant")], "id string, speaker string, speaker_role string")
    assert {(r.fact_id, r.entity_id) for r in N.uttered(facts, e).collect()} == {("f", "1"), ("g", "0")}


def test_inferences(spark):
    h = spark.createDataFrame([("a", "x", ["2", "1"]), ("b", "y", ["1"]), ("c", "z", None)], "id string, hypothesis string, entity_ids array<string>")
    evidence = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "absent")], "inference_id string, fact_id string")
    added = N.inferences_to_add(h, evidence, spark.createDataFrame([("f",)], "id string"))
    assert [r.id for r in added.collect()] == ["a"]
    now = F.lit("2024-01-01").cast("timestamp")
    pending = added.withColumn("validated_at", F.lit(None).cast("timestamp"))
    after, facts, pairs = N.validated(pending, spark.createDataFrame([("a", True)], "id string, confirmed boolean"), now)
    assert after.first().status == "confirmed" and facts.first().confidence == 0.5 and tuple(pairs.first()) == ("1", "2")
    with pytest.raises(Exception, match="judged before"):
        N.validated(after, spark.createDataFrame([("a", False)], "id string, confirmed boolean"), now)[0].collect()


def test_usage(spark):
    df = spark.createDataFrame([('{"input_tokens": 3, "cache_read_input_tokens": 4, "output_tokens": 1}',), ("{}",)], "u string")
    assert [tuple(r) for r in df.select(*D.usage_tokens(F.col("u"))).collect()] == [(7, 1), (None, None)]
    lines = spark.createDataFrame([("r", 1, '{"type": "result", "x": 1}'), ("r", 2, '{"type": "log"}'), ("s", 1, '{"a": 1}'), ("s", 2, "noise")], "run string, at int, line string")
    assert {r.run: r.line for r in D.last_result(lines).collect()} == {"r": '{"type": "result", "x": 1}', "s": '{"a": 1}'}


def test_replies():
    assert D.shape_extract('```json\n{"facts": [{"content": "a"}, {"content": " "}]}\n```') == [{"content": "a"}] and D.shape_extract("no") == []


def test_texts_and_settings():
    assert D.briefing(["a"], None, [], ["b"]) == "## Key facts\n- a\n\n## Recent\n- b"
    assert [D.historic_selection(x) for x in ("all", "7d", "200", "no")] == [{"kind": "all"}, {"kind": "days", "n": 7}, {"kind": "limit", "n": 200}, None]
    assert D.token_budget({"cli": {"day": "1.5k"}}) == {"cli": {"day": 1500}}
    for bad in ("10M", {"cli": {"day": "3MB"}}, {"cli": {"year": 1}}):
        with pytest.raises(ValueError):
            D.token_budget(bad)
    assert D.merged({"a": {"b": 1, "c": [1]}, "d": 1}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}, "d": 1}
