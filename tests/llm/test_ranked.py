"""Tiered search against scoring every document, with nulls, ties, repeated rows, long texts and clashing columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake.llm import common, ranked

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=50):
    """Sorted rows (item_id, rank, doc_id, score)."""
    of = [(i, Counter(words(t))) for i, t in docs]
    n = [sum(c.values()) for _, c in of]
    size, total = sum(1 for x in n if x), sum(n)
    df = Counter(t for _, c in of for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, c), length in zip(of, n):
            score = 0
            for t in set(words(text)) & set(c):
                m = 50 + 50 * length * size // total
                score += math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score:
                found.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if null else doc, -score) for rank, (score, null, doc) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    docs = [(i * 3, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 40, 300])))) for i in range(n)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 6, 30])))) for i in range(30)]
    return docs, items


def frames(spark, docs, items):
    clash = {"row": F.lit(1), "terms": F.lit("x"), "n": F.lit(None).cast("int"), "score": F.lit(2), "rank": F.lit(3), "segment": F.lit(4), "tier": F.lit(5)}
    return spark.createDataFrame(docs, "doc_id long, text string").withColumns(clash), spark.createDataFrame(items, "item_id long, text string").withColumns(clash)


@pytest.mark.parametrize("shares, fewest", [((0.02, 0.2), 400), ((0.05, 0.3), 20)])
def test_equals_scoring_everything(spark, monkeypatch, shares, fewest):
    """With all in one tier, and with tiers that some items are proven at and some fall through."""
    monkeypatch.setattr(ranked, "SHARES", shares)
    monkeypatch.setattr(ranked, "FEWEST", fewest)
    docs, items = corpus(1)
    found = ranked.search(*frames(spark, docs, items), top=5)
    assert got(found) == brute(docs, items, 5)
    tiers = {r.tier for r in found.select("tier").distinct().collect()}
    assert fewest == 400 or len(tiers) > 1, tiers


def test_odd_rows(spark):
    """Nulls, no terms, ties in every place, repeated rows, a text above a slice, case and non-ASCII words."""
    rng = random.Random(3)
    long = " ".join(rng.choices(["alpha", "BETA", "漢字"], k=150_000))
    assert len(long.encode()) > common.SLICE_BYTES
    docs = [(None, "alpha beta"), (7, None), (8, ""), (9, " .,; "), (2, long), *[(i, "Alpha beta9 é") for i in range(100, 40, -1)], (50, "Alpha beta9 é"), (-4, "ALPHA gamma")]
    items = [(1, "alpha ALPHA beta9"), (None, "é gamma 漢字"), (1, "alpha ALPHA beta9"), (2, None), (3, "unknown"), (4, "?!")]
    assert got(ranked.search(*frames(spark, docs, items))) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(1, 5)
    assert got(ranked.search(*frames(spark, [], items))) == []
    assert got(ranked.search(*frames(spark, docs, []))) == []
    assert got(ranked.search(*frames(spark, [(1, None)], items))) == []


def test_blocks_of_items_are_one_search(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 7)
    docs, items = corpus(2, 60)
    assert got(ranked.search(*frames(spark, docs, items[:15]), top=9)) == brute(docs, items[:15], 9)


def test_many_contributions_are_added_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    block = ranked.Block.of([(10, [0, 1]), (11, [1, 2, 3]), (12, [])], 5)
    segment = {"docs": np.arange(4), "term0": rng.integers(0, 5, 50), "doc0": rng.integers(0, 4, 50), "impact0": rng.integers(1, 99, 50)}
    want = np.zeros((4, 3), np.int64)
    for t, d, v in zip(*(segment[c] for c in ("term0", "doc0", "impact0"))):
        for i, own in enumerate(([0, 1], [1, 2, 3], [])):
            want[d, i] += v * (t in own)
    for most in (1, 3, 1000):
        monkeypatch.setattr(ranked, "AT_ONCE", most)
        assert (ranked._summed(segment, 1, block, lambda t, v: [v], 1)[0] == want).all()


def test_upper_tiers_read_their_columns_alone(spark):
    docs, _ = frames(spark, *corpus(4, 30))
    index, _ = ranked.build(docs.select("doc_id", "text"), {b"w1": 0, b"w2": 1})
    plan = index.select("docs", "term0", "doc0", "impact0")._jdf.queryExecution().executedPlan().toString()
    assert "impact0" in plan and "impact1" not in plan and "impact2" not in plan
