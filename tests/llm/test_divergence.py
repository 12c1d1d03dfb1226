"""Source divergence against a plain count, with nulls, ties, repeated rows, long texts and clashing columns."""

import random
import re
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from mnemolake.llm import common, divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows):
    """(lang, source, part, item) -> (value, rank), term by term over all kept terms."""
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    out = {}
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= 10)
        counts = {s: Counter(t for d in docs if d[:2] == (lang, s) for t in d[2]) for s in {d[1] for d in docs if d[0] == lang}}
        whole = sum(counts.values(), Counter())

        def shares(c):
            size = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (size + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out[lang, s, part, item] = (value, rank)
    return out


def got(df):
    rows = df.collect()
    found = {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in rows}
    assert len(found) == len(rows)
    return found


def rows_of(seed, n=160):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma2x", "Éclair", "漢字", "delta", "x", "ZZ", "rare" + str(seed)]
    rows = [(i, " ".join(rng.choices(words[: 5 + i % 5], k=rng.randrange(30))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]
    return rows + [(1, None, "en", "empty"), (2, "", "xx", "only"), (3, "word", "xx", None), (None, "alpha beta", "en", "b"), *[rows[0]] * 12]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_counts(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"term": F.lit(1), "n": F.lit("x"), "value": F.lit(None).cast("int"), "rank": F.lit(2), "p": F.lit(3), "item": F.lit(4)})
    assert got(divergence.audit(df)) == brute(rows)


def test_groups_without_kept_terms_have_zero_distances(spark):
    rows = [(i, "few words", "en", s) for i, s in enumerate("abc")]
    assert got(divergence.audit(spark.createDataFrame(rows, SCHEMA))) == {("en", s, "pair", o): (0, 1 + sorted(set("abc") - {s}).index(o)) for s, o in product("abc", "abc") if s != o}
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_and_flushes_change_nothing(spark, monkeypatch):
    """A text above a slice, and words of which tasks hold few at a time."""
    rng = random.Random(5)
    long = " ".join(rng.choices(["alpha", "beta", "Épsilon", "漢" * 9], k=120_000))
    assert len(long.encode()) > common.SLICE_BYTES
    rows = [(i, t, "en", s) for i, (t, s) in enumerate([(long, "a"), (long[: len(long) // 3], "b"), *[("alpha beta gamma", "c")] * 12])]
    assert got(divergence.audit(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_shares_beyond_64_bits(spark):
    row = spark.range(1).select(divergence._share(F.lit(10**11), F.lit(3 * 10**11), F.lit(5)).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**11 + 2) // (3 * 10**11 + 10)


def test_words_of_pieces_are_the_whole_text_s():
    split, text = common.Splitter(common.LETTER_WORDS), ("Ab-ç " * 300_000).encode()
    words = [w for piece in split.pieces(text) for w in piece]
    assert words == [b"ab", "ç".encode()] * 300_000
    assert list(split.pieces(b"")) == []
