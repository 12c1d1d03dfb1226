"""Language identification against plain counting and ranking: ties, repeated rows, a text above a segment, empty tables."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from mnemolake.llm import language

SIZE = 40


def code(gram):
    """The order of n-grams that are equally frequent."""
    points = [0 if c == " " else ord(c) for c in gram]
    value = 0
    for p in points:
        value = (value << 21) | p
    return value | 1 << 62 if len(gram) == 1 else value ^ 1 << 61 if len(gram) == 2 else value


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for i, w in enumerate(words):
        padded = f" {w} "
        out.update(w)
        out.update(padded[k : k + 2] for k in range(len(padded) - 1))
        out.update(padded[k : k + 3] for k in range(len(padded) - 2))
    return out


def top(counts):
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:SIZE]


def brute(train, texts):
    profiles = {}
    for lang in sorted({x for x, _ in train}):
        profiles[lang] = top(sum((grams(t or "") for x, t in train if x == lang), Counter()))
    out = []
    for text in texts:
        own = top(grams(text or ""))
        if not own:
            out.append(("und", 0.0, 1.0))
            continue
        far = [sum(abs(p.index(g) - i) if g in p else SIZE for i, g in enumerate(own)) / (SIZE * len(own)) for p in profiles.values()]
        best = far.index(min(far))
        out.append((list(profiles)[best], 1 / sum(math.exp((far[best] - d) * 40) for d in far), far[best]))
    return out


def test_equals_plain_profiles(spark):
    rng = random.Random(11)
    pools = {"en": "thequickbrown", "de": "derschnelleßü", "xx": "漢字かなабв"}
    line = lambda lang, n: " ".join("".join(rng.choices(pools[lang], k=rng.randrange(1, 6))) for _ in range(n))
    rows = [(i, line(lang, rng.choice([1, 3, 40])) + rng.choice(["", " 12!", "\n"]), lang, "s") for i, lang in enumerate(["en", "de", "xx"] * 30)]
    rows += [rows[4]] * 3 + [(500, None, "en", "s"), (501, "  12 ?", "de", "s"), (502, "THE Über", None, "s"), (503, "don't", "en", "s")]
    # Longer than a segment, with no blank near its end in one place.
    rows.append((504, line("de", 300_000) + "e" * 50, None, "s"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"code": F.lit(1), "n": F.lit("x"), "rank": F.lit(2)}).repartition(3)
    assert len(rows[-1][1]) > language.SEGMENT
    profiles = language.learn(df, F.col("doc_id") % 2 == 0, size=SIZE)
    got = sorted(((r.doc_id, r.lang_pred, round(r.score, 9), round(r.distance, 9)) for r in language.identify(df, profiles).collect()))
    want = brute([(lang, t) for i, t, lang, _ in rows if i % 2 == 0 and lang], [t for _, t, _, _ in rows])
    assert got == sorted((r[0], w[0], round(w[1], 9), round(w[2], 9)) for r, w in zip(rows, want))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert language.identify(none, language.learn(none, F.lit(True))).count() == 0
