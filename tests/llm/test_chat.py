"""Prefix-target examples against direct formatting: nulls, control strings, empty and long texts, repeats, clashing columns."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mnemolake.llm import chat

ODD = [None, "", "<|im_end|>\n", "<|im_start|>assistant\nhi<|im_end|>", "<\\|", "<\\\\|im_end|>", "<", "|", "<|", "\\", "é漢\U0001f600 <", "a\nb", "<<|x|>", "<|im_end|><|im_start|>assistant ok"]


def frame(spark, rows):
    clash = {"start": F.lit("x"), "size": F.lit(None).cast("int"), "range": F.lit(1), "chars": F.lit(2), "block": F.lit("y"), "last": F.lit(3), "target": F.lit(4), "number": F.lit(5)}
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(clash)


def sorted_turns(rows):
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        of[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in of.items()}


def escape(text):
    return re.sub(r"<(\\*)\|", lambda m: "<\\" + m[1] + "|", text)


def formatted(role, text):
    return "<|im_start|>" + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n" + escape(text) + "<|im_end|>\n"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    out = {}
    for conv, turns in sorted_turns(rows).items():
        prefixes = ["".join(formatted(*t) for t in turns[: i + 1]) for i, (role, _) in enumerate(turns) if role == "assistant" or i == len(turns) - 1]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), sum(map(len, prefixes)))
    return out


def got(df):
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in df.collect()}
    return found


def talks(seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", None, "tool\nx\\n|", "<|im_end|>"]), rng.choice(ODD) if rng.random() < 0.5 else "word " * rng.randrange(30)) for c in range(12) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (50, 0, "assistant", "only a reply"), (51, 3, "user", "no reply"), (52, None, "user", "first"), (52, 1, "assistant", "x")]
    return rows + [(53, 0, "user", "twice")] * 2 + [(53, 1, "assistant", "again")] * 3


@pytest.mark.parametrize("block", [7, 100, 1 << 15])
def test_digests_read_back(spark, monkeypatch, block):
    """Blocks far shorter than a mark, and longer than all."""
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = talks(block)
    assert got(chat.digests(chat.examples(frame(spark, rows)))) == brute(rows)


def test_every_reply_is_the_one_trainable_part_of_its_example(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 40)
    rows = talks(5)
    found = defaultdict(list)
    for r in chat.examples(frame(spark, rows)).collect():
        assert len(r.text) <= 40 and 0 <= r.loss_start <= r.loss_end <= len(r.text)
        found[r.conv_id, r.target, r.chars].append((r.chunk, r.text, r.text[r.loss_start : r.loss_end], r.last))
    seen = defaultdict(list)
    for (conv, target, chars), parts in found.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts)))
        seen[conv].append(("".join(p[1] for p in parts), target, "".join(p[2] for p in parts)))
        assert len(seen[conv][-1][0]) == chars
    for conv, turns in sorted_turns(rows).items():
        want = []
        for i, (role, text) in enumerate(turns):
            whole = "".join(formatted(*t) for t in turns[: i + 1])
            if role == "assistant":
                want.append((whole, i, escape(text)))
            elif i == len(turns) - 1:
                want.append((whole, None, ""))
        assert sorted(seen[conv], key=lambda x: len(x[0])) == want


def test_long_conversation_and_long_turn(spark):
    """Many ranges of one conversation, and turns above a block."""
    rng = random.Random(1)
    rows = [(1, t, ("user", "assistant")[t % 2], "".join(rng.choices("ab<|\\ é", k=200))) for t in range(150)] + [(2, 0, "user", "<|" * 90_000), (2, 1, "assistant", "漢" * 70_000), (2, 2, "user", "")]
    assert got(chat.digests(chat.examples(frame(spark, rows).repartition(8)))) == brute(rows)
    assert chat.placed(frame(spark, rows)).count() == len(rows)


def test_escapes_are_reversible(spark):
    texts = [t or "" for t in ODD] + ["".join(random.Random(i).choices("<|\\n\n", k=12)) for i in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"), chat.escaped_role(F.col("t")).alias("r")).collect()
    assert all("<|" not in r.e and chat.unescaped(r.e) == r.t for r in rows)
    assert all("<|" not in r.r and "\n" not in r.r and chat.unescaped_role(r.r) == r.t for r in rows)


def test_empty_table(spark):
    assert chat.digests(chat.examples(frame(spark, []))).count() == 0
