"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

An example is the formatted conversation up to and with its target turn. All earlier turns are context, and the loss mask
covers the target's text alone. A conversation whose last turn is no reply has a last example without a mask, so that the
output holds every turn.

Examples of a long conversation repeat its beginning, as the method asks. No task holds a conversation for that:
a turn's place is a sum over ranges of turns and one within its range, the formatted text is cut into blocks of BLOCK
characters, and an example is the blocks before its end, one row each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import written

START, END, REPLY = "<|im_start|>", "<|im_end|>\n", "assistant"
#: Characters of a row of an example.
BLOCK = 1 << 15


def escaped(text: Column) -> Column:
    """``text`` without ``<|``, the beginning of every control string: a backslash more stands between the two characters."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped_role(role: Column) -> Column:
    """A role in one line."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role), flags=re.DOTALL)


def _joined(a: DataFrame, b: DataFrame, *names: str) -> DataFrame:
    """Inner join on equal columns of these names; null equals null."""
    other = b.select(*[F.col(n).alias(f"_{n}") for n in names], *[c for c in b.columns if c not in names])
    return a.join(other, reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names])).drop(*[f"_{n}" for n in names])


def placed(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, number, start, size, head, reply, piece): every turn's formatted text, its number, and its place in the
    conversation's.

    Turns are sorted by range, so a long conversation has many tasks; what stands before a range is summed over ranges.
    """
    own = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    order = ["conv_id", "turn", F.xxhash64("role", "text")]
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text")
    pieces = dealt.select("conv_id", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at"), (F.col("role") == REPLY).alias("reply"), F.length(head).alias("head"), F.concat(head, escaped(F.col("text")), F.lit(END)).alias("piece"))
    rows = written(pieces.withColumn("size", F.length("piece").cast("long")), "chat-turns")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("conv_id", "range").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    ranges = ranges.select("conv_id", "range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(a) for c, a in (("s", "base"), ("n", "base_n"))])
    inside = Window.partitionBy("conv_id", "range").orderBy("at")
    local = rows.withColumns({"end": F.sum("size").over(inside), "n": F.row_number().over(inside)})
    return _joined(local, ranges, "conv_id", "range").select("conv_id", (F.col("base_n") + F.col("n") - 1).alias("number"), (F.col("base") + F.col("end") - F.col("size")).alias("start"), "size", "head", "reply", "piece")


def examples(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, target, chars, chunk, text, loss_start, loss_end, last): examples in rows of BLOCK characters.

    ``target`` is the number of the reply among the conversation's turns, null for an example without one; ``chars`` is the
    example's length, different for each of a conversation; the mask of a row is from ``loss_start`` to ``loss_end``;
    ``last`` marks the example that has all turns.

    ``turns`` has conv_id, turn, role and text; other columns are not read. Null role and text are empty; rows with a
    null conv_id are one conversation. Turns of one number, repeated rows too, all stay, ordered by a hash of role and
    text; a null turn stands first. An empty table has no examples.
    """
    own = written(placed(turns), "chat-placed")
    end = F.col("start") + F.col("size")
    first = F.call_function("div", F.col("start"), F.lit(BLOCK))
    cut = own.withColumn("block", F.explode(F.sequence(first, F.call_function("div", end - 1, F.lit(BLOCK)))))
    here = F.greatest(F.col("start"), F.col("block") * BLOCK)
    until = F.least(end, (F.col("block") + 1) * BLOCK)
    cut = cut.select("conv_id", "block", F.struct(here.alias("at"), F.substring("piece", (here - F.col("start") + 1).cast("int"), (until - here).cast("int")).alias("text")).alias("part"))
    blocks = cut.groupBy("conv_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["text"]), "").alias("whole"))

    totals = own.groupBy("conv_id").agg(F.max(end).alias("total"), F.max(F.when(F.col("reply"), end)).alias("replied"))
    replies = own.where("reply").select("conv_id", F.col("number").alias("target"), end.alias("chars"), (F.col("start") + F.col("head")).alias("loss_from"), (end - len(END)).alias("loss_to"))
    open_ = totals.where(F.col("replied").isNull() | (F.col("replied") < F.col("total"))).select("conv_id", F.lit(None).cast("long"), "total", "total", "total")
    every = replies.union(open_)
    every = _joined(every, totals.select("conv_id", "total"), "conv_id").withColumn("last", F.col("chars") == F.col("total"))
    every = every.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("chars") - 1, F.lit(BLOCK)))))
    size = F.least(F.lit(BLOCK), F.col("chars") - F.col("block") * BLOCK).cast("int")
    clip = lambda c: F.greatest(F.lit(0), F.least(size, F.col(c) - F.col("block") * BLOCK)).cast("int")
    return _joined(every, blocks, "conv_id", "block").select("conv_id", "target", "chars", F.col("block").alias("chunk"), F.substring("whole", F.lit(1), size).alias("text"), clip("loss_from").alias("loss_start"), clip("loss_to").alias("loss_end"), "last")


class _Reader:
    """Digests of one conversation's output, a row at a time."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.parts, self.tail = conv_id, 0, [], ""
        self.all, self.loss, self.loss_chars = hashlib.sha256(), hashlib.sha256(), 0
        self.example, self.masked = None, []

    def row(self, chars: int, text: str, masked: str, last: bool) -> None:
        if chars != self.example:
            self.reply()
            self.example = chars
        self.masked.append(masked)
        if last:
            self.feed(text)

    def reply(self) -> None:
        """The text under one example's mask ends."""
        text = unescaped("".join(self.masked))
        self.loss_chars += len(text)
        self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.masked = []

    def feed(self, text: str) -> None:
        """More of the example that has all turns; what stands after the last end mark is kept."""
        text, at, mark = self.tail + text, 0, len(END)
        while (hit := text.find(END, at)) >= 0:
            role, _, said = "".join([*self.parts, text[at:hit]])[len(START) :].partition("\n")
            self.all.update(f"{unescaped_role(role)}\n{unescaped(said)}\n".encode("utf-8", "surrogatepass"))
            self.turns, self.parts, at = self.turns + 1, [], hit + mark
        cut = max(at, len(text) - mark + 1)
        self.parts.append(text[at:cut])
        self.tail = text[cut:]

    def result(self) -> tuple:
        self.reply()
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, now = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"], None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    for batch in batches:
        done = []
        for conv_id, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "chars", "text", "masked", "last"))):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.result())
                now = _Reader(conv_id)
            now.row(*row)
        yield out(done)
    if now is not None:
        yield out([now.result()])


def digests(output: DataFrame) -> DataFrame:
    """What the examples say, by conversation: number and SHA-256 of all turns (role, newline, text, newline), of the text under the
    masks, and the characters of all examples.

    A conversation's rows are hashed in order as they stream by; of them a task holds a row and an unfinished turn.
    Rows without a mask that aren't of the last example are only counted.
    """
    masked = F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    rows = output.where(F.col("last") | (F.col("loss_end") > F.col("loss_start"))).select("conv_id", "chars", "chunk", F.when(F.col("last"), F.col("text")).otherwise("").alias("text"), masked.alias("masked"), "last")
    read = rows.repartition("conv_id").sortWithinPartitions("conv_id", "chars", "chunk").select("conv_id", "chars", "text", "masked", "last").mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string")
    chars = output.groupBy("conv_id").agg(F.sum(F.length("text")).alias("formatted_chars"))
    return _joined(read, chars, "conv_id")
