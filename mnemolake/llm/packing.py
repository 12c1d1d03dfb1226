"""Packing of token pieces into sequences by a configuration linear program over the length histogram.

The program's variables are configurations (multisets of lengths that fit a sequence); each length must be covered as
often as it occurs. Multiplicative weights raise the price of lengths that are covered least, and a bounded knapsack
by dynamic programming finds the configurations worth most at the present prices, which are taken in whole amounts, until
they cover all but a small share of the tokens. What is left is placed best fit, longest first. All of this sees only
the histogram (at most ``capacity`` numbers), whatever the number of documents.

Pieces find their places without a global sort: a piece's rank among those of its length is its rank in its task plus
the counts of earlier tasks, and the plan maps ranges of ranks to sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import slices, trim, written
from mnemolake.llm.tokens import share_vocabulary, worker_encoder

CAPACITY, END_ID = 2048, 0
#: Rounds of multiplicative weights, and the step.
ROUNDS, STEP = 120, 0.5
#: A configuration is taken whose worth is within this share of the best one's; the program stops when this share of the
#: tokens is left; large lengths are worth more than in proportion, by this power.
NEAR, TOLERANCE, LARGE = 0.005, 0.005, 0.05


def _table(capacity: int, sizes: np.ndarray, value: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """The exact DP of a bounded knapsack: the greatest value within each room, and how it comes about.

    Multiplicities are split in powers of two, so that each copy count up to ``most`` is reachable: ``items`` has
    (index of the size, copies). ``last[i, c]`` is the last of the first i items that room c takes, or -1.
    """
    items: list[tuple[int, int]] = []
    for i, m in enumerate(np.minimum(most, capacity // sizes).tolist()):
        k = 1
        while m > 0:
            k = min(k, m)
            items.append((i, k))
            m, k = m - k, 2 * k
    best = np.zeros(capacity + 1)
    last = np.full((len(items) + 1, capacity + 1), -1, np.int16 if len(items) < 1 << 15 else np.int32)
    for j, (i, k) in enumerate(items):
        w, v = int(sizes[i]) * k, float(value[i]) * k
        with_ = best[: capacity + 1 - w] + v
        better = with_ > best[w:] + 1e-12
        last[j + 1] = last[j]
        last[j + 1, w:][better] = j
        np.copyto(best[w:], with_, where=better)
    return best, items, last


def _trace(rooms: np.ndarray, sizes: np.ndarray, items: list[tuple[int, int]], last: np.ndarray) -> list[dict[int, int]]:
    """For each room the multiset {index: copies} of greatest value."""
    index, copies = (np.array(x, np.int64) for x in zip(*items)) if items else (np.zeros(0, np.int64),) * 2
    out: list[dict[int, int]] = [{} for _ in rooms]
    room, upto, at = rooms.astype(np.int64), np.full(len(rooms), len(items)), np.arange(len(rooms))
    while len(at):
        j = last[upto, room].astype(np.int64)
        on = j >= 0
        j, room, at = j[on], room[on], at[on]
        for n, i, k in zip(at.tolist(), index[j].tolist(), copies[j].tolist()):
            out[n][i] = out[n].get(i, 0) + k
        room, upto = room - sizes[index[j]] * copies[j], j
    return out


def knapsack(capacity: int, sizes: np.ndarray, value: np.ndarray, most: np.ndarray) -> dict[int, int]:
    """The multiset of ``sizes`` (each at most ``most`` times) within ``capacity`` of greatest value."""
    best, items, last = _table(capacity, sizes, value, most)
    return {int(sizes[i]): k for i, k in _trace(np.array([best.argmax()]), sizes, items, last)[0].items()}


def covering(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Configurations and whole amounts that cover all but TOLERANCE of ``counts``, by multiplicative weights.

    A round prices all lengths by one knapsack table. From it come, for each length, the best configuration with it;
    those within NEAR of the best of all are taken, in whole amounts, so that no length is covered by more than its part of
    the round. After ``rounds`` the parts are all that is left, so each further round halves what some length has left.
    """
    need, left = counts.astype(float), counts.astype(np.int64).copy()
    rest = TOLERANCE * float((sizes * counts).sum())
    found: dict[tuple, int] = {}
    r = 0
    while float((sizes * left).sum()) > rest:
        own = np.flatnonzero(left)
        # What a unit of a length is worth: its size, raised by how far its covering lags behind.
        lag = left[own] / need[own]
        price = sizes[own] * np.exp(STEP * (lag - lag.max())) * (sizes[own] / capacity) ** LARGE
        best, items, last = _table(capacity, sizes[own], price, left[own])
        worth = price + best[capacity - sizes[own]]
        order = np.argsort(-worth, kind="stable")
        order = order[worth[order] >= (1 - NEAR) * worth[order[0]]]
        part = -(-left[own] // max(1, rounds - r))
        taken = np.zeros(len(own), np.int64)
        for n, config in zip(order.tolist(), _trace(capacity - sizes[own][order], sizes[own], items, last)):
            config[n] = min(config.get(n, 0) + 1, int(left[own[n]]))
            times = min(int(part[i] - taken[i]) // k for i, k in config.items())
            if not times and not taken.any():
                times = 1
            if times <= 0:
                continue
            for i, k in config.items():
                taken[i] += k * times
            key = tuple(sorted((int(sizes[own[i]]), k) for i, k in config.items()))
            found[key] = found.get(key, 0) + times
        left[own] -= taken
        r += 1
    return [(dict(key), times) for key, times in found.items()]


@dataclass
class Plan:
    """Sequences by configuration: ``runs`` has (first sequence, number of sequences, lengths in order)."""

    capacity: int
    runs: list[tuple[int, int, list[int]]] = field(default_factory=list)
    count: int = 0

    def add(self, config: dict[int, int], times: int) -> None:
        if times > 0:
            self.runs.append((self.count, times, [s for s in sorted(config, reverse=True) for _ in range(config[s])]))
            self.count += times

    def ranges(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: the first rank of each range (ascending), its first sequence, its place in them."""
        at: dict[int, int] = {}
        out: dict[int, list[tuple[int, int, int]]] = {}
        for first, times, lengths in self.runs:
            place = 0
            for s in lengths:
                out.setdefault(s, []).append((at.get(s, 0), first, place))
                at[s] = at.get(s, 0) + times
                place += s
        return {s: tuple(np.array(x, np.int64) for x in zip(*rows)) for s, rows in out.items()}


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """Pack ``histogram`` (length: count; lengths from 1 to ``capacity``).

    The program covers all but TOLERANCE of the tokens in whole amounts; the rest is placed best fit, into what room these leave and
    new sequences.
    """
    left = {int(s): int(n) for s, n in histogram.items() if n > 0}
    out = Plan(capacity)
    if full := left.pop(capacity, 0):
        out.add({capacity: 1}, full)
    sizes = np.array(sorted(left, reverse=True), np.int64)
    made = covering(sizes, np.array([left[int(s)] for s in sizes], np.int64), capacity, rounds)
    for config, times in made:
        for s, k in config.items():
            left[s] -= k * times
    for config, times in best_fit(left, capacity, made):
        out.add(config, times)
    return out


def best_fit(counts: dict[int, int], capacity: int, begun: list[tuple[dict[int, int], int]] | None = None) -> list[tuple[dict[int, int], int]]:
    """Longest first, each into the fullest sequences with room for it (of ``begun``, too); equal ones are handled as one."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}  # room: sequences that have it
    rooms: list[int] = []
    for config, times in begun or []:
        _open(open_, rooms, capacity - sum(s * k for s, k in config.items()), config, times)
    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n > 0:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                config, times = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
                k = min(room // s, n)
            else:
                room, config, k = capacity, {}, min(capacity // s, n)
                times = n // k
            used = min(times, n // k)
            if used < times:
                _open(open_, rooms, room, config, times - used)
            n -= used * k
            _open(open_, rooms, room - k * s, config | {s: config.get(s, 0) + k}, used)
    return [x for group in open_.values() for x in group]


def _open(open_: dict, rooms: list[int], room: int, config: dict[int, int], times: int) -> None:
    if room not in open_:
        open_[room] = []
        if room:
            insort(rooms, room)
    open_[room].append((config, times))


#: Rows of the pieces, before and after they have places.
PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long"


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents with, for each, its task and its rank among pieces of its length there (task, nth)."""
    shared = share_vocabulary(docs.sparkSession, path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task = worker_encoder(shared, 1 << 22, 4096), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            text = batch.column(1)
            for a, b in slices([x.as_py() or 0 for x in pc.binary_length(text)]):
                said = [(x or b"").decode("utf-8", "replace") for x in text.slice(a, b - a).to_pylist()]
                ids, first = encoder.batch(said)
                rows: list[tuple] = []
                for i in range(len(said)):
                    own = np.append(ids[first[i] : first[i + 1]], end_id).astype("<u4")
                    head = len(own) % capacity or capacity
                    cuts = [0, *range(head, len(own) + 1, capacity)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((i, k, x, y - x, zlib.crc32(own[x:y]), seen[y - x]))
                        seen[y - x] += 1
                at, piece, start, length, crc, nth = (np.array(c, np.int64) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(at), task, np.int32)), pa.array(nth)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])
        trim()

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, PIECES.format(kind=kind))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, sequence_id, offset), one for each piece.

    A document is its ids and then ``end_id``; null and empty texts are that one id. Longer documents are cut so that
    only the first piece is shorter than ``capacity``. Repeated rows are documents of their own; null ids stay. An
    empty table gives none; other columns are ignored. Pieces are written once to the shared folder; the texts are
    read once.
    """
    from pyspark.sql import Window

    spark = docs.sparkSession
    pieces = written(cut(docs, path, capacity, end_id, id_col, text_col), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = written(counts, "piece-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    made = plan(histogram, capacity, rounds)
    ranges = spark.sparkContext.broadcast(made.ranges())
    # Where each task's ranks of a length begin: one row for each task and length, which grow with the tasks, so no broadcast.
    begins = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).alias("begin"))
    placed = pieces.join(begins.hint("merge"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.coalesce("begin", F.lit(0))).alias("rank"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length):
                own = np.flatnonzero(length == s)
                low, first, place = ranges.value[int(s)]
                at = np.searchsorted(low, rank[own], "right") - 1
                sequence[own], offset[own] = first[at] + rank[own] - low[at], place[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return placed.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
