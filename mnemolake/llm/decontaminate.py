"""Benchmark decontamination by suffix arrays over shards of the training text.

The benchmark (a query set) is cut into blocks of bounded size, each broadcast. A shard is a bounded run of documents
in a task. Its words become ids of the block's vocabulary (0: not in it), its suffix array is built over the
positions whose words are in the vocabulary, and every benchmark suffix that begins with a window is binary-searched in
it, suffixes with equal windows together. The range of suffixes that agree on the window's words are all its verbatim
places: they give the words that are hit and the items. A document's longest match is found in a suffix array of the hit
stretches and the items that hit: it is what a stretch's suffix has in common with the nearest suffix of an item. The
words of all places are compared with the benchmark's, as ids stand for 64-bit hashes. All of it is in proportion to the
words, however often they repeat.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import alnum_hasher, mix
from mnemolake.llm.tokens import map_texts

WINDOW = 13
#: Words of benchmark items in one broadcast block.
BLOCK_WORDS = 1 << 20
#: Columns of a document's longest match.
LONGEST = ("longest", "longest_item", "longest_item_word", "longest_word")
#: Fixed value: what separates words, on bytes (A-Z lower-cased first).
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # bytes.lower() changes A-Z only


@dataclass
class Block:
    """Benchmark items as ids of a vocabulary sorted by hash; ``start`` has each item's first word.

    ``seed`` is one under which all words of the block have different hashes; ``distinct`` are its windows, once known.
    """

    names: list[str]
    start: np.ndarray
    ids: np.ndarray
    vocabulary: np.ndarray
    spelled: list[bytes]
    seed: int
    distinct: Windows | None = None

    @classmethod
    def of(cls, items: list[tuple[str, bytes]], seed: int = 11) -> Block:
        texts = [t for _, t in items]
        flat = [w for t in texts for w in words(t)]
        while True:
            hashes, start = alnum_hasher(seed).texts(texts)
            vocabulary, one, ids = np.unique(hashes, return_index=True, return_inverse=True)
            spelled = [flat[i] for i in one]
            if all(spelled[i] == w for i, w in zip(ids, flat)):
                return cls([n for n, _ in items], start, ids.astype(np.int32) + 1, vocabulary, spelled, seed)
            seed += 1

    def shortest(self, window: int) -> int:
        """Words of the shortest window."""
        n = np.diff(self.start)
        return int(min(window, n[n > 0].min(initial=window)))

    def windows(self, window: int) -> Windows:
        n = np.diff(self.start)
        many = np.where(n >= window, n - window + 1, (n > 0).astype(np.int64))
        item = np.repeat(np.arange(len(n)), many)
        place = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many) + self.start[:-1][item]
        size = np.minimum(n, window)[item]
        name = named(self.ids, place, size)
        _, first, back = np.unique(name, return_index=True, return_inverse=True)
        both = np.unique(np.stack((back, item), 1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
        at = np.searchsorted(both[:, 0], np.arange(len(first) + 1))
        # Windows of the same items are one group: what they hit names each of these items once.
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(both[:, 1].astype(np.uint64)), at[:-1]) if len(first) else np.zeros(0, np.uint64)
        _, one, group = np.unique(np.stack((sums, np.diff(at).astype(np.uint64)), 1), axis=0, return_index=True, return_inverse=True)
        return Windows(place[first], size[first], group.ravel(), [both[at[i] : at[i + 1], 1] for i in one.tolist()])


@dataclass
class Windows:
    """The distinct windows: place in the block, words, and the group of items that have it."""

    place: np.ndarray
    size: np.ndarray
    group: np.ndarray
    items: list[np.ndarray]


def ranks(ids: np.ndarray, depth: int) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4 ... words (at most ``depth``) at every place; equal names are equal stretches, in their order.

    A stretch that runs over the end is like one that goes on with something smaller than all ids.
    """
    out, step = [np.unique(ids, return_inverse=True)[1].astype(np.int64)], 1
    while 2 * step <= depth:
        pair = out[-1] * (len(ids) + 1)
        pair[:-step] += out[-1][step:] + 1
        out.append(np.unique(pair, return_inverse=True)[1])
        step *= 2
    return out


def named(ids: np.ndarray, place: np.ndarray, size: np.ndarray, levels: list[np.ndarray] | None = None) -> np.ndarray:
    """A name for each stretch of ``size`` words from ``place``: equal names are equal stretches."""
    levels = ranks(ids, int(size.max(initial=1))) if levels is None else levels
    out, used = np.zeros(len(place), np.int64), 0
    for n in np.unique(size).tolist():
        own, k = size == n, n.bit_length() - 1
        pair = levels[k][place[own]] * (len(ids) + 1) + levels[k][place[own] + n - (1 << k)]
        distinct, back = np.unique(pair, return_inverse=True)
        out[own] = back + used
        used += len(distinct)
    return out


def common_words(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``a`` and ``b`` have in common, by names of ever shorter stretches."""
    out, n = np.zeros(len(a), np.int64), len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + out, b + out
        same = np.flatnonzero((x < n) & (y < n))
        same = same[levels[k][x[same]] == levels[k][y[same]]]
        out[same] += 1 << k
    return out


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``ids`` in the order of their suffixes by the first ``depth`` ids, by prefix doubling."""
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < depth and len(ids) > 1:
        pair = rank * (rank.max() + 2)
        pair[:-step] += rank[step:] + 1
        distinct, rank = np.unique(pair, return_inverse=True)
        if len(distinct) == len(ids):
            break
        step *= 2
    return np.argsort(rank, kind="stable")


def search(text: np.ndarray, order: np.ndarray, query: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query ``query[place : place + size]``, the range of ``order`` whose suffixes begin with it.

    All queries are searched together; ``text`` and ``query`` end in enough sentinels (-1) that no suffix runs out.
    """
    out = []
    for upper in (False, True):
        low, high = np.zeros(len(place), np.int64), np.full(len(place), len(order), np.int64)
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) // 2
            after = np.full(len(live), upper)  # equal: go on to the right for the upper end
            open_ = np.arange(len(live))
            for k in range(int(size.max(initial=0))):
                open_ = open_[size[live[open_]] > k]
                if not len(open_):
                    break
                a, b = text[order[mid[open_]] + k], query[place[live[open_]] + k]
                after[open_[a < b]] = True
                after[open_[a > b]] = False
                open_ = open_[a == b]
            low[live[after]] = mid[after] + 1
            high[live[~after]] = mid[~after]
            live = live[low[live] < high[live]]
        out.append(low)
    return out[0], out[1]


def longest_matches(text: np.ndarray, order: np.ndarray, query: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every suffix of every query item, the length of its longest verbatim match in ``text`` and one place of it.

    ``start`` has the items' first words and the end. A suffix's best match is beside its place in the array.
    """
    n = int(start[-1])
    room = np.repeat(start[1:], np.diff(start)) - np.arange(n)
    low, _ = search(text, order, query, np.arange(n), room)
    best, where = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for near in (low - 1, low):
        ok = np.flatnonzero((near >= 0) & (near < len(order)))
        at, k = order[near[ok]], np.zeros(len(ok), np.int64)
        live = np.arange(len(ok))
        while len(live):
            live = live[k[live] < room[ok[live]]]
            live = live[text[at[live] + k[live]] == query[ok[live] + k[live]]]
            k[live] += 1
        better = k > best[ok]
        best[ok[better]], where[ok[better]] = k[better], at[better]
    return best, where


class Shard:
    """Word ids of some documents, their suffix array, and the search of a block in it."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, block: Block, depth: int, least: int = 1):
        at = np.minimum(np.searchsorted(block.vocabulary, hashes), max(len(block.vocabulary) - 1, 0))
        ids = np.zeros(len(hashes), np.int32)
        if len(block.vocabulary):
            ids = np.where(block.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)
        # A document's end breaks matches, as a word outside the vocabulary does: only runs between breaks stay,
        # and of these the ones of ``least`` words at least, as no shorter match is asked for.
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        known = np.flatnonzero(ids)
        gap = np.ones(len(known), bool)
        gap[1:] = (np.diff(known) > 1) | (owner[known[1:]] != owner[known[:-1]])
        run = np.cumsum(gap) - 1
        known = known[(np.bincount(run) >= least)[run]] if len(known) else known
        gap = np.ones(len(known), bool)
        gap[1:] = (np.diff(known) > 1) | (owner[known[1:]] != owner[known[:-1]])
        shift = np.cumsum(gap) - 1
        spot = np.arange(len(known)) + shift
        self.text = np.full(len(known) + (int(shift[-1]) if len(known) else 0) + depth + 1, -1, np.int32)
        self.text[spot] = ids[known]
        self.back = np.full(len(self.text), -1, np.int64)
        self.back[spot] = known
        self.owner, self.ids = owner, ids
        order = suffix_array(self.text, depth)
        self.order = order[self.text[order] >= 0]


@dataclass
class Hits:
    """What a block has in a shard: hit words (booleans), distinct rows (document, item), and by document the longest
    match as rows (document, words, item, its word there, word of the document)."""

    covered: np.ndarray
    pairs: np.ndarray
    longest: np.ndarray


def hits(shard: Shard, block: Block, window: int) -> Hits:
    covered = np.zeros(len(shard.ids) + 1, np.int32)
    own = block.distinct or block.windows(window)
    nothing = Hits(covered[:-1] > 0, np.zeros((0, 2), np.int64), np.zeros((0, 5), np.int64))
    if not len(shard.order) or not len(own.place):
        return nothing
    query = np.append(block.ids, np.full(window + 1, -2, np.int32))
    low, high = search(shard.text, shard.order, query, own.place, own.size)
    found = np.flatnonzero(high > low)
    if not len(found):
        return nothing
    # A place has one distinct window of each size at most.
    count = (high - low)[found]
    rank = np.repeat(low[found], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at, which = shard.back[shard.order[rank]], np.repeat(found, count)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + own.size[which], -1)
    owner = shard.owner[at]
    least = np.array([x.min() for x in own.items])
    groups = np.unique(owner * len(own.items) + own.group[which])
    lists = [own.items[g] for g in (groups % len(own.items)).tolist()]
    pairs = np.unique(np.stack((np.repeat(groups // len(own.items), [len(x) for x in lists]), np.concatenate(lists)), 1), axis=0)
    long = own.size[which] == window
    best = _longest(shard, block, window, at[long], pairs)
    # Documents that only shorter items hit: their longest match is a whole item.
    short = np.flatnonzero(~long & ~np.isin(owner, best[:, 0]))
    if len(short):
        sort = short[np.lexsort((at[short], least[own.group[which[short]]], -own.size[which[short]], owner[short]))]
        sort = sort[np.unique(owner[sort], return_index=True)[1]]
        item = least[own.group[which[sort]]]
        best = np.concatenate((best, np.stack((owner[sort], own.size[which[sort]], item, np.zeros(len(sort), np.int64), at[sort]), 1)))
    return Hits(np.cumsum(covered)[:-1] > 0, pairs, best[np.argsort(best[:, 0])])


def _longest(shard: Shard, block: Block, window: int, at: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Rows of ``Hits.longest`` of the documents that windows of full length hit, at places ``at``."""
    if not len(at):
        return np.zeros((0, 5), np.int64)
    mark = np.zeros(len(shard.ids) + 1, np.int32)
    at = np.unique(at)
    mark[at] += 1
    np.add.at(mark, at + window, -1)
    # Stretches of these windows, of one document each, after the items that hit; each ends in a word of its own.
    inside = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
    owner = shard.owner[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (np.diff(inside) > 1) | (owner[1:] != owner[:-1])
    n = np.diff(block.start)
    items = np.unique(pairs[:, 1])
    items = items[n[items] >= window]
    words_ = np.concatenate([np.arange(block.start[i], block.start[i + 1]) for i in items.tolist()])
    item = np.repeat(items, n[items])
    run = np.cumsum(new) - 1
    spot_q = np.arange(len(words_)) + np.repeat(np.arange(len(items)), n[items])
    base = len(words_) + len(items)
    spot_t = base + np.arange(len(inside)) + run
    size = base + len(inside) + int(run[-1]) + 1
    text = -1 - np.arange(size)
    text[spot_q], text[spot_t] = block.ids[words_], shard.ids[inside]
    longest_run = int(np.diff(np.append(np.flatnonzero(new), len(inside))).max())
    depth = min(int(n[items].max()), longest_run)
    levels = ranks(text, 2 * depth)  # stretches longer than any match, so that the order is that of the suffixes
    order = np.argsort(levels[-1], kind="stable")
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    # The nearest suffix of an item on either side of each place.
    of_item = np.full(size, -1, np.int64)
    of_item[spot_q] = spot_q
    sorted_ = of_item[order]
    seen = np.where(sorted_ >= 0, np.arange(size), -1)
    before = np.maximum.accumulate(seen)
    after = np.minimum.accumulate(np.where(sorted_ >= 0, np.arange(size), size)[::-1])[::-1]
    here = np.searchsorted(inside, at)
    place = spot_t[here]
    best = np.zeros(len(place), np.int64)
    for near, ok in ((before[rank[place]], before[rank[place]] >= 0), (after[rank[place]], after[rank[place]] < size)):
        two = common_words(levels, place[ok], order[near[ok]])
        best[ok] = np.maximum(best[ok], two)
    doc = shard.owner[at]
    most = np.zeros(int(doc.max()) + 1, np.int64)
    np.maximum.at(most, doc, best)
    top = np.flatnonzero(best == most[doc])
    out = []
    # Of the items that have a stretch of this length, the first, and its first place there.
    left = block.start[item + 1] - words_
    for m in np.unique(best[top]).tolist():
        mine, theirs = top[best[top] == m], np.flatnonzero(left >= m)
        name = named(text, np.concatenate((spot_q[theirs], place[mine])), np.full(len(theirs) + len(mine), m), levels)
        first = np.full(int(name.max()) + 1, len(theirs), np.int64)
        np.minimum.at(first, name[: len(theirs)], np.arange(len(theirs)))
        q = theirs[first[name[len(theirs) :]]]
        out.append(np.stack((doc[mine], np.full(len(mine), m), item[q], words_[q] - block.start[item[q]], at[mine]), 1))
    rows = np.concatenate(out)
    rows = rows[np.lexsort((rows[:, 4], rows[:, 2], rows[:, 0]))]
    return rows[np.unique(rows[:, 0], return_index=True)[1]]


def spelled_alike(own: list[bytes], ids: np.ndarray, hit: np.ndarray, block: Block) -> bool:
    """Whether the hit words of a document are the benchmark's words that they have the ids of."""
    return all(own[k] == block.spelled[ids[k] - 1] for k in np.flatnonzero(hit).tolist())


def exact_hits(text: bytes, block: Block, items: list[int], window: int) -> tuple[np.ndarray, list[int]]:
    """Hit words and items of one document by comparing words: for documents where different words share a hash."""
    own = words(text)
    hit, seen = np.zeros(len(own), bool), []
    for i in items:
        item = [block.spelled[k - 1] for k in block.ids[block.start[i] : block.start[i + 1]]]
        size = min(window, len(item))
        grams = {tuple(item[j : j + size]) for j in range(len(item) - size + 1)}
        at = [j for j in range(len(own) - size + 1) if tuple(own[j : j + size]) in grams]
        for j in at:
            hit[j : j + size] = True
        seen += [i] if at else []
    return hit, seen


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int, window: int | None = None) -> list:
    """Broadcast blocks; the driver holds one block's items at a time. One item is never split."""
    spark, out, items, total = benchmark.sparkSession, [], [], 0

    def flush() -> None:
        block = Block.of(items)
        block.distinct = block.windows(window) if window else None
        out.append(spark.sparkContext.broadcast(block))

    for row in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator():
        text = bytes(row[1] or b"")
        n = len(text) // 2 + 1
        if items and total + n > block_words:
            flush()
            items, total = [], 0
        items.append(("" if row[0] is None else row[0], text))
        total += n
    if items:
        flush()
    return out


def _each(blocks: list) -> Iterator[Block]:
    """Blocks one after the other. Of several, a worker holds one: each is read again from the executor's disk."""
    for shared in blocks:
        yield shared.value
        if len(blocks) > 1:
            vars(shared).pop("_value", None)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS, carry: list[str] | None = None) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, items (their ids, sorted, comma-joined),
    longest (words of its longest verbatim match), longest_item, longest_item_word and longest_word (where that begins
    in the item and in the document). Of equally long matches the one of the item that comes first in the benchmark's
    rows counts, then the first in the document; without a window they are 0 and null.

    A document is contaminated if n_hit > 0 and ``share`` * n_hit >= n_words. One row comes out for each row that
    goes in, also for repeated rows and null ids. Null and empty texts have no words; null or empty items have no
    windows; an empty benchmark hits nothing. Repeated items count once for each distinct id. Other columns are
    ignored, but those in ``carry`` are returned too.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, block_words, window)
    keep = [id_col, *(carry or [])]

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        hashes, first = alnum_hasher().texts(texts)
        hit = np.zeros(len(hashes), bool)
        items: list[set[str]] = [set() for _ in texts]
        longest: list[tuple] = [(0, None, None, None)] * len(texts)
        for block in _each(blocks):
            own_hashes = hashes if block.seed == alnum_hasher().seed else alnum_hasher(block.seed).texts(texts)[0]
            shard = Shard(own_hashes, first, block, window, block.shortest(window))
            got = hits(shard, block, window)
            ends = np.searchsorted(got.pairs[:, 0], np.arange(len(texts) + 1))
            for d, words_, item, there, at in got.longest.tolist():
                own = words(texts[d])
                a, b = first[d], first[d + 1]
                seen = got.pairs[ends[d] : ends[d + 1], 1].tolist()
                mine = got.covered[a:b]
                if not spelled_alike(own, shard.ids[a:b], mine, block):
                    mine, seen = exact_hits(texts[d], block, seen, window)
                    words_ = 0
                hit[a:b] |= mine
                items[d].update(block.names[i] for i in seen)
                if words_ > longest[d][0]:
                    longest[d] = (words_, block.names[item], there, at - int(a))
        n = np.diff(first)
        counts = np.diff(np.concatenate(([0], np.cumsum(hit)))[first])
        joined = [",".join(sorted(s)) for s in items]
        columns = [n, counts, [len(s) for s in items]]
        return pa.RecordBatch.from_arrays(
            [*part.columns[: len(keep)], *(pa.array(c, pa.int64()) for c in columns), pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined]), pa.array((counts > 0) & (share * counts >= n)), pa.array(joined, pa.string()), *(pa.array([x[k] for x in longest], pa.string() if k == 1 else pa.int64()) for k in range(4))],
            names=[*keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", *LONGEST],
        )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_texts(docs, work, f"{kinds}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items string, longest long, longest_item string, longest_item_word long, longest_word long", keep, text_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns, in one pass and without a shuffle."""
    text = options.get("text_col", "text")
    carry = [c for c in docs.columns if c != options.get("id_col", "doc_id")]
    clash = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c not in (text, options.get("id_col", "doc_id"))}
    named = docs.withColumnsRenamed(clash)
    options["carry"] = [clash.get(c, c) for c in carry]
    got = contamination(named, benchmark, **options).where("not contaminated")
    return got.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])


def longest(docs: DataFrame, benchmark: DataFrame, at_least: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For every benchmark suffix its longest verbatim match in each shard, from ``at_least`` words on.

    Rows: item_id (string), item_word (where the suffix starts), n_words, doc_id, doc_word. Shards are the bounded
    portions of tasks; the longest over all of them is a maximum over these rows. Nulls are empty texts.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, BLOCK_WORDS)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        hashes, first = alnum_hasher().texts(texts)
        rows: Iterator | list = []
        for block in _each(blocks):
            own_hashes = hashes if block.seed == alnum_hasher().seed else alnum_hasher(block.seed).texts(texts)[0]
            depth = int(np.diff(block.start).max(initial=1))
            shard = Shard(own_hashes, first, block, depth, at_least)
            if not len(shard.order):
                continue
            best, where = longest_matches(shard.text, shard.order, np.append(block.ids, np.full(depth + 1, -2, np.int32)), block.start)
            item = np.repeat(np.arange(len(block.names)), np.diff(block.start))
            for i in np.flatnonzero(best >= at_least):
                word = shard.back[where[i]]
                rows.append((block.names[item[i]], int(i - block.start[item[i]]), int(best[i]), int(shard.owner[word]), int(word - first[shard.owner[word]])))
        ids = part.column(0).take(pa.array([r[3] for r in rows], pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)), ids, pa.array([r[4] for r in rows], pa.int64())], names=["item_id", "item_word", "n_words", id_col, "doc_word"])

    return map_texts(docs, work, f"item_id string, item_word long, n_words long, `{id_col}` {kind}, doc_word long", [id_col], text_col)
