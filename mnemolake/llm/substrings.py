"""Exact substring de-duplication on bytes by bucket refinement of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (in a document of smaller id, or earlier
in the same one). Which strings are equal is settled in steps, each on what the step before couldn't tell:

1. Buckets of q-grams. Each window of ``length`` bytes is represented by its q-gram of least hash, so equal windows lie
   in one bucket, at one place relative to it. Buckets with one place in the whole corpus are settled (a Bloom filter
   of fixed size drops nearly all of them before anything large is shuffled).
2. A run of windows with one representative is compared as a whole, by 64-bit hashes of its bytes beside those of its
   q-gram. Tasks settle their own equal runs first, so a bucket receives at most one row a task for a run.
3. Buckets that still hold different runs are refined on their bytes, a bounded number of q-grams at a time: suffixes
   start in buckets of 8-grams, and each round sorts the places of unfinished buckets by the bucket of the suffix 8, 16,
   32 and 36 bytes further on (bucket pointers, the last round's results being reused in place), until buckets stand
   for ``length`` bytes. A q-gram with very many different runs is dealt anew by the windows' own bytes, after each task
   has refined its own; such buckets take their rows in portions and keep the first of equal windows.

Covered stretches meet the texts in one join by document. No task holds more than a portion of a bucket, and the number
of buckets follows the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import mix, range_hashes, slices, trim, written

LENGTH, GRAM = 100, 32
#: Bytes of the Bloom filter of repeated q-grams, whatever the input (what it can't tell passes and is settled by the
#: shuffles); bytes of text in a bucket of the shuffles; tasks that share the buckets, and parts of the filter.
BLOOM_BYTES, BUCKET_TEXT, TASKS, PARTS = 1 << 25, 16 << 20, 1 << 15, 1 << 12
#: Anchors that a task holds before it settles and hands on; runs of a q-gram from which its windows are dealt singly.
HOLD, HOT = 1 << 20, 6000
#: Bytes of text that tasks take at a time, that are refined at a time, and of pieces that they hand on together.
SEGMENT, REFINED, HANDED = 1 << 20, 1 << 19, 8 << 20
_BLOOM_HASHES = 3
#: Fixed, odd: of the polynomial of a q-gram. A q-gram only says which runs meet; runs have hashes that aren't linear.
_POWER_BASE = np.uint64(0x9E3779B97F4A7C15)

#: A run: q-gram hash, hash of all its bytes, document (id, hash of its text), first window, number of windows.
RUN = np.dtype([("gram", "<u8"), ("run", "<u8"), ("id", "<i8"), ("text", "<i8"), ("start", "<i8"), ("count", "<i4")])
#: A run with its bytes; ``gram`` is what it must share with others, the q-gram's hash or that of a single window.
PIECE = np.dtype([("gram", "<u8"), ("id", "<i8"), ("text", "<i8"), ("start", "<i8"), ("count", "<i4")])
#: Windows of a document that are covered.
STRETCH = np.dtype([("id", "<i8"), ("text", "<i8"), ("start", "<i8"), ("count", "<i4")])


class Anchors:
    """Runs of windows of texts, by their representatives."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.width = length, gram, length - gram + 1
        self.weight = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        self.power = self.back = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = 1 << n.bit_length()
            inverse = np.uint64(pow(int(_POWER_BASE), -1, 2**64))
            self.power, self.back = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, x, np.uint64)))) for x in (_POWER_BASE, inverse))

    def of(self, texts: list[bytes], ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """RUN records of all windows of all texts."""
        parts, few, small = [], [], []
        for i, t in enumerate(texts):
            if len(t) <= SEGMENT:
                few.append(i)
                small.append(t)
            else:
                for at in range(0, len(t) - self.length + 1, SEGMENT):
                    parts.append(self._runs([t[at : at + SEGMENT + self.length - 1]], ids[i : i + 1], hashes[i : i + 1], at))
        for a, b in slices(map(len, small), SEGMENT):
            parts.append(self._runs(small[a:b], ids[few[a:b]], hashes[few[a:b]], 0))
        return np.concatenate(parts) if parts else np.zeros(0, RUN)

    def _runs(self, texts: list[bytes], ids: np.ndarray, hashes: np.ndarray, shift: int) -> np.ndarray:
        sizes = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(sizes) - sizes
        raw = np.frombuffer(b"".join(texts), np.uint8)
        n = len(raw) - self.length + 1
        if n <= 0:
            return np.zeros(0, RUN)
        self._powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.weight[raw] * self.power[: len(raw)], out=sums[1:])
        m = len(raw) - self.gram + 1
        grams = mix((sums[self.gram :] - sums[:m]) * self.back[:m])
        # The least hash in each window of q-grams, the leftmost of equals: the place is in the low bits.
        low = (grams & ~np.uint64(0xFFFFFF)) | np.arange(m, dtype=np.uint64)
        reach = 1
        while 2 * reach <= self.width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < self.width:
            low = np.minimum(low[: len(low) - (self.width - reach)], low[self.width - reach :])
        anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)[:n]
        doc = np.repeat(np.arange(len(texts)), sizes)[:n]
        at = np.flatnonzero(np.arange(n) + self.length <= (first + sizes)[doc])
        if not len(at):
            return np.zeros(0, RUN)
        new = np.ones(len(at), bool)
        new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
        begin = at[new]
        count = np.diff(np.append(np.flatnonzero(new), len(at)))
        end = begin + count + self.length - 1
        out = np.empty(len(begin), RUN)
        out["gram"] = grams[anchor[begin]]
        out["run"] = mix(range_hashes(raw, begin, end, 7)[0] ^ (count.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (anchor[begin] - begin).astype(np.uint64)))
        out["id"], out["text"] = ids[doc[begin]], hashes[doc[begin]]
        out["start"], out["count"] = begin - first[doc[begin]] + shift, count
        return out


def settle(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of equal runs, and all others (which an earlier equal run covers)."""
    runs = runs[np.lexsort((runs["start"], runs["text"], runs["id"], runs["run"], runs["gram"]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs["gram"][1:] != runs["gram"][:-1]) | (runs["run"][1:] != runs["run"][:-1])
    head = runs[np.maximum.accumulate(np.where(new, np.arange(len(runs)), 0))] if len(runs) else runs
    # A repeated row is the same document: its runs aren't earlier than themselves.
    same = (head["id"] == runs["id"]) & (head["text"] == runs["text"]) & (head["start"] == runs["start"]) & ~new
    return runs[new], runs[~new & ~same]


def refine(raw: np.ndarray, length: int) -> np.ndarray:
    """For each place the bucket of the ``length`` bytes from it; equal buckets are equal bytes. 8 <= length.

    A bucket's number is the rank of its first member, so splitting one leaves all others as they are: only places in
    buckets of several are sorted again. Places with fewer bytes after them have buckets too, which mean nothing.
    """
    n = len(raw)
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key <<= np.uint64(8)
        key |= padded[k : k + n]
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    bucket = np.empty(n, np.int32)
    bucket[order], order = _split(key, order, np.zeros(n, np.int32))
    depth = 8
    while depth < length and len(order):
        step = min(depth, length - depth)
        pointer = np.where(order + step < n, bucket[np.minimum(order + step, n - 1)] + 1, 0)
        key = (bucket[order].astype(np.int64) << 32) | pointer
        sort = np.argsort(key, kind="stable")
        key, order = key[sort], order[sort]
        del sort, pointer
        # All pointers of the round are read before any is changed: every bucket stands for as many bytes.
        changed, left = _split(key, order, bucket[order])
        bucket[order], order = changed, left
        depth += step
    return bucket


def _split(key: np.ndarray, order: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of sorted places whose keys differ from those before them, and the places in buckets of several.

    ``base`` has the old numbers: a bucket's parts are numbered from it on by where they begin within it.
    """
    at = np.arange(len(order), dtype=np.int32)
    new, old = np.ones(len(order), bool), np.ones(len(order), bool)
    new[1:], old[1:] = key[1:] != key[:-1], base[1:] != base[:-1]
    inside = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
    last = np.append(new[1:], True)
    return (base + inside).astype(np.int32), order[~(new & last)] if len(order) else order


def _sizes(pieces: np.ndarray, length: int) -> np.ndarray:
    return pieces["count"].astype(np.int64) + length - 1


def later_windows(pieces: np.ndarray, data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Records (id, text, start) of windows of ``pieces`` that equal an earlier one, and which pieces have a first one.

    ``data`` has the pieces' bytes. Pieces are compared with those of their own ``gram``, about REFINED bytes at a time.
    """
    first = np.concatenate(([0], np.cumsum(_sizes(pieces, length))))
    order = np.argsort(pieces["gram"], kind="stable")
    gram, total = pieces["gram"][order], np.cumsum(_sizes(pieces[order], length))
    ends = np.append(np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(order))
    raw = np.frombuffer(data, np.uint8)
    late, leads, begin, base = [], np.zeros(len(pieces), bool), 0, 0
    for end, following in zip(ends, np.append(ends[1:], 0)):
        # Whole groups, as many as fit.
        if following and total[following - 1] - base <= REFINED:
            continue
        own = order[begin:end]
        some = pieces[own]
        body = np.concatenate([raw[first[i] : first[i + 1]] for i in own.tolist()])
        found, head = _later(some, body, length)
        late.append(found)
        leads[own[head]] = True
        begin, base = end, total[end - 1]
    return (np.concatenate(late) if late else np.zeros(0, STRETCH)), leads


def _later(pieces: np.ndarray, raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = _sizes(pieces, length)
    first = np.cumsum(sizes) - sizes
    count = pieces["count"].astype(np.int64)
    which = np.repeat(np.arange(len(pieces)), count)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    bucket = refine(raw, length)[first[which] + inside]
    ids, text, start = pieces["id"][which], pieces["text"][which], pieces["start"][which] + inside
    order = np.lexsort((start, text, ids, bucket))
    bucket, ids, text, start = bucket[order], ids[order], text[order], start[order]
    new = np.ones(len(order), bool)
    new[1:] = bucket[1:] != bucket[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    late = ~new & ~((ids[head] == ids) & (text[head] == text) & (start[head] == start))
    out = np.empty(int(late.sum()), STRETCH)
    out["id"], out["text"], out["start"], out["count"] = ids[late], text[late], start[late], 1
    return out, np.unique(which[order[new]])


def _stretches(found: np.ndarray, length: int) -> Iterator[tuple[int, int, bytes]]:
    """For each document of ``found`` its covered stretches, merged: (id, text, pairs of start and end as int64)."""
    found = found[np.lexsort((found["start"], found["text"], found["id"]))]
    if not len(found):
        return
    start, end = found["start"], found["start"] + found["count"] + length - 1
    owner = np.concatenate(([True], (found["id"][1:] != found["id"][:-1]) | (found["text"][1:] != found["text"][:-1])))
    firsts = np.flatnonzero(owner)
    for a, b in zip(firsts, np.append(firsts[1:], len(found))):
        yield int(found["id"][a]), int(found["text"][a]), merged(np.stack((start[a:b], end[a:b]), 1)).tobytes()


def merged(pairs: np.ndarray) -> np.ndarray:
    """Union of stretches (start, end), those that touch as one."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:, 0] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(pairs)) - 1
    return np.stack((pairs[new, 0], reach[last]), 1).astype(np.int64)


#: Rows between steps: part 0 covered stretches of a document (id, text), part 1 records for a bucket (id).
ROWS = "part int, id long, text long, data binary"
#: The same, with distinct runs in columns of their own (part 1).
CLASSES = ROWS + ", gram long, start long, count int"


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "id", "text", "data"])


def _dealt(key: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Indices of records by bucket, from scrambled 64-bit keys."""
    bucket = (mix(key.copy()) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) > 0))) if len(order) else order
    for a, b in zip(edge, np.append(edge[1:], len(order))):
        yield int(bucket[order[a]]), order[a:b]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    for batch in batches:
        text = batch.column(2)
        for a, b in slices([x.as_py() or 0 for x in pc.binary_length(text)]):
            yield [x or b"" for x in text.slice(a, b - a).to_pylist()], batch.column(0).slice(a, b - a).to_numpy(), batch.column(1).slice(a, b - a).to_numpy()


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Buckets of a sorted stream (bucket, data), each whole."""
    now, held = None, []
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if held and bucket != now:
                yield now, held
                held = []
            now = bucket
            held.append(data.as_buffer().to_pybytes())
    if held:
        yield now, held


def _filter_rows(anchors: Anchors, buckets: int):
    """Step 1: q-gram hashes of a task by bucket, each at most twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held))
            keep = np.ones(len(keys), bool)
            keep[2:] = keys[2:] != keys[:-2]
            keys = keys[keep]
            return _rows([(1, k, 0, keys[at].tobytes()) for k, at in _dealt(keys, buckets)])

        for texts, ids, hashes in _texts(batches):
            runs = anchors.of(texts, ids, hashes)
            held.append(runs["gram"])
            count += len(runs)
            if count > HOLD:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()
        held.clear()
        trim()

    return run


def _bloom_places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(keys + np.uint64(k + 1)) % np.uint64(bits)).astype(np.int64) for k in range(_BLOOM_HASHES)]


def _bloom_rows(bits: int, parts: int):
    """The part of the filter that the repeated hashes of its buckets set; a part's buckets come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros(bits, np.uint8)
        for bucket, data in _by_bucket(batches):
            if now is not None and bucket % parts != now:
                yield _rows([(1, now, 0, np.packbits(held).tobytes())])
                held[:] = 0
            now = bucket % parts
            keys = np.sort(np.frombuffer(b"".join(data), np.uint64))
            for place in _bloom_places(keys[1:][keys[1:] == keys[:-1]], bits):
                held[place] = 1
        if now is not None:
            yield _rows([(1, now, 0, np.packbits(held).tobytes())])
        trim()

    return run


class Bloom:
    """Repeated q-grams, in one part for each bucket or several buckets."""

    def __init__(self, filled: dict[int, bytes], buckets: int, parts: int, bits: int):
        self.buckets, self.parts, self.bits = buckets, parts, bits
        self.data = np.zeros((parts, bits // 8), np.uint8)
        for k, part in filled.items():
            self.data[k] = np.frombuffer(part, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        bucket = ((mix(keys.copy()) % np.uint64(self.buckets)) % np.uint64(self.parts)).astype(np.int64)
        out = np.ones(len(keys), bool)
        for place in _bloom_places(keys, self.bits):
            out &= (self.data[bucket, place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0
        return out


def _run_rows(anchors: Anchors, shared, buckets: int):
    """Step 2 in the tasks: equal runs of a task are settled; the first ones go to the run's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            keep, late = settle(np.concatenate(held))
            rows = [(0, i, t, d) for i, t, d in _stretches(late, anchors.length)]
            return _rows(rows + [(1, k, 0, keep[at].tobytes()) for k, at in _dealt(keep["run"] ^ keep["gram"], buckets)])

        for texts, ids, hashes in _texts(batches):
            runs = anchors.of(texts, ids, hashes)
            runs = runs[shared.value.has(runs["gram"])]
            held.append(runs)
            count += len(runs)
            if count > HOLD:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()
        held.clear()
        trim()

    return run


def _class_rows(length: int):
    """Step 2 in the buckets: rows of covered stretches (part 0), and of each distinct run (part 1)."""

    def batch(part: int, rows: np.ndarray | None, found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        n = len(found) if rows is None else len(rows)
        own = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32())] if rows is None else [pa.array(rows["gram"].view(np.int64)), pa.array(rows["start"]), pa.array(rows["count"])]
        data = pa.array([d for _, _, d in found], pa.binary()) if rows is None else pa.nulls(n, pa.binary())
        ids, text = ([pa.array([r[i] for r in found], pa.int64()) for i in (0, 1)]) if rows is None else (pa.array(rows["id"]), pa.array(rows["text"]))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), ids, text, data, *own], names=["part", "id", "text", "data", "gram", "start", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data in _by_bucket(batches):
            keep, late = settle(np.frombuffer(b"".join(data), RUN))
            yield batch(0, None, list(_stretches(late, length)))
            for a in range(0, len(keep), 50_000):
                yield batch(1, np.ascontiguousarray(keep[a : a + 50_000]), [])
        trim()

    return run


def _packed(pieces: np.ndarray, bodies: list[bytes]) -> bytes:
    return len(pieces).to_bytes(4, "little") + pieces.tobytes() + b"".join(bodies)


def _piece_rows(anchors: Anchors, buckets: int):
    """Step 3 in the tasks: the bytes of runs that share a q-gram with others, to the bucket of the q-gram.

    Runs of q-grams with very many runs go on as single windows, to buckets of their own bytes, if they aren't equal
    to others of the task.
    """
    length = anchors.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        bodies: list[bytes] = []
        size = {False: 0, True: 0}
        single: list[np.ndarray] = []
        windows: list[bytes] = []

        def flush() -> pa.RecordBatch:
            rows = []
            if windows:
                pieces = np.concatenate(single)
                late, leads = later_windows(pieces, b"".join(windows), length)
                rows += [(0, i, t, d) for i, t, d in _stretches(late, length)]
                held.append(pieces[leads])
                bodies.extend([windows[i] for i in np.flatnonzero(leads).tolist()])
            if held:
                pieces = np.concatenate(held)
                rows += [(1, k, 0, _packed(pieces[some], [bodies[i] for i in some.tolist()])) for k, some in _dealt(pieces["gram"], buckets)]
            for x in (held, bodies, single, windows):
                x.clear()
            size.update({False: 0, True: 0})
            return _rows(rows)

        for batch in batches:
            spots = np.concatenate(([0], np.cumsum(pc.list_value_length(batch.column(3)).to_numpy())))
            flat = {c: batch.column(i).flatten().to_numpy(zero_copy_only=False) for i, c in ((3, "gram"), (4, "start"), (5, "count"), (6, "hot"))}
            for at in range(len(batch)):
                text = batch.column(2)[at].as_py()
                own = np.empty(spots[at + 1] - spots[at], PIECE)
                own["id"], own["text"] = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                own["gram"], own["start"], own["count"] = (flat[c][spots[at] : spots[at + 1]] for c in ("gram", "start", "count"))
                hot = flat["hot"][spots[at] : spots[at + 1]].astype(bool)
                for some, apart in ((own[~hot], False), (own[hot], True)):
                    # A long text has many runs: they are handed on in portions.
                    for a, b in slices(some["count"].astype(np.int64) * (length if apart else 1) + length, SEGMENT):
                        pieces = some[a:b]
                        if apart:
                            count = pieces["count"].astype(np.int64)
                            start = np.repeat(pieces["start"] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                            pieces = np.repeat(pieces, count)
                            pieces["start"], pieces["count"] = start, 1
                        body = [text[s : s + c + length - 1] for s, c in zip(pieces["start"].tolist(), pieces["count"].tolist())]
                        if apart:
                            pieces["gram"] = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in body]
                        (single if apart else held).append(pieces)
                        (windows if apart else bodies).extend(body)
                        size[apart] += sum(map(len, body))
                        if max(size.values()) > HANDED:
                            yield flush()
        yield flush()
        trim()

    return run


def _window_rows(length: int):
    """Step 3 in the buckets: refined windows, as covered stretches. A bucket that is still too large comes in portions,
    of which the pieces that have the first of equal windows stay for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads, bodies, size, carried = None, [], [], 0, 0

        def settled(last: bool) -> pa.RecordBatch:
            nonlocal heads, bodies, size, carried
            pieces, data = np.concatenate(heads), b"".join(bodies)
            late, leads = later_windows(pieces, data, length)
            heads, bodies, size, carried = [], [], 0, 0
            if not last:
                ends = np.cumsum(_sizes(pieces, length))
                heads = [pieces[leads]]
                bodies = [data[e - n : e] for e, n in zip(ends[leads].tolist(), _sizes(pieces[leads], length).tolist())]
                size = carried = sum(map(len, bodies))
            return _rows([(0, i, t, d) for i, t, d in _stretches(late, length)])

        for batch in batches:
            # What tasks have settled passes.
            done = batch.filter(pc.equal(batch.column(0), 0))
            if len(done):
                yield done
            rest = batch.filter(pc.equal(batch.column(0), 1))
            for bucket, data in zip(rest.column(1).to_pylist(), rest.column(3)):
                if heads and (bucket != now or size > 2 * carried + BUCKET_TEXT // 2):
                    yield settled(bucket != now)
                now, x = bucket, data.as_buffer().to_pybytes()
                n = int.from_bytes(x[:4], "little")
                heads.append(np.frombuffer(x, PIECE, n, 4))
                bodies.append(x[4 + n * PIECE.itemsize :])
                size += len(bodies[-1])
        if heads:
            yield settled(True)
        trim()

    return run


def _result(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at in range(len(batch)):
                text, found = batch.column(1)[at].as_py() or b"", batch.column(2)[at].as_py()
                if not found:
                    rows.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                    continue
                spans = merged(np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in found]))
                keep, last = hashlib.sha256(), 0
                for s, e in spans.tolist():
                    keep.update(text[last:s])
                    last = e
                keep.update(text[last:])
                rows.append((len(text), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), keep.hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Rows (id, text, data): stretches of documents to remove; ``id`` as long, ``text`` xxhash64 of the text."""
    spark = docs.sparkSession
    anchors = Anchors(length, gram)
    own = _keyed(docs, id_col, text_col).select("id", "hash", F.col("body"))
    total = own.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = max(8, total // BUCKET_TEXT + 1)
    parts, tasks = min(buckets, PARTS), min(buckets, TASKS)
    bits = BLOOM_BYTES // parts * 8
    sent = lambda df: df.where("part = 1").select("id", "data")
    to_buckets = lambda df: sent(df).repartition(tasks, "id").sortWithinPartitions("id")
    keys = sent(own.mapInArrow(_filter_rows(anchors, buckets), ROWS))
    filter_ = keys.repartition(parts, F.col("id") % parts).sortWithinPartitions(F.col("id") % parts, "id").mapInArrow(_bloom_rows(bits, parts), ROWS)
    shared = spark.sparkContext.broadcast(Bloom({r[0]: bytes(r[1]) for r in filter_.select("id", "data").toLocalIterator()}, buckets, parts, bits))
    runs = written(own.mapInArrow(_run_rows(anchors, shared, buckets), ROWS), "runs")
    classes = written(to_buckets(runs).mapInArrow(_class_rows(length), CLASSES), "classes")
    distinct = classes.where("part = 1").select("gram", "id", "text", "start", "count")
    # Written, so that Spark may split the hot q-grams of the join, whose sides are then plain scans.
    several = written(distinct.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "shared-grams")
    asked = distinct.join(several.hint("merge"), "gram").groupBy("id", "text").agg(F.collect_list(F.struct("gram", "start", "count", (F.col("n") > hot).alias("hot"))).alias("asked"))
    asked = asked.select("id", "text", *(F.col(f"asked.{c}").alias(c) for c in ("gram", "start", "count", "hot")))
    pieces = own.join(asked, (own["id"] == asked["id"]) & (own["hash"] == asked["text"])).select(own["id"], own["hash"], "body", "gram", "start", "count", "hot")
    handed = pieces.mapInArrow(_piece_rows(anchors, buckets), ROWS).repartition(tasks, "part", "id").sortWithinPartitions("part", "id")
    windows = written(handed.mapInArrow(_window_rows(length), ROWS), "windows")
    return runs.where("part = 0").union(classes.where("part = 0").select(*runs.columns)).union(windows).select("id", "text", "data")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("body"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256), one for each row of ``docs``; ids are integers.

    Rows that agree in id and text are one document and have one result. Rows that agree in the id alone are
    ordered by a hash of their texts; a null id comes last. A null text is empty; texts shorter than ``length``
    bytes lose nothing. An empty table gives an empty one; other columns are ignored.
    """
    found = covered(docs, length, gram, id_col, text_col, hot).groupBy("id", "text").agg(F.collect_list("data").alias("data"))
    own = _keyed(docs, id_col, text_col)
    both = own.join(found, (own["id"] == found["id"]) & (own["hash"] == found["text"]), "left").select("doc_id", "body", "data")
    kind = docs.schema[id_col].dataType.simpleString()
    return both.mapInArrow(_result(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("doc_id", id_col)
