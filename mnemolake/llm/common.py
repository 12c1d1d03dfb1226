"""Shared pieces of the corpus operators: scratch tables, byte slices, hashes of words, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task works on at a time; one longer text is taken in segments.
SLICE_BYTES = 1 << 19
#: Rows that are sent to a Python task at a time.
RECORDS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where the setting is absent a temporary one in local mode, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="mnemolake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Send at most RECORDS rows at a time to Python: with whole texts in them, batches are what fills memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > RECORDS:
        spark.conf.set(name, str(RECORDS))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends at files every executor sees."""
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(sizes: Iterable[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes sum to at most ``limit`` (or one row)."""
    first, total, at = 0, 0, -1
    for at, n in enumerate(sizes):
        if at > first and total + n > limit:
            yield first, at
            first, total = at, 0
        total += n
    if at >= first:
        yield first, at + 1


def trim() -> None:
    """Give freed memory back at a task's end: Python workers live on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (in place where possible)."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


#: What is left of eight bytes of which so many count.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, twice: bool = False) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the byte ranges of ``data``; with ``twice`` two for each.

    A range is cut into blocks of eight bytes. Each is scrambled with the key of its place before they are added up (a second time
    with odd factors), so that no hash is linear in the bytes: polynomials modulo 2^64 agree on certain different texts
    whatever their base.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    with np.errstate(over="ignore"):
        key = lambda place: mix(place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))
        sums = [mix((eight[starts] & _MASK[np.minimum(size, 8)]) ^ key(np.zeros(1)))]
        if twice:
            sums.append(sums[0].copy())
        # What is longer than a block: its other blocks, in a row.
        if len(long := np.flatnonzero(size > 8)):
            blocks = (size[long] - 1) >> 3
            first = np.cumsum(blocks) - blocks
            place = np.arange(int(blocks.sum())) - np.repeat(first, blocks) + 1
            at = np.repeat(starts[long], blocks) + 8 * place
            more = mix((eight[at] & _MASK[np.minimum(np.repeat(ends[long], blocks) - at, 8)]) ^ key(np.arange(int(blocks.max()) + 1))[place])
            sums[0][long] += np.add.reduceat(more, first)
            if twice:
                more *= key(np.arange(int(blocks.max()) + 1) + (1 << 40))[place] | np.uint64(1)
                sums[1][long] += np.add.reduceat(more, first)
        length = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return tuple(mix(x + length + np.uint64(i)) for i, x in enumerate(sums))


class WordHasher:
    """64-bit hashes of the words in UTF-8 bytes, A-Z lower-cased, in vectorised passes.

    ``is_word`` has 256 booleans. Bytes of a multi-byte character must be all word bytes or none, so that bytes
    may be classed one by one. Equal words have equal hashes.
    """

    def __init__(self, is_word: np.ndarray, seed: int = 11):
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        self.lower, self.is_word, self.seed = lower, is_word[lower], seed

    def segment(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words of ``data``."""
        raw = np.frombuffer(data, np.uint8)
        word = np.zeros(len(raw) + 2, np.int8)
        word[1:-1] = self.is_word[raw]
        edge = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edge[::2], edge[1::2]
        return starts, ends, range_hashes(self.lower[raw], starts, ends, self.seed)[0]

    def _long(self, data: bytes) -> Iterator[np.ndarray]:
        """Hashes of a text longer than a slice, in segments that end between words."""
        at = 0
        while at < len(data):
            end = at + SLICE_BYTES
            while end < len(data):
                tail = np.frombuffer(data, np.uint8, min(65536, len(data) - end), end)
                gap = np.flatnonzero(~self.is_word[tail])
                if len(gap):
                    end += int(gap[0])
                    break
                end += len(tail)
            yield self.segment(data[at:end])[2]
            at = end

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and for each text the index of its first word (with the total at the end)."""
        parts, counts = [], []
        for a, b in slices(len(t) + 1 for t in texts):
            if b - a == 1 and len(texts[a]) > SLICE_BYTES:
                own = list(self._long(texts[a]))
                parts += own
                counts.append(np.array([sum(map(len, own))]))
                continue
            starts, _, hashes = self.segment(b"\n".join(texts[a:b]) + b"\n")
            stops = np.cumsum([len(t) + 1 for t in texts[a:b]])
            parts.append(hashes)
            counts.append(np.diff(np.searchsorted(starts, stops), prepend=0))
        first = np.zeros(len(texts) + 1, np.int64)
        if counts:
            np.cumsum(np.concatenate(counts), out=first[1:])
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), first


def byte_class(test) -> np.ndarray:
    """256 booleans: ``test`` of each byte value."""
    return np.fromiter((test(i) for i in range(256)), bool, 256)


#: Words of the contamination rule: digits, lower-case letters and every character beyond ASCII.
ALNUM_WORDS = byte_class(lambda i: i >= 0x80 or chr(i).isdigit() or chr(i).islower())
#: Words between ASCII white space.
SPACED_WORDS = byte_class(lambda i: i != 0x20 and not 0x09 <= i <= 0x0D)


@cache
def alnum_hasher(seed: int = 11) -> WordHasher:
    return WordHasher(ALNUM_WORDS, seed)


@cache
def spaced_hasher() -> WordHasher:
    return WordHasher(SPACED_WORDS)


#: A node with more edges than this, and than its share of all edges, is a hub; there are at most 2 * HUBS of them.
HUB, HUBS = 1000, 20_000


def attached(df: DataFrame, key: str, values: list[Column], count: int) -> DataFrame:
    """``df`` (of ``count`` rows) with aggregates ``values`` of all rows of the same ``key``.

    Keys with very many rows are so few that they are broadcast (no more than rows divided by their least number), and
    their rows go anywhere; the rest meets in a join whose largest key has HUB rows or a small share of all.
    """
    low = df.groupBy(key).agg(*values, F.count("*").alias("_n"))
    names = [c for c in low.columns if c not in (key, "_n")]
    hub = F.col("_n") > max(HUB, count // HUBS)
    hubs = F.broadcast(low.where(hub).select(key, F.struct(*names).alias("_hub")))
    rest = low.where(~hub).select(F.col(key).alias("_key"), F.struct(*names).alias("_low"))
    seen = df.join(hubs, key, "left").withColumn("_at", F.when(F.col("_hub").isNull(), F.col(key)).otherwise(F.xxhash64(*df.columns)))
    both = seen.join(rest.hint("merge"), F.col("_at") == F.col("_key"), "left").withColumn("_got", F.coalesce("_hub", "_low"))
    return both.select(*df.columns, *[F.col(f"_got.{c}").alias(c) for c in names])


def with_least(edges: DataFrame, key: str, value: str, count: int) -> DataFrame:
    """``edges`` with ``m``, the least ``value`` of each ``key``."""
    return attached(edges, key, [F.min(value).alias("m")], count)


def connected(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): rows (node, root), root the smallest node of its component.

    Alternates large-star and small-star steps, each written to the shared folder, until nothing changes. Every
    step shuffles as many rows as there are edges; nothing is gathered on the driver but two sums.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path = scratch_path(spark, name)
    now.write.parquet(path)
    count, mark = spark.read.parquet(path).count(), None
    for step in range(rounds if count else 0):
        now = spark.read.parquet(path)
        # Large star: every larger neighbour of a node gets the node's smallest neighbour (itself included).
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, "u", "v", 2 * count).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours get the smallest of them.
        small = with_least(large, "u", "v", count).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = scratch_path(spark, name)
        small.write.parquet(after)
        new = spark.read.parquet(after).agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_scratch(spark, path)
        path, count = after, new[0]
        if tuple(new) == mark:
            break
        mark = tuple(new)
    else:
        if count:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return spark.read.schema("u long, v long").parquet(path).select(F.col("u").alias("node"), F.col("v").alias("root"))


#: Words of letters alone: lower-case ones and every character beyond ASCII.
LETTER_WORDS = byte_class(lambda i: i >= 0x80 or chr(i).islower())


class Splitter:
    """Cuts UTF-8 bytes into words, A-Z lower-cased. ``is_word`` as in :class:`WordHasher`; words are bytes, so different words stay so."""

    def __init__(self, is_word: np.ndarray):
        lower = [i + 32 if 65 <= i <= 90 else i for i in range(256)]
        self.table = bytes(x if is_word[x] else 0x20 for x in lower)

    def pieces(self, data: bytes) -> Iterator[list[bytes]]:
        """The words in lists of a slice at most (or one word)."""
        at = 0
        while at < len(data):
            end = at + SLICE_BYTES
            if end < len(data):
                while end < len(data) and self.table[data[end]] != 0x20:
                    end += 1
            yield data[at:end].translate(self.table).split()
            at = end
