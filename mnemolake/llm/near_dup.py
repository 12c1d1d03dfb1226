"""Near-duplicate documents by SetSketch registers, banding, a joint likelihood and exact verification.

1. Each text becomes a set of word shingles (64-bit hashes). Equal sets are one node.
2. SetSketch: a register is a truncated, exponentially spaced minimum, floor(1 - log_b(min E)) over exponentials E.
   Bands of registers are hashed; sets that share a band meet in its bucket. There are as many bands as it takes to
   miss a pair at the threshold with a chance of at most 1e-6 (30 of 6 registers at 0.85, 35 of 5 at 0.8).
3. Each set is verified against the smallest of the sets that it meets, in portions of bounded size: registers are
   compared by the joint likelihood of their order, pairs that are clearly below the threshold are passed over, the
   others are verified on full sets. This unites most families of near copies, each text being sent once.
4. Buckets that still hold sets of different components, not compared yet, give coarse clusters. These are cut into
   blocks of bounded size, and each pair of blocks is one task, which walks the graph of true links between different
   components breadth first. Only tree edges are returned.
5. Components of these edges are the result. Nothing emits all pairs of a group or gathers a group of unbounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import WordHasher, attached, connected, mix, slices, spaced_hasher, trim, with_least, written
from mnemolake.llm.tokens import map_texts

WORDS, PERCENT = 5, 80
#: The largest chance that all bands miss a pair at the threshold, and about how likely one band is to find it.
MISSED, FOUND = 1e-6, 0.327
#: SetSketch parameters: the spacing of registers, the rate of the exponentials, the largest register.
BASE, RATE, LARGEST = 1.02, 20.0, 65_534
#: A block of a cluster has about so many documents and shingles.
BLOCK_DOCUMENTS, BLOCK_SHINGLES = 1024, 1 << 20
#: Pairs whose log likelihood at the threshold is so much below their best are passed over (odds of 5e-9).
CLEAR = 19.0

_draw = np.random.default_rng(20240607)
_FACTOR = _draw.integers(1, 2**32, 4096, dtype=np.uint32) | np.uint32(1)
_SHIFT = _draw.integers(0, 2**32, 4096, dtype=np.uint32)


def banding(percent: int) -> tuple[int, int]:
    """Bands, and registers in each, for a similarity of ``percent``."""
    share = min(max(percent, 1), 99) / 100
    rows = max(1, math.floor(math.log(FOUND) / math.log(share)))
    return min(4096 // rows, math.ceil(math.log(MISSED) / math.log(1 - share**rows))), rows


def shingles(hasher: WordHasher, texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: ``words`` words each, or all of a shorter text's."""
    hashes, first = hasher.texts(texts)
    n = np.diff(first)
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        rolled = mix(rolled + hashes[k : len(hashes) - words + 1 + k]) if len(rolled) else rolled
    out = []
    for a, m in zip(first.tolist(), n.tolist()):
        if m >= words:
            out.append(np.unique(rolled[a : a + m - words + 1]))
        elif m:
            one = np.full(1, m, np.uint64)
            for k in range(m):
                one = mix(one + hashes[a + k : a + k + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray], count: int) -> np.ndarray:
    """``count`` SetSketch registers of non-empty sets, one row each."""
    out = np.empty((len(sets), count), np.uint16)
    for a, b in slices((len(s) for s in sets), 1 << 18):
        flat = (np.concatenate(sets[a:b]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[a : b - 1])])
        low, one = np.empty((b - a, count), np.uint32), np.empty_like(flat)
        for j in range(count):
            np.multiply(flat, _FACTOR[j], out=one)
            one += _SHIFT[j]
            low[:, j] = np.minimum.reduceat(one, starts)
        least = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
        out[a:b] = np.clip(np.floor(1 - np.log(least) / math.log(BASE)), 0, LARGEST)
    return out


def bands(regs: np.ndarray, count: int) -> np.ndarray:
    """64-bit bucket of each of ``count`` bands."""
    cut = regs.astype(np.uint64).reshape(len(regs), count, -1)
    out = mix(np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), (len(regs), count)).copy())
    for k in range(cut.shape[2]):
        out = mix(out + cut[:, :, k])
    return out


def log_likelihood(above: np.ndarray, below: np.ndarray, equal: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Joint log likelihood of register comparisons of sets of ``n`` and ``m`` members that are so similar."""
    u, v = n / (n + m), m / (n + m)
    most = np.minimum(u / v, v / u)
    j = np.minimum(similarity, most * (1 - 1e-9))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    # The share of either set outside the other follows from the sizes and the similarity.
    more, less = p(u - v * j), p(v - u * j)
    same = np.maximum(1 - more - less, 1e-12)
    return above * np.log(np.maximum(more, 1e-12)) + below * np.log(np.maximum(less, 1e-12)) + equal * np.log(same)


def clearly_below(one: np.ndarray, n: int, many: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the likelihood puts each of ``many`` clearly below ``threshold`` of similarity to ``one``."""
    above, equal = (one > many).sum(1), (one == many).sum(1)
    below = len(one) - above - equal
    grid = np.linspace(0.02, threshold, 24)[:, None]
    each = log_likelihood(above, below, equal, float(n), sizes.astype(float), grid)
    return each[-1] < each.max(0) - CLEAR


def tree_edges(sets: list[np.ndarray], side: np.ndarray, percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that span the components of links (100 * intersection >= percent * union) among ``sets``.

    If ``side`` has two values only links between the sides count; sets of one ``known`` component are united already.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    terms, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(terms), bool)
    two = len(np.unique(side)) > 1
    regs = registers(sets, 192) if len(sets) > 4 else None
    out, left, queue = [], np.ones(len(sets), bool), []
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        queue.append(root)
        while queue:
            x = queue.pop()
            ask = np.flatnonzero(left & (side != side[x])) if two else np.flatnonzero(left)
            if known is not None:
                ask = ask[known[ask] != known[x]]
            # Sizes alone rule out what is too long or too short.
            ask = ask[100 * np.minimum(sizes[ask], sizes[x]) >= percent * np.maximum(sizes[ask], sizes[x])]
            if regs is not None and len(ask) > 4:
                ask = ask[~clearly_below(regs[x], sizes[x], regs[ask], sizes[ask], percent / 100)]
            if not len(ask):
                continue
            mark[flat[first[x] : first[x + 1]]] = True
            if len(ask) * 8 > len(sets):
                both = np.add.reduceat(mark[flat], first[:-1], dtype=np.int64)[ask]
            else:
                both = np.array([np.count_nonzero(mark[flat[first[y] : first[y + 1]]]) for y in ask.tolist()], np.int64)
            mark[flat[first[x] : first[x + 1]]] = False
            for y in ask[100 * both >= percent * (sizes[x] + sizes[ask] - both)].tolist():
                left[y] = False
                out.append((x, y))
                queue.append(y)
    return out


def _key(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        low = int(own.sum(dtype=np.uint64)) ^ len(own)
        high = int(mix(own + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return tuple(x - (1 << 64) if x >= 1 << 63 else x for x in (high, low))


def sketched(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, hash, n_shingles, high, low, buckets); ``hash`` stands for the text and whether there is an id."""
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), text_hash(id_col, text_col).alias("hash"), F.col(text_col).alias("text"))
    count, rows = banding(percent)

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        sets = shingles(spaced_hasher(), texts, words)
        full = [i for i, s in enumerate(sets) if len(s)]
        buckets = np.zeros((len(sets), count), np.int64)
        if full:
            buckets[full] = bands(registers([sets[i] for i in full], count * rows), count).view(np.int64)
        keys = [_key(s) for s in sets]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * count), pa.array(buckets.ravel()))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, pa.int64()) for x in ([len(s) for s in sets], [k[0] for k in keys], [k[1] for k in keys])), lists], names=["doc_id", "hash", "n_shingles", "high", "low", "buckets"])

    return map_texts(own, work, f"doc_id {kind}, hash long, n_shingles long, high long, low long, buckets array<long>", ["doc_id", "hash"], "text")


def text_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).isNull())


def _verify(words: int, percent: int):
    """Tasks over rows (task, side, node, text, known), sorted by task, to tree edges (a, b)."""

    def edges(group: list[tuple]) -> list[tuple[int, int]]:
        sets = shingles(spaced_hasher(), [g[3] or b"" for g in group], words)
        keep = [i for i, s in enumerate(sets) if len(s)]
        if len(keep) < 2:
            return []
        known = np.array([group[i][4] for i in keep])
        found = tree_edges([sets[i] for i in keep], np.array([group[i][1] for i in keep]), percent, known if len(np.unique(known)) < len(known) else None)
        return [(group[keep[x]][2], group[keep[y]][2]) for x, y in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            done: list[tuple[int, int]] = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if group and row[0] != group[0][0]:
                    done += edges(group)
                    group = []
                group.append(row)
            yield _edges(done)
        if group:
            yield _edges(edges(group))
        group = []
        trim()

    return run


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept): one for each row of ``docs``; ids are integers.

    Linked are documents whose shingle sets have 100 * intersection >= ``percent`` * union; ``component_id`` is the
    smallest id that links lead to, and ``kept`` tells whether it is the row's own. Null or empty texts and texts
    without words have no shingles, are linked with nothing and kept. A row without an id links nothing else; it
    has the component of an equal set if there is one, else null, and is kept if it has none. Rows with equal sets are linked,
    repeated ones too, and repeats of a kept id are all kept. Other columns are ignored; an empty table gives an
    empty one.
    """
    return components(docs, words, percent, id_col, text_col, **options).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def deduplicate(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, with all its columns: that of the smallest id.

    Of rows with that id in the group the one with the least hash of the text stays, and of rows that agree in id and
    text one. Texts without words stay, and so do rows without an id, but for those whose shingles are those of a row
    with an id, or of another without one.
    """
    first = F.when(F.col("component_id").isNull() & F.col("doc_id").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)) & ((F.col("n_shingles") == 0) | F.coalesce(F.col("hash") == F.col("component_hash"), F.lit(True))))
    lowest = F.lit(-(1 << 63))
    stay = components(docs, words, percent, id_col, text_col, **options).where(first)
    # Rows without an id: one for each set. All others: one for each id and text.
    stay = stay.groupBy(F.col("doc_id").isNull().alias("_none"), F.when(F.col("doc_id").isNull() & (F.col("n_shingles") > 0), F.xxhash64("high", "low")).otherwise(F.xxhash64("doc_id", "hash")).alias("_one")).agg(F.min(F.struct(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("_key"), F.col("hash").alias("_hash"))).alias("s")).select("s.*")
    named = docs.withColumnsRenamed({c: f"_own_{i}" for i, c in enumerate(docs.columns)})
    own_id, own_text = (f"_own_{docs.columns.index(c)}" for c in (id_col, text_col))
    own = named.withColumns({"_key": F.coalesce(F.col(own_id).cast("long"), lowest), "_hash": text_hash(own_id, own_text)})
    kept = own.join(stay.hint("merge"), ["_key", "_hash"]).dropDuplicates(["_key", "_hash"])
    return kept.select(*[F.col(f"_own_{i}").alias(c) for i, c in enumerate(docs.columns)])


def components(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, block_documents: int = BLOCK_DOCUMENTS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Rows (doc_id, hash, high, low, n_shingles, component_id, component_hash), one for each row of ``docs``."""
    spark = docs.sparkSession
    rows = written(sketched(docs, words, percent, id_col, text_col), "sketches")
    # A node is a set; its text is that of its smallest id. Rows without an id are copies of it, and make no node alone.
    own = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").cast("long").alias("id"), F.col("hash").alias("hash")))
    nodes = rows.where("n_shingles > 0").groupBy("high", "low").agg(F.min(own).alias("first"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets")).where("first is not null")
    nodes = written(nodes.withColumn("node", F.xxhash64("high", "low")), "nodes")
    marks = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = marks.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("largest")).where("least < largest").select("bucket", "least")
    # Written, so that both sides of the join are plain shuffles: a bucket of very many sets can be split.
    shared = written(shared, "shared-buckets")
    # The larger joins are sort-merge joins at every size: neither side has a bound, and hot keys can be split.
    met = written(marks.join(shared.hint("merge"), "bucket"), "met")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(id_col, text_col).alias("hash"), F.col(text_col).cast("binary").alias("text"))
    # One text for each id and hash: repeated rows must not fill a block. Sorting texts for it costs, so only if there are any.
    if rows.groupBy("doc_id", "hash").agg(F.count("*").alias("c")).where("c > 1").limit(1).count():
        texts = texts.dropDuplicates(["id", "hash"])
    places = nodes.select("node", "first.id", "first.hash")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = lambda key: F.greatest(F.ceil(F.count("*") / block_documents), F.ceil(F.sum("n") / block_shingles), F.lit(1)).cast("int").alias(key)
    part_of = lambda key: F.pmod(F.xxhash64("node", F.lit(7)), F.col(key)).cast("int")

    def verified(dealt: DataFrame, name: str) -> DataFrame:
        asked = dealt.join(places.hint("merge"), "node")
        rows = texts.join(asked.hint("merge"), ["id", "hash"]).select("task", "side", "node", "text", "known")
        return written(rows.repartition(tasks, "task").sortWithinPartitions("task", "side").mapInArrow(_verify(words, percent), "a long, b long"), name)

    # Followers are dealt in portions, each with their leader.
    stars = written(met.where("node > least").groupBy("node").agg(F.min("least").alias("leader")).join(nodes.select("node", "n").hint("merge"), "node"), "stars")
    portions = stars.groupBy("leader").agg(size("portions"))
    follow = attached(stars, "leader", [size("portions")], stars.count()).select("node", F.xxhash64("leader", part_of("portions")).alias("task"), F.lit(1).alias("side"), F.col("node").alias("known"))
    lead = portions.select("leader", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("i")).select(F.col("leader").alias("node"), F.xxhash64("leader", "i").alias("task"), F.lit(0).alias("side"), F.col("leader").alias("known"))
    led = verified(follow.union(lead), "star-links")
    # Buckets with members of different components of which not every pair was compared.
    united = connected(led, "star-components")
    known = lambda df: df.join(united.hint("merge"), "node", "left").withColumn("known", F.coalesce("root", "node")).drop("root")
    seen = known(met).join(stars.select("node", "leader").hint("merge"), "node", "left").withColumn("fresh", (F.col("node") > F.col("least")) & (F.col("least") != F.col("leader")))
    mixed = seen.groupBy("bucket").agg(F.min("known").alias("low"), F.max("known").alias("high"), F.count("*").alias("members"), F.max(F.coalesce("fresh", F.lit(False))).alias("fresh")).where("low < high and (members > 2 or fresh)").select("bucket")
    open_ = met.where("node > least").join(written(mixed, "mixed").hint("merge"), "bucket").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    coarse = connected(open_, "coarse")
    # A root is a member of its own cluster.
    members = written(known(coarse.union(coarse.select("root", "root").distinct()).withColumnRenamed("root", "cluster")).join(nodes.select("node", "n").hint("merge"), "node"), "members")
    dealt = attached(members, "cluster", [size("blocks")], members.count()).withColumn("own", part_of("blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")).alias("task"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "known")
    links = led.union(verified(dealt, "block-links"))
    roots = connected(links, "components")
    ids = nodes.select("node", "copies", "high", "low", F.struct("first.id", "first.hash").alias("first")).join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = written(ids.select("root", "copies", "high", "low", "first"), "node-roots")
    several = with_least(ids, "root", "first", ids.count()).where("copies > 1 or m <> first")
    known = several.select("high", "low", F.col("m.id").alias("component"), F.col("m.hash").alias("component_hash"))
    kind = docs.schema[id_col].dataType
    got = rows.drop("buckets").join(known.hint("merge"), ["high", "low"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce(F.col("component").cast(kind), F.col("doc_id")))
    return got.select("doc_id", "hash", "high", "low", "n_shingles", component.alias("component_id"), "component_hash")
