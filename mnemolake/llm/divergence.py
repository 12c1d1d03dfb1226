"""Source divergence audit: how far each source's use of terms is from its language's and from other sources'.

Spark cuts texts into terms and counts them per task, then deals the counts into shards by a hash of language and term.
In each shard DuckDB merges the counts and drops rare terms, and, once the totals are known, sums each pair of sources
over the shard's terms and ranks each source's terms. Spark adds up the sums and merges the rankings.

A pair's sum runs over all kept terms, most of which most sources lack. With p0 for the share of a term that a source
lacks, sum f(p, q) = V f(p0, q0) + sum over the terms of one source (f(p, q0) - f(p0, q0)), the same for the other, + sum
over the terms of both (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)). Shards make the last sum, the only one that needs two
sources' counts of one term; the others come from how many terms of a source have each count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import LETTER_WORDS, Splitter, written

LEAST_DOCUMENTS, TOP_TERMS, SCALE = 10, 10, 1_000_000_000
#: Different (lang, source, term) that a task holds before it passes their counts on.
HELD = 1 << 18
#: Memory of DuckDB in a task. A shard is a shuffle partition of counts, so it needs far less; it never writes to disk.
DUCKDB_MEMORY = "1GB"

_COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every term by (lang, source), summed over as many rows as memory allows."""
    split, held = Splitter(LETTER_WORDS), {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
            n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            seen: set[bytes] = set()
            for words in split.pieces(text.as_py().encode("utf-8", "surrogatepass")):
                n.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from flush()
    yield from flush()


def _duckdb(*statements: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's rows as DuckDB's view ``rows``: all statements run over them, the results of SELECTs are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next(batches, None)
        if first is None:
            return

        def all_of() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        with duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": ""}) as shard:
            shard.register("rows", pa.RecordBatchReader.from_batches(first.schema, all_of()))
            for sql in statements:
                if sql.startswith("SELECT"):
                    yield from shard.sql(sql).to_arrow_reader(1 << 16)
                else:
                    shard.execute(sql)

    return run


#: The rows of a shard are all counts of its terms: merged, and only those of terms in enough documents of the language.
_MERGE = (
    "CREATE TEMP TABLE t AS SELECT lang, term, source, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM rows GROUP BY ALL",
    f"""SELECT lang, source, term, n, (sum(n) OVER w)::BIGINT AS total, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS once
        FROM t WINDOW w AS (PARTITION BY lang, term) QUALIFY sum(docs) OVER w >= {LEAST_DOCUMENTS}""",
)
#: Partial sums of pairs, the smaller source first, and each source's best terms in the shard.
_SUMS = (
    "CREATE MACRO f(p, q) AS (p - q) * (p - q) // (p + q)",
    "CREATE TEMP TABLE t AS SELECT * FROM rows",
    """SELECT 'pair' AS part, a.lang AS lang, a.source AS source, b.source AS item, sum(f(a.p, b.p) - f(a.p, b.p0) - f(a.p0, b.p) + f(a.p0, b.p0))::BIGINT AS value
       FROM t a JOIN t b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL""",
    f"""SELECT 'term' AS part, lang, source, term AS item, f(p, q) AS value FROM t WHERE p > q
        QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f(p, q) DESC, term) <= {TOP_TERMS}""",
)


def _share(count: Column, size: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (size + 2 * kept)), beyond 64 bits where it must; null without kept terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = F.lit(SCALE).cast("decimal(11,0)") * wide(count + F.lit(2))
    floor = F.call_function("div", top, wide(size + 2 * kept))
    return F.when(kept > 0, floor + F.lit(1))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part ``pair`` has every other source of the language by distance,
    part ``term`` the source's TOP_TERMS terms that it uses more than its language does.

    Null text, lang and source count as ''. A row is a document, also where rows repeat. A group without terms is
    compared like any other; where a language keeps no term, pairs have value 0. Equal values rank by the item's UTF-8
    bytes. An empty table gives no rows; other columns of ``docs`` are not read.
    """
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    raw = own.mapInArrow(_counted, _COUNTS).repartition("lang", "term")
    counts = written(raw.mapInArrow(_duckdb(*_MERGE), "lang string, source string, term string, n long, total long, once boolean"), "divergence-counts")
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.count_if("once").alias("kept"))
    groups = own.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "lang_size", "kept"])
    groups = written(groups.withColumn("p0", _share(F.lit(0), F.col("size"), F.col("kept"))), "divergence-groups")

    shares = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "p0", _share(F.col("n"), F.col("size"), F.col("kept")).alias("p"), _share(F.col("total"), F.col("lang_size"), F.col("kept")).alias("q"))
    shares = written(shares, "divergence-shares")
    sums = written(shares.repartition("lang", "term").mapInArrow(_duckdb(*_SUMS), "part string, lang string, source string, item string, value long"), "divergence-sums")

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    base = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("kept") * _f(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    alike = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k"))
    single = alike.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("k") * (_f(F.col("p"), F.col("q0")) - _f(F.col("p0"), F.col("q0")))).alias("value"))
    partial = single.union(sums.where("part = 'pair'").select("lang", "source", "item", "value"))
    mirrored = partial.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = base.union(partial).union(mirrored).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    both = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").union(sums.where("part = 'term'").select("lang", "source", "part", "item", "value"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))
