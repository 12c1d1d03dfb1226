"""Document fingerprints: threshold-scaled sketches, in DataFrame functions alone.

Of the hashes of all 5-word shingles those below a fixed fraction of the range are kept, whatever the text. So the sketch
of a union is the union of sketches (mergeable), and the part of a small document that a large one contains shows in
the share of the small sketch that the large one has: the likeness of two documents is a function of their sketches. The
fewer shingles a text has the rougher is its sketch, and a few short texts have an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import written

WORDS = 5
#: One hash in so many is kept.
SCALE = 4
#: Rows in a range of ids in which next documents are looked up; there are as many ranges as the table needs.
RANGE_ROWS = 500_000
_LOWEST = -(1 << 63)


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``x``, which is evaluated once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def hashes(words: Column, shingle: int = WORDS) -> Column:
    """The hashes of all shingles of an array of words; fewer words than ``shingle`` are one shingle, no words none."""
    at = lambda i: [F.get(words, i + k) for k in range(shingle)]
    many = F.transform(F.sequence(F.lit(0), F.size(words) - shingle), lambda i: F.xxhash64(*at(i)))
    return F.when(F.size(words) >= shingle, many).when(F.size(words) > 0, F.array(F.xxhash64(F.concat_ws(" ", words)))).otherwise(F.array().cast("array<long>"))


def keep(every: Column, scale: int = SCALE) -> Column:
    """Of hashes, sorted and distinct, those below the fraction."""
    return F.sort_array(F.array_distinct(F.filter(every, lambda h: h < _LOWEST + (1 << 64) // scale)))


def sketch(words: Column, shingle: int = WORDS, scale: int = SCALE) -> Column:
    """The sorted kept hashes of an array of words."""
    return _let(words, lambda w: keep(hashes(w, shingle), scale))


def text_words(text: Column) -> Column:
    """Words between white space, lower-cased."""
    return F.filter(F.split(F.lower(text), "\\s+"), lambda w: w != "")


def containment(a: Column, b: Column) -> Column:
    """The share of the smaller sketch that the other has; 1 if both are empty, 0 if one is."""
    least = lambda x, y: F.least(F.size(x), F.size(y))
    share = lambda x, y: F.when(least(x, y) > 0, F.size(F.array_intersect(x, y)) / least(x, y)).otherwise(F.when(F.size(x) == F.size(y), 1.0).otherwise(0.0)).cast("double")
    return _let(a, lambda x: _let(b, lambda y: share(x, y)))


def spelled(kept: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash, in order."""
    return F.concat_ws("", F.transform(kept, lambda h: F.lpad(F.hex(h), 16, "0")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, sketch), one for each row; a null text has no words."""
    words = docs.select(F.col(id_col), text_words(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    return words.select(F.col(id_col), F.size("words").cast("long").alias("n_words"), sketch(F.col("words")).alias("sketch"))


def neighbours(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """For distinct (_key, _tie, ...) of ``docs``: all columns with _next (its key and tie) and _prior (all of it).

    Documents stand in a circle by _key and _tie. They are sorted in ranges, each on its own; only the ends of the
    ranges, a row for each, meet in one window. Texts take no part in this.
    """
    nodes = written(docs.dropDuplicates(["_key", "_tie"]), "nodes")
    parts = nodes.count() // range_rows + 1
    ranged = written(nodes.repartitionByRange(parts, "_key", "_tie").withColumn("_part", F.spark_partition_id()), "ranges")
    whole = F.struct("_key", "_tie", *[c for c in nodes.columns if c not in ("_key", "_tie")])
    ends = ranged.groupBy("_part").agg(F.min(F.struct("_key", "_tie")).alias("head"), F.max(whole).alias("tail"))
    line = Window.orderBy("_part")
    around = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("_part", F.coalesce(F.lead("head").over(line), F.first("head").over(around)).alias("_after"), F.coalesce(F.lag("tail").over(line), F.last("tail").over(around)).alias("_before"))
    own = Window.partitionBy("_part").orderBy("_key", "_tie")
    got = ranged.select("*", F.lead(F.struct("_key", "_tie")).over(own).alias("_lead"), F.lag(whole).over(own).alias("_lag")).join(ends, "_part")
    return got.select(*nodes.columns, F.coalesce("_lead", "_after").alias("_next"), F.coalesce("_lag", "_before").alias("_prior"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like it is to that and to the next document's.

    The edited text ends in the first floor(n_chars / 4) code points (or all) of the next document instead of its
    own last ones. Rows: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. One row
    comes out for each row; a null text is empty, the only document is its own next, other columns are ignored. Null
    ids come first; rows that agree in the id are ordered by a hash of their texts, and rows that agree in both are
    one document, with one result. An empty table gives an empty one.

    A text is shuffled once, by its id. What the document before it needs of it, its beginning and its sketch, goes
    there in a second, smaller shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST))
    own = docs.select(key.alias("_key"), F.xxhash64(text).alias("_tie"), text.alias("text"))
    ids = docs.select(F.col(id_col).alias("_id"), key.alias("_key"), F.xxhash64(text).alias("_tie"), F.length(text).alias("_n"))
    links = written(neighbours(ids, range_rows), "links")
    merge = lambda a, b: a.join(b.hint("merge"), ["_key", "_tie"])
    prior = links.select("_key", "_tie", F.col("_prior._key").alias("_pk"), F.col("_prior._tie").alias("_pt"), F.floor(F.col("_prior._n") / 4).cast("int").alias("_cut"))
    told = merge(own, prior).select(F.col("_pk").alias("_key"), F.col("_pt").alias("_tie"), F.struct(F.substring(F.col("text"), F.lit(1), F.col("_cut")).alias("head"), sketch(text_words(F.col("text"))).alias("kept")).alias("next"))
    told = told.groupBy("_key", "_tie").agg(F.first("next").alias("next"))
    n = F.length("text")
    whole = merge(own, links.select("_key", "_tie", "_id")).withColumn("kept", sketch(text_words(F.col("text"))))
    paired = merge(whole, told).select(F.col("_id").alias(id_col), n.cast("long").alias("n_chars"), "text", "kept", "next", F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 4).cast("int")), F.col("next.head")).alias("edited"))
    worded = paired.withColumn("edited_kept", sketch(text_words(F.col("edited"))))
    return worded.select(id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spelled(F.col("kept")).alias("fingerprint"), spelled(F.col("edited_kept")).alias("edited_fingerprint"), containment(F.col("kept"), F.col("edited_kept")).alias("near_edited"), containment(F.col("kept"), F.col("next.kept")).alias("near_next"))
