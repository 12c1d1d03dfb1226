"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (1 to 3 letters, words padded by blanks), by
rank. A document's own ranked list is compared by the out-of-place distance: the sum over its n-grams of the
difference of ranks, or the profile's length where the profile lacks the n-gram. The nearest profile wins.

Profiles are counted over a bounded sample of the labelled rows (``max_documents`` of each language, by a hash of the
id) of whole texts; every whole text is classified.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.llm.tokens import map_texts

PROFILE, MAX_DOCUMENTS = 400, 3000
UNKNOWN = "und"
#: How far a document may be from its profile: this quantile of the distances of labelled documents and a margin. Groups
#: of fewer documents than FEWEST have no quantile of their own.
QUANTILE, MARGIN, FEWEST = 0.999, 0.08, 30
CLASSES = 24
#: Characters of a huge text that are counted at a time; the counts are added up.
SEGMENT = 1 << 20
_BITS = np.int64(21)

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def _segments(text: str) -> Iterator[str]:
    """The text in pieces that end at white space where they can."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SEGMENT)
        if end < len(text) and (gap := text.rfind(" ", at, end)) > at:
            end = gap
        yield text[at:end]
        at = end


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams; blanks count only as padding beside letters. Empty without letters."""
    codes, counts = [], []
    for part in _segments(text):
        points = np.frombuffer(part.lower().encode("utf-32-le", "replace"), np.uint32)
        keep = letters()[points]
        if not keep.any():
            continue
        line = np.zeros(len(points) + 2, np.int64)
        line[1:-1] = np.where(keep, points, 0)
        solid = line != 0
        line = line[solid | np.concatenate(([True], solid[:-1]))]
        two = (line[:-1] << _BITS) | line[1:]
        three = (two[:-1] << _BITS) | line[2:]
        # Bits 62 and 61, which no letter reaches, keep lengths apart where a gram begins with a blank (0).
        all_ = np.concatenate((line[line != 0] | (np.int64(1) << 62), two[(line[:-1] | line[1:]) != 0] ^ (np.int64(1) << 61), three[(line[1:-1] != 0)]))
        all_.sort()
        edge = np.flatnonzero(np.concatenate(([True], all_[1:] != all_[:-1])))
        codes.append(all_[edge])
        counts.append(np.diff(np.append(edge, len(all_))))
    if len(codes) < 2:
        return (codes[0], counts[0]) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    code, back = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(back, np.concatenate(counts)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, ties by code."""
    if len(codes) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.argsort(-counts, kind="stable")[:size]]


def length_class(codes: np.ndarray) -> int:
    """Texts of like length: the power of two of their distinct n-grams, of which short texts' distances depend."""
    return min(CLASSES, len(codes).bit_length()) - 1


@dataclass
class Profiles:
    """Languages, all n-grams of their profiles (sorted), and each one's rank in each profile (its length: absent)."""

    names: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    size: int
    #: The largest distance by language and class of length, where documents are rejected by it.
    limits: np.ndarray | None = None

    @classmethod
    def of(cls, lists: dict[str, list[int]], size: int) -> Profiles:
        names = sorted(lists)
        codes = np.unique(np.array([c for x in lists.values() for c in x], np.int64))
        ranks = np.full((len(names), len(codes) + 1), size, np.int32)
        for i, name in enumerate(names):
            ranks[i, np.searchsorted(codes, np.array(lists[name], np.int64))] = np.arange(len(lists[name]))
        return cls(names, codes, ranks, size)

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each profile, as a share of the largest possible one."""
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        rank = self.ranks[:, at]
        gap = np.abs(rank - np.arange(len(own)))
        gap[rank == self.size] = self.size
        return gap.sum(1) / (self.size * max(1, len(own)))

    def predict(self, text: str) -> tuple[str, float, float]:
        """Language, score and distance; UNKNOWN, 0 and 1 for a text without letters or where nothing was learnt.

        A text beyond its limit is UNKNOWN with score 0, too.
        """
        codes, counts = grams(text)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0, 1.0
        distance = self.distances(ranked(codes, counts, self.size))
        best = int(distance.argmin())
        if self.limits is not None and distance[best] > self.limits[best, length_class(codes)]:
            return UNKNOWN, 0.0, float(distance[best])
        return self.names[best], float(1 / np.exp((distance[best] - distance) * 40).sum()), float(distance[best])


def sample(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_documents: int = MAX_DOCUMENTS) -> DataFrame | None:
    """Rows (lang, text): about ``max_documents`` of each language of the rows with ``train``; None without any."""
    lang = F.col(lang_col).cast("string")
    own = docs.where(train & F.col(lang_col).isNotNull())
    # A number for each language, of which the model holds a whole profile; texts aren't joined with anything.
    sizes = {r[0]: r[1] for r in own.groupBy(lang.alias("lang")).count().toLocalIterator()}
    if not sizes:
        return None
    shares = F.create_map(*[F.lit(x) for name, n in sorted(sizes.items()) for x in (name, math.ceil((1 << 30) * min(1.0, max_documents / n)))])
    # Rows without an id have no hash of their own: the text's stands in.
    hashed = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text_col))), F.lit(1 << 30))
    return own.where(hashed < F.element_at(shares, lang)).select(lang.alias("lang"), F.col(text_col).alias("text"))


def learn(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, max_documents: int = MAX_DOCUMENTS) -> Profiles:
    """Profiles of the languages that rows with ``train`` and a non-null language have."""
    rows = sample(docs, train, id_col, text_col, lang_col, max_documents)
    return Profiles.of({}, size) if rows is None else _profiles(rows, size)


def learn_limited(docs: DataFrame, train: Column, farthest: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, max_documents: int = MAX_DOCUMENTS) -> Profiles:
    """Profiles with limits: how far the labelled documents (the same sample) are from their nearest profile.

    A limit is a quantile of these distances and a margin, by language and class of length; where a language has too
    few documents of a class, that of the class in all languages, or that of all, or ``farthest`` (the most in any case).
    """
    rows = sample(docs, train, id_col, text_col, lang_col, max_documents)
    if rows is None:
        return Profiles.of({}, size)
    made = _profiles(rows, size)
    shared = docs.sparkSession.sparkContext.broadcast(made)

    def measure(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        out = []
        for text in texts:
            codes, counts = grams(text.decode("utf-8", "replace"))
            if len(codes):
                distance = shared.value.distances(ranked(codes, counts, size))
                out.append((int(distance.argmin()), length_class(codes), float(distance.min())))
        best, class_, distance = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(best, pa.int32()), pa.array(class_, pa.int32()), pa.array(distance, pa.float64())], names=["best", "class", "distance"])

    far = map_texts(rows, measure, "best int, class int, distance double", ["lang"], "text")
    found = far.rollup("class", "best").agg(F.count("*").alias("n"), F.percentile_approx("distance", QUANTILE).alias("far")).where(F.col("n") >= FEWEST)
    by = {(r["class"], r["best"]): min(farthest, r["far"] + MARGIN) for r in found.collect()}
    all_ = by.get((None, None), farthest)
    made.limits = np.array([[by.get((c, i), by.get((c, None), all_)) for c in range(CLASSES)] for i in range(len(made.names))])
    return made


def _profiles(rows: DataFrame, size: int) -> Profiles:
    def count(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        by: dict[str, list[str]] = {}
        for lang, text in zip(part.column(0).to_pylist(), texts):
            by.setdefault(lang, []).append(text.decode("utf-8", "replace"))
        found = {lang: grams("\n".join(said)) for lang, said in by.items()}
        return pa.RecordBatch.from_arrays([pa.array([k for k, (c, _) in found.items() for _ in range(len(c))], pa.string()), *(pa.array(np.concatenate([np.zeros(0, np.int64), *(v[i] for v in found.values())])) for i in (0, 1))], names=["lang", "code", "n"])

    from pyspark.sql import Window

    totals = map_texts(rows, count, "lang string, code long, n long", ["lang"], "text").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = totals.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= size)
    lists: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").collect():
        lists.setdefault(r.lang, []).append(r.code)
    return Profiles.of(lists, size)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Rows (id, lang_pred, score, distance), one for each row of ``docs``, with the columns ``carry``.

    ``score`` in 0 to 1 compares the nearest profile with the others; ``distance`` in 0 to 1 is the out-of-place
    distance to it. A null text or one without letters is UNKNOWN with score 0. Ties go to the first name. Repeated
    rows and null ids stay; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    keep = [id_col, *(carry or [])]

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        got = [shared.value.predict(t.decode("utf-8", "replace")) for t in texts]
        return pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array([g[0] for g in got], pa.string()), *(pa.array([g[i] for g in got], pa.float64()) for i in (1, 2))], names=[*keep, "lang_pred", "score", "distance"])

    kinds = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("distance", T.DoubleType())])
    return map_texts(docs, work, kinds, keep, text_col)


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``part`` (a null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))
